"""Integer codes of postings, and the sizes of filters, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import placed

LONGEST_RUN = 255
#: Bytes of stored postings for each task that walks along terms' lists.
LIST_BYTES = 8 << 20


def vbyte_length(value: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def vbyte(value: Column) -> Column:
    """A number's bytes as hexadecimal text: seven bits each, the lowest first, the upper bit set in all but the last."""
    groups = F.array(*(F.shiftrightunsigned(value, 7 * i).bitwiseAND(F.lit(127).cast("long")) for i in range(10)))
    n = vbyte_length(value)
    marked = F.transform(F.slice(groups, F.lit(1), n), lambda g, i: g + F.when(i < n - 1, 128).otherwise(0))
    return F.array_join(F.transform(marked, lambda c: F.lpad(F.hex(c), 2, "0")), "")


def vbyte_decode(code: Column, first: int | None = None) -> Column:
    """The numbers of codes one after another in a hexadecimal text, or the first of them only: what lies behind isn't looked at. A code without its last byte is left out."""
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    places = F.filter(F.sequence(F.lit(0), F.floor(F.length(code) / 2).cast("int")), lambda i: i < F.floor(F.length(code) / 2))
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("done"), F.lit(0).cast("long").alias("now"), F.lit(0).alias("shift"))

    def take(state: Column, i: Column) -> Column:
        b = byte(i)
        now = state["now"].bitwiseOR(F.call_function("shiftleft", b.bitwiseAND(F.lit(127).cast("long")), state["shift"]))
        end = b < 128
        full = F.lit(False) if first is None else F.size(state["done"]) >= first
        after = F.struct(F.when(end, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(end, F.lit(0).cast("long")).otherwise(now).alias("now"), F.when(end, F.lit(0)).otherwise(state["shift"] + 7).alias("shift"))
        return F.when(full, state).otherwise(after)

    return F.aggregate(places, start, take, lambda state: state["done"])


def _by_term(rows: DataFrame, *columns: str) -> DataFrame:
    """Only what is asked for, shuffled by term once for all windows that follow, with a bounded number of bytes for each task (but for a term, which is one task's)."""
    return placed(rows.select("field", "term", *columns), "field", "term", each=LIST_BYTES)


def from_gaps(gaps: DataFrame, place: str = "place") -> DataFrame:
    """(field, term, place, doc_id) of gaps in their order: the inverse of delta_gaps()."""
    order = Window.partitionBy("field", "term").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gaps.select("field", "term", place, F.sum("gap").over(order).alias("doc_id"))


def from_run_lengths(runs: DataFrame) -> DataFrame:
    """(field, term, place, tf): each frequency at its place, from 1, in the term's list: the inverse of run_lengths()."""
    order = Window.partitionBy("field", "term").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("before", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return rows.select("field", "term", "tf", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"))).alias("i")).select("field", "term", (F.col("before") + F.col("i")).alias("place"), "tf")


def delta_gaps(postings: DataFrame) -> DataFrame:
    """(field, term, doc_id, gap): each document id less the one before it in the term's list; the first is itself."""
    return numbered_gaps(postings).drop("place")


def numbered_gaps(postings: DataFrame) -> DataFrame:
    """(field, term, place, doc_id, gap): delta_gaps() with the place, from 1, in the term's list; both take one sort."""
    order = Window.partitionBy("field", "term").orderBy("doc_id")
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(order), F.lit(0))
    return _by_term(postings, "doc_id").select("field", "term", F.row_number().over(order).cast("long").alias("place"), "doc_id", gap.alias("gap"))


def run_lengths(postings: DataFrame, longest: int = LONGEST_RUN) -> DataFrame:
    """(field, term, run, tf, length): runs of equal frequencies along a term's list, cut at the longest length that a byte holds.

    The list is sorted once: a run ends where the next frequency is another one, or where it is full, and only its end goes on.
    """
    order = Window.partitionBy("field", "term").orderBy("doc_id")
    other = lambda to: F.coalesce(F.col("tf") != to, F.lit(True))
    rows = _by_term(postings, "doc_id", "tf").select("*", F.row_number().over(order).alias("place"), other(F.lag("tf").over(order)).alias("begins"), other(F.lead("tf").over(order)).alias("ends"))
    so_far = F.col("place") - F.max(F.when(F.col("begins"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = rows.withColumn("length", so_far % longest + 1).where(F.col("ends") | (F.col("length") == longest))
    return ends.select("field", "term", F.row_number().over(order).alias("run"), "tf", F.col("length").cast("long").alias("length"))


def bloom_hashes(rate: float) -> int:
    """Hashes of a filter with the wanted rate of false answers."""
    return round(-math.log2(rate))


def bloom_bits(count: Column, rate: float) -> Column:
    """Bits of a filter for so many keys."""
    return F.ceil(count * F.lit(math.log(rate) / math.log(1 / 2 ** math.log(2)))).cast("long")


def bloom_bytes(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def fnv1a(value: Column) -> Column:
    """FNV-1a of a number's eight bytes, the lowest first, as a signed 64-bit number.

    The product wraps around; it is built from the halves, so that it does so under ANSI rules, too.
    """
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def times(x: Column) -> Column:
        """x times 2^40 + 0x1B3"""
        first = low(x) * F.lit(0x1B3).cast("long")
        upper = low(F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(x, 32) * F.lit(0x1B3).cast("long") + F.shiftleft(low(x), 8))
        return F.shiftleft(upper, 32).bitwiseOR(low(first))

    octets = F.array(*(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)))
    return F.aggregate(octets, F.lit(-3750763034362895579).cast("long"), lambda h, o: times(h.bitwiseXOR(o)))
