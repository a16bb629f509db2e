"""Bit sketches of token sets, their overlap, and nearest neighbours by Hamming distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import sketch_tokens
from quarry.operators.rank import tasks_for_pairs
from quarry.storage import BROADCAST_BYTES, new_folder, small_parts

#: Bits of a block, in words of 32; eight blocks hold the same bits in other places, so one is stored and counts so often.
BITS, WORD, BLOCKS = 128, 32, 8


def bit_of(token: Column) -> Column:
    """The first 32 bits of the hash modulo BITS, which its seventh and eighth hexadecimal digits have."""
    digit = lambda i: F.call_function("instr", F.lit("0123456789abcdef"), F.substring(F.md5(token), i, 1)).cast("long") - 1
    return F.pmod(digit(7) * 16 + digit(8), F.lit(BITS))


def signatures(parts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key.., word, bits) of rows with a toks column; words without a bit have no row."""
    tokens = parts.select(*key, F.explode(F.array_distinct("toks")).alias("token"))
    bit = bit_of(F.col("token"))
    placed = tokens.select(*key, (bit / WORD).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(WORD)).cast("int")).alias("bit"))
    return placed.groupBy(*key, "word").agg(F.bit_or("bit").alias("bits"))


def documents(df: DataFrame, fields: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, word, bits) of the fields' token sets."""
    per_field = F.array(*(F.struct(F.lit(f).alias("field"), sketch_tokens(F.col(f)).alias("toks")) for f in fields))
    exploded = df.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(per_field).alias("f")).select("doc_id", "f.field", "f.toks")
    return signatures(exploded, ("doc_id", "field"))


def queries(df: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, word, bits) of query texts."""
    return signatures(df.select(F.col(id_col).cast("long").alias("query_id"), sketch_tokens(F.col(text_col)).alias("toks")), ("query_id",))


def overlap(docs: DataFrame, asked: DataFrame, boosts: dict[str, float] | None = None, k: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): documents by the bits they share with the query, over all fields with their boosts.

    The sketches are stored with all words of a field in a row. Queries go to every task in blocks of so many bytes; a task has so many documents that the pairs it scores and sorts are bounded.
    """
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "sketches")
    _wide(docs, ("doc_id", "field"), "b").write.parquet(path)
    stored, wanted = spark.read.parquet(path), _wide(asked, ("query_id",), "a")
    number = stored.count()
    weight = F.lit(1.0)
    for field, boost in (boosts or {}).items():
        weight = F.when(F.col("field") == field, F.lit(float(boost))).otherwise(weight)
    shared = sum((F.bit_count(F.col(f"b{w}").bitwiseAND(F.col(f"a{w}"))) for w in range(BITS // WORD)), F.lit(0)).cast("long") * BLOCKS
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def best(part: DataFrame) -> DataFrame:
        placed = stored.repartition(tasks_for_pairs(spark, number, part.count()), "doc_id")
        both = placed.join(part).select("query_id", "doc_id", (weight * shared).alias("part"))
        scores = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 4).alias("score")).where("score > 0")
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    return reduce(DataFrame.union, map(best, small_parts(wanted, "query_id", limit)))


def _wide(sketches: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """A row for each key, with all words; those without a bit are 0."""
    words = (F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")).alias(f"{name}{w}") for w in range(BITS // WORD))
    return sketches.groupBy(*key).agg(*words)


def sign_words(vector: Column, dim: int) -> list[Column]:
    """The signs of a vector's elements, 32 in an integer. A loop over the array keeps the code of the join that follows small enough to be compiled."""
    powers = F.array(*(F.lit(1 << i).cast("long") for i in range(WORD)))
    zero = F.lit(0).cast("long")
    bits = lambda w: F.zip_with(F.slice(vector, w * WORD + 1, min(WORD, dim - w * WORD)), powers, lambda x, p: F.when(x > 0, p).otherwise(zero))
    return [F.aggregate(bits(w), zero, lambda s, x: s + x) for w in range(-(-dim // WORD))]


def nearest(vectors: DataFrame, asked: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k vectors with the fewest signs unlike the query's, the query itself among them.

    The search is exhaustive, so its time grows with the square of a table that is held against itself. Pairs aren't rows, which would have to be sorted: asked goes to every task in
    blocks of so many bytes, a task compares by numpy and gives the k best of each query for each million of its vectors. Null vectors have no sign set; null ids come last.
    """
    spark = vectors.sparkSession
    signed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _signs(vectors, vector_col, dim).alias("signs"))
    wanted = asked.select(F.col(id_col).cast("long").alias("query_id"), _signs(asked, vector_col, dim).alias("signs"))
    order = Window.partitionBy("query_id").orderBy("distance", F.asc_nulls_last("vec_id"))

    def best(part: DataFrame) -> DataFrame:
        rows = part.toArrow()
        sent = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), rows["signs"].combine_chunks()))
        return signed.mapInArrow(_searcher(sent, k), "query_id long, vec_id long, distance long")

    found = reduce(DataFrame.union, map(best, small_parts(wanted, "query_id", limit)))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _signs(df: DataFrame, vector_col: str, dim: int) -> Column:
    filled = F.coalesce(F.col(vector_col), F.array().cast(df.schema[vector_col].dataType))
    return F.array(*sign_words(filled, dim))


def _searcher(sent, k: int):
    """The function that a task applies to its vectors; it needs nothing of this package, which isn't on the executors."""

    def search(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        block, some, most, none = 1 << 20, 512, 4096, np.iinfo(np.int64).max

        def packed(signs: pa.Array) -> np.ndarray:
            """Words of 64 bits, a row for each vector."""
            words = signs.flatten().to_numpy(zero_copy_only=False).reshape(len(signs), -1).astype(np.uint64)
            if words.shape[1] % 2:
                words = np.hstack([words, np.zeros((len(words), 1), np.uint64)])
            return words[:, ::2] | words[:, 1::2] << np.uint64(32)

        def blocks():
            held, n = [], 0
            for b in batches:
                for start in range(0, b.num_rows, block):
                    part = b.slice(start, block)
                    if n and n + part.num_rows > block:
                        yield held
                        held, n = [], 0
                    held, n = [*held, part], n + part.num_rows
            if n:
                yield held

        query_ids, signs = sent.value
        asked = packed(signs) if len(signs) else None
        for held in blocks() if len(query_ids) else ():
            table = pa.Table.from_batches(held).combine_chunks()
            by_id = pc.sort_indices(table["vec_id"])  # so that a later vector loses against an earlier one as near
            ids, words = table["vec_id"].combine_chunks().take(by_id), packed(table["signs"].combine_chunks())[by_id.to_numpy()]
            n = len(words)
            for first in range(0, len(asked), some):
                own = asked[first : first + some]
                keys = np.full((len(own), k), none)  # distance * n + place, the least k in order
                at, step = 0, max(64, k)
                while at < n:
                    now = words[at : at + step]
                    far = np.bitwise_count(own[:, 0, None] ^ now[None, :, 0])
                    for w in range(1, own.shape[1]):
                        far = far.astype(np.uint16) + np.bitwise_count(own[:, w, None] ^ now[None, :, w])
                    bound = np.minimum(keys[:, -1] // n, np.iinfo(far.dtype).max).astype(far.dtype)
                    row, col = np.nonzero(far < bound[:, None])
                    if len(row):
                        changed, row_at = np.unique(row, return_inverse=True)
                        key = np.concatenate([keys[changed].ravel(), far[row, col].astype(np.int64) * n + at + col])
                        of = np.concatenate([np.repeat(np.arange(len(changed)), k), row_at])
                        order = np.lexsort((key, of))
                        start = np.searchsorted(of[order], np.arange(len(changed)))
                        keys[changed] = key[order][start[:, None] + np.arange(k)]
                    at, step = at + step, min(2 * step, most)
                row, col = np.nonzero(keys < none)
                distance, place = np.divmod(keys[row, col], n)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(first + row)), ids.take(pa.array(place)), pa.array(distance)], ["query_id", "vec_id", "distance"])

    return search
