"""Best-fit packing of documents into training sequences, bettered by a local search of exchanges.

Lengths are counts of token ids. Documents longer than a bin are cut into full pieces and a rest. Pieces are dealt by hash into independent groups whose
number follows from the tokens of the corpus, so that a task holds the lengths of about BINS bins. In a group the
pieces go best-fit, longest first; then documents are moved, exchanged one for one, two for one or one for two between
underfull bins wherever that increases the sum of squared fills, until no such step is left or the bins are as few as the tokens allow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace
from quarry.llm.tokens import slices
from quarry.llm.wavelet import VOCABULARY, encoding, token_ids

#: Tokens of a bin, and bins of a group on average.
CAPACITY, BINS = 2048, 1024


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of the items, longest first, each into the fullest bin that still takes it. Sizes are from 1 to the capacity."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set if a bin has the gap g
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = gaps >> s
        if fitting:
            gap = s + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        by_gap[gap - s].append(b)
        gaps |= 1 << (gap - s)
    return bins


def _sums(items: np.ndarray, sizes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct sizes of a bin's items, and the distinct sums of two of them, each with one item or pair that has it."""
    items = np.sort(items)
    single, first, counts = np.unique(sizes[items], return_index=True, return_counts=True)
    order = np.argsort(sizes[items], kind="stable")
    again = items[order[np.minimum(np.cumsum(counts) - counts + 1, len(order) - 1)]]  # another item of the same size, where there is one
    i, j = np.triu_indices(len(single))
    keep = (i != j) | (counts[i] > 1)
    i, j = i[keep], j[keep]
    double, place = np.unique(single[i] + single[j], return_index=True)
    left, right = items[first[i[place]]], np.where(i[place] == j[place], again[j[place]], items[first[j[place]]])
    return (single, items[first], np.full(len(single), -1)), (double, left, right)


class _Search:
    """Bins that aren't full, with their items; steps that increase the sum of squared fills.

    Items of one size are alike, so a bin is known by its distinct sizes and sums of two, which are at most as many as the capacity
    whatever the number of items. What is moved from one bin to another is best the most that fits, so for each thing to take in exchange only the
    largest thing to give that still fits is looked at: no table of all exchanges is made.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = {b: list(items) for b, items in enumerate(bins)}
        self.fill = {b: int(sizes[items].sum()) for b, items in self.bins.items()}
        self.open = {b for b in self.bins if self.fill[b] < capacity}
        self.known: dict[int, tuple] = {}
        self.flat: tuple | None = None

    def _of(self, b: int):
        if b not in self.known:
            self.known[b] = _sums(np.array(self.bins[b], dtype=np.int64), self.sizes)
        return self.known[b]

    def _taken(self):
        """Nothing, single items and pairs of all open bins: for each its size, its items, and its bin's number, fill and gap."""
        if self.flat is None:
            bins = np.array(sorted(self.open), dtype=np.int64)
            fill = np.array([self.fill[b] for b in bins.tolist()], dtype=np.int64)
            none = np.zeros(len(bins), dtype=np.int64)
            out = [(none, none - 1, none - 1, bins, fill)]
            for kind in (0, 1):
                parts = [self._of(b)[kind] for b in bins.tolist()]
                n = [len(x[0]) for x in parts]
                out.append((*(np.concatenate([none[:0], *(x[c] for x in parts)]) for c in range(3)), np.repeat(bins, n), np.repeat(fill, n)))
            self.flat = tuple((*x, self.capacity - x[4] + x[0]) for x in out)
        return self.flat

    def step(self, giver: int) -> bool:
        """The step that gives most from this bin to another, of equal ones that to the first bin; False if there is none. Exchanges are tried if nothing can be moved."""
        least = self.fill[giver]
        single, double = self._of(giver)
        nothing, singles, doubles = self._taken()
        found = (0, None, None, 0)

        def best(given, taken):
            nonlocal found
            size, _, _, bins, fill, room = taken
            if not len(given[0]) or not len(size):
                return
            at = np.searchsorted(given[0], room, side="right") - 1
            moved = given[0][at] - size
            gain = np.where((at >= 0) & (moved > 0) & (bins != giver), moved * (fill - least + moved), 0)
            k = int(gain.argmax())
            if gain[k] > found[0]:
                found = int(gain[k]), (int(given[1][at[k]]), int(given[2][at[k]])), (int(taken[1][k]), int(taken[2][k])), int(bins[k])

        best(single, nothing)
        if not found[0]:
            best(single, singles)
            best(double, singles)
            best(single, doubles)
        gain, given, taken, to = found
        if not gain:
            return False
        given, taken = [x for x in given if x >= 0], [x for x in taken if x >= 0]
        for items, a, b in ((given, giver, to), (taken, to, giver)):
            for x in items:
                self.bins[a].remove(x)
                self.bins[b].append(x)
        moved = int(sum(self.sizes[x] for x in given) - sum(self.sizes[x] for x in taken))
        for b, change in ((giver, -moved), (to, moved)):
            self.known.pop(b, None)
            self.fill[b] += change
            (self.open.discard if self.fill[b] in (0, self.capacity) else self.open.add)(b)
        self.flat = None
        if not self.bins[giver]:
            del self.bins[giver], self.fill[giver]
        return True


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, numbered from 0. Sizes are from 1 to the capacity."""
    sizes = np.asarray(sizes, dtype=np.int64)
    search = _Search(best_fit(sizes, capacity), sizes, capacity)
    least = -(-int(sizes.sum()) // capacity)
    changed = True
    while changed and len(search.bins) > least:
        changed = False
        for b in sorted(search.open, key=lambda b: (search.fill[b], b)):
            while b in search.open and len(search.bins) > least and search.step(b):
                changed = True
    out = np.zeros(len(sizes), dtype=np.int64)
    for k, b in enumerate(sorted(search.bins)):
        out[search.bins[b]] = k
    return out


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n): how many token ids each row's text has by the tokenizer of the token files. A null text has none; an empty table gives no row."""

    def run(batches):
        enc = encoding(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [len(token_ids(enc, x)) if x else 0 for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bins: int = BINS, length_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(bin_id, doc_id, piece, start, tokens): each piece of each document with its bin; start is its first token in the document.

    Tokens are the ids that the tokenizer of the token files gives; length_col names a column of counts instead.
    Null and empty texts, and counts below 1, have no row. Repeated rows are packed each for itself, wherever their place in the table puts them; a null id stays null.
    A document above the capacity, however long, is cut into pieces that are dealt each for itself. Of steps that gain alike the one to the first bin is taken.
    An empty table gives no row. Other columns aren't looked at.
    """
    if capacity < 1:
        raise ValueError("a bin takes a token at least")
    work = Workspace(docs.sparkSession, "packing")
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(length_col).cast("long").alias("n")) if length_col else lengths(docs, id_col, text_col, vocabulary)
    sized = work.store(counted.where("n >= 1"), "lengths")
    total = sized.agg(F.sum("n")).first()[0] or 0
    groups = max(1, round(total / (capacity * bins)))
    last = F.floor((F.col("n") - 1) / capacity).cast("int")
    # by the place in the stored table, which is the same in every attempt: rows that repeat an id and a text are spread like others
    pieces = sized.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "at", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select(F.pmod(F.xxhash64("at", "piece"), F.lit(groups)).alias("group"), "doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).alias("tokens"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("tokens", "ascending")])
        size = table.column("tokens").to_numpy()
        bin_ = pack(size, capacity) + (table.column("group")[0].as_py() << 32)
        start = table.column("piece").to_numpy().astype(np.int64) * capacity
        return pa.table({"bin_id": bin_, "doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": start, "tokens": size})

    return pieces.groupBy("group").applyInArrow(run, "bin_id long, doc_id long, piece int, start long, tokens long").withColumnRenamed("doc_id", id_col)
