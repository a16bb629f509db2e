"""Benchmark passages in documents, by a positional inverted index.

The index is partitioned by document: a segment holds, for some megabytes of text, each term with the sorted places at which it
stands. A benchmark item is looked up in a segment from its rarest term on: the places of that term, less its
offset in the phrase, are intersected with the offset-adjusted places of the next rarer one, and so on, so that a
frequent term is only searched for what is left. Exact phrases are runs of words, whatever signs and case they are written with;
proximity matches are windows that hold most of an item's distinct words in any order. In scripts that are written without blanks
each character is a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace, without
from quarry.llm.tokens import release, slices, tokenize

#: Words of an exact phrase; a shorter item counts as a whole if it has FEWEST words: whatever its length.
PHRASE, FEWEST = 13, 1
#: A proximity match holds this share of an item's distinct words within so many times its length; items with fewer distinct words have none.
SHARE, WIDTH, DISTINCT = 0.8, 1.5, 10
#: Megabytes of text of a segment, and words of benchmark that are looked up at once; more are looked up block by block.
SEGMENT, BLOCK = 4 << 20, 500_000

_INDEX = "ids binary, ends binary, terms binary, heads binary, places binary"
_MATCH = "doc long, item long, kind string, start long, stop long, words long"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A row for each segment: document ids and the ends of their words; terms, the ends of their lists, and the lists as differences.

    All words of all texts are in it. Null ids, null texts and texts without words are left out.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", segment):
                found = tokenize(part.column("text"), scripts=True)
                some = found.counts > 0
                if not some.any():
                    continue
                hashes = found.hashes.view(np.int64)
                order = np.argsort(hashes, kind="stable").astype(np.int32)
                ordered = hashes[order]
                head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                gaps = np.diff(order, prepend=np.int32(0))
                gaps[head] = order[head]
                values = part.column("id").to_numpy()[some], found.bounds[1:][some], ordered[head], np.append(head[1:], len(order)).astype(np.int32), gaps.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in values], ["ids", "ends", "terms", "heads", "places"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return chosen.mapInArrow(run, _INDEX)


@dataclass
class Segment:
    ids: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    heads: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Segment:
        return cls(*(np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t) for c, t in (("ids", np.int64), ("ends", np.int64), ("terms", np.int64), ("heads", np.int32), ("places", np.int32))))

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def begin(self, docs: np.ndarray) -> np.ndarray:
        return np.where(docs > 0, self.ends[docs - 1], 0)


class Lists:
    """The places of terms in a segment, unpacked when they are asked for; None for a term that the segment doesn't have. size: how many each has."""

    def __init__(self, segment: Segment, terms: np.ndarray):
        self.segment, self.known = segment, {}
        self.at = np.minimum(np.searchsorted(segment.terms, terms), len(segment.terms) - 1)
        self.size = np.where(segment.terms[self.at] == terms, np.diff(segment.heads, prepend=np.int32(0))[self.at], 0).astype(np.int64)

    def __getitem__(self, term: int) -> np.ndarray | None:
        if not self.size[term]:
            return None
        if term not in self.known:
            k = self.at[term]
            self.known[term] = np.cumsum(self.segment.gaps[self.segment.heads[k] - self.size[term] : self.segment.heads[k]], dtype=np.int64)
        return self.known[term]


@dataclass
class Items:
    """Benchmark items: their words as numbers of terms, and all words and distinct words one item after another."""

    ids: list[int]
    words: list[np.ndarray]
    terms: np.ndarray

    def __post_init__(self):
        none = np.zeros(0, dtype=np.int64)
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        own = [np.unique(w) for w in self.words]
        self.distinct = np.array([len(w) for w in own], dtype=np.int64)
        self.flat, self.each = np.concatenate([none, *self.words]), np.concatenate([none, *own])

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Items:
        found = tokenize(pa.array(texts, pa.string()), scripts=True)
        terms, number = np.unique(found.hashes.view(np.int64), return_inverse=True)
        return cls(list(ids), [number[a:b] for a, b in zip(found.bounds, found.bounds[1:])], terms)

    def with_run(self, size: np.ndarray, phrase: int) -> np.ndarray:
        """Items of which so many words in a row, or all, are in the segment; the others can have no phrase there."""
        some = np.flatnonzero(self.counts)
        if not len(some):
            return some
        counts, place = self.counts[some], np.arange(len(self.flat))
        head = np.cumsum(counts) - counts
        absent = np.maximum.accumulate(np.where(size[self.flat] > 0, -1, place))
        run = place - np.maximum(absent, np.repeat(head - 1, counts))
        return some[np.maximum.reduceat(run, head) >= np.minimum(counts, phrase)]

    def with_share(self, size: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Items of which so many distinct words are in the segment."""
        some = np.flatnonzero(self.distinct)
        if not len(some):
            return some
        there = np.add.reduceat((size[self.each] > 0).astype(np.int64), np.cumsum(self.distinct[some]) - self.distinct[some])
        return some[there >= need[some]]


def _inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def phrases(segment: Segment, items: Items, lists: Lists, phrase: int = PHRASE, fewest: int = FEWEST):
    """(item, document, start, stop): longest runs of an item's words in a document, of so many words at least."""
    size = lists.size
    for k in items.with_run(size, phrase).tolist():
        words = items.words[k]
        n = min(phrase, len(words))
        if n < fewest:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(words, n)
        counts = size[windows]
        found: list[tuple[int, np.ndarray]] = []
        for offset in np.flatnonzero(counts.min(axis=1) > 0).tolist():
            order = np.argsort(counts[offset], kind="stable")
            left = None
            for j in order.tolist():
                adjusted = lists[windows[offset, j]]
                left = adjusted - j if left is None else left[_inside(left + j, adjusted)]
                if not len(left):
                    break
            if len(left):
                left = left[(left >= 0)]
                left = left[segment.doc(left) == segment.doc(left + n - 1)]
                if len(left):
                    found.append((offset, left))
        if found:  # runs along one diagonal, place less offset, are joined
            offset = np.repeat([o for o, _ in found], [len(x) for _, x in found])
            place = np.concatenate([x for _, x in found])
            order = np.lexsort((place, place - offset))
            place, diagonal = place[order], (place - offset)[order]
            head = np.flatnonzero(np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)]))
            start, stop = place[head], place[np.append(head[1:], len(place)) - 1] + n
            yield from ((k, d, s, e) for d, s, e in zip(segment.doc(start).tolist(), start.tolist(), stop.tolist()))


def proximities(segment: Segment, items: Items, lists: Lists, share: float = SHARE, width: float = WIDTH, least: int = DISTINCT):
    """(item, document, start, stop, words): windows with so large a share of the item's distinct words; overlapping ones are joined, words is the most of one."""
    needs = np.ceil(share * items.distinct).astype(np.int64)
    for k in items.with_share(lists.size, needs).tolist():
        words = items.words[k]
        distinct, need = np.unique(words), int(needs[k])
        if len(distinct) < least:
            continue
        reach = int(width * len(words))
        there = [lists[t] for t in distinct.tolist() if lists[t] is not None]
        there.sort(key=len)
        spare = len(there) - need  # so many of the words there may be missing
        anchor = np.unique(np.concatenate(there[: spare + 1]))
        doc = segment.doc(anchor)
        low, high = np.maximum(anchor - reach + 1, segment.begin(doc)), np.minimum(anchor + reach, segment.ends[doc])
        missing = np.zeros(len(anchor), dtype=np.int64)
        for places in there:
            missing += np.searchsorted(places, low) == np.searchsorted(places, high)
            keep = missing <= spare
            if not keep.all():
                low, high, missing, doc = low[keep], high[keep], missing[keep], doc[keep]
            if not len(low):
                break
        if not len(low):
            continue
        spans: dict[int, list] = {}
        new = np.concatenate([[True], (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])])  # joined stretches to look at
        head = np.flatnonzero(new)
        for a, b in zip(head.tolist(), np.append(head[1:], len(low)).tolist()):
            lo, hi = int(low[a:b].min()), int(high[a:b].max())
            marks = sorted((int(p), t) for t, places in enumerate(there) for p in places[np.searchsorted(places, lo) : np.searchsorted(places, hi)])
            count: dict[int, int] = {}
            j = 0
            for i, (p, t) in enumerate(marks):
                while j < len(marks) and marks[j][0] < p + reach:
                    count[marks[j][1]] = count.get(marks[j][1], 0) + 1
                    j += 1
                if len(count) >= need:
                    own = spans.setdefault(int(doc[a]), [])
                    stop = marks[j - 1][0] + 1
                    if own and p < own[-1][1]:
                        own[-1][1:] = [max(own[-1][1], stop), max(own[-1][2], len(count))]
                    else:
                        own.append([p, stop, len(count)])
                count[t] -= 1
                if not count[t]:
                    del count[t]
        for d, own in sorted(spans.items()):
            yield from ((k, d, s, e, n) for s, e, n in own)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", phrase: int = PHRASE, share: float = SHARE, width: float = WIDTH, block: int = BLOCK, segment: int = SEGMENT, fewest: int = FEWEST, distinct: int = DISTINCT) -> DataFrame:
    """(doc_id, item_id, kind, start, stop, words): matches of benchmark items in documents, at words start to stop, counted from 0.

    kind is phrase for the longest runs of an item's words, proximity for windows with most of its distinct words.
    phrase is the number of words in a row; a shorter item, down to one word, matches where all of it stands; fewest leaves out items of fewer words.
    A proximity window is up to width times as long as the item and holds the share of its distinct words; items of fewer distinct words than distinct have none, for any
    text has a few frequent words near one another. Equal words in a window count once. block and segment bound what is held at once and change no result. Texts may be of any length.
    Null ids and null, empty or wordless texts on either side match nothing; repeated rows match each for itself, repeated items once; an empty table gives no row.
    Other columns aren't looked at.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    stored = work.store(index(docs, id_col, text_col, segment), "index")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    items = items.withColumn("n", F.length("text") + 1)
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-int(total) // (6 * block)))  # of about so many words each; each goes to every task by itself
    found = [work.store(_lookup(stored, items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), phrase, share, width, fewest, distinct), f"found-{b}") for b in range(blocks)]
    work.drop("index")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "kind", "start", "stop", "words")


def _lookup(stored: DataFrame, items: DataFrame, phrase: int, share: float, width: float, fewest: int, distinct: int) -> DataFrame:
    rows = items.select("item", "text").toPandas().sort_values(["item", "text"])
    sent = stored.sparkSession.sparkContext.broadcast(Items.of(rows["item"].tolist(), rows["text"].tolist()))

    def run(batches):
        items = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                part = Segment.of(batch, row)
                lists = Lists(part, items.terms)
                out = [(k, d, "phrase", s, e, e - s) for k, d, s, e in phrases(part, items, lists, phrase, fewest)]
                out += [(k, d, "proximity", s, e, n) for k, d, s, e, n in proximities(part, items, lists, share, width, distinct)]
                if out:
                    item, doc, kind, start, stop, words = zip(*out)
                    doc = np.array(doc)
                    base = part.begin(doc)
                    columns = part.ids[doc], np.array(items.ids)[list(item)], pa.array(kind), np.array(start) - base, np.array(stop) - base, np.array(words, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "item", "kind", "start", "stop", "words"])
            release()

    return stored.mapInArrow(run, _MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that a benchmark item matches; the others stay with all their columns, whatever these are called.

    Options are those of matches(): phrase, share, width, fewest, distinct and so on; where items are so short that they stand in texts by chance, fewest keeps these texts.
    Rows without an id, and null, empty and wordless texts, stay; rows that repeat an id go or stay together; an empty table of either kind takes nothing away.
    """
    work = Workspace(docs.sparkSession, "decontaminate-drop")
    gone = work.store(matches(docs, benchmark, id_col, text_col, **options).select(id_col).distinct(), "gone")
    return without(docs, gone, id_col)
