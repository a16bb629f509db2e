"""Passages that occur more than once, by distributed prefix doubling over word positions.

A position's rank at length w names the run of w words that starts there. Ranks at SEED words are hashes of the run.
Each round pairs a position's rank with the rank at an offset, Spark sorts the pairs, and equal neighbours get one new
rank, the place of the first of them; positions whose rank is unique drop out. At the threshold the
positions that still share a rank start a repeated passage.

Before that, positions that can't be in a repeated passage are left out, exactly: of all SEED-word runs in the passage at a
position, the one with the least hash (the leftmost of equal ones) is picked. Equal passages pick equal runs, so a
position whose pick occurs nowhere else starts no repeated passage. Of documents with the same words
one takes part for all; the others are repeated as a whole.

A rank that very many positions share would make one task sort them all. Such ranks, found from a part of the documents, are named by a hash of the
pair instead, and whether a pair is repeated and where it is first is an aggregation with partial sums; which ranks are found changes no result.

Words are those of the tokens module; signs that stand alone between blanks are words, too, and so is each character of scripts without blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace, if_small, partitions
from quarry.llm.tokens import Tokens, grams, mix, slices, tokenize

#: Words of a passage that counts as repeated, at least.
WORDS = 50
#: Hashes of repeated runs up to which they are sent to every task (8 bytes each); beyond, they are joined to their documents.
SENT = 4_000_000
#: Positions that share a rank beyond which they aren't sorted in one task, and words of the documents in which such ranks are looked for, about.
HOT, LOOKED = 20_000_000, 4_000_000
_POSITION = "doc long, pos int"
_PAIR = "r1 long, r2 long, doc long, pos int"


def _tokens(column: pa.Array) -> Tokens:
    return tokenize(column, scripts=True, signs=True)


def seed_of(words: int) -> int:
    """Words of the first ranks: a quarter of the threshold, so that two rounds reach it."""
    return max(1, -(-words // 4))


def picks(runs: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many runs the place of its least hash, the leftmost of equal ones."""
    n = len(runs) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, low, width = np.arange(len(runs)), runs.copy(), 1
    while width < window:  # doubling; the last step overlaps
        step = min(width, window - width)
        other = low[step:] < low[:-step]
        best = np.where(other, best[step:], best[:-step])
        low = np.where(other, low[step:], low[:-step])
        width += step
    return best


def _key(hashes: np.ndarray) -> int:
    """A hash of all words of a document."""
    if not len(hashes):
        return 0
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix(hashes + mix(np.arange(len(hashes), dtype=np.uint64)))).view(np.int64))


def outline(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc, key, words, picked, again) of each document: hash of its words, their number, its distinct picked runs, those picked at several places."""
    seed = seed_of(words)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = _tokens(part.column("text"))
                keys, picked, again = [], [], []
                for a, b in zip(found.bounds, found.bounds[1:]):
                    h = found.hashes[a:b]
                    keys.append(_key(h))
                    runs = grams(h, seed)
                    values, counts = np.unique(runs[np.unique(picks(runs, words - seed + 1))].view(np.int64), return_counts=True)
                    picked.append(values)
                    again.append(values[counts > 1])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.int64()), pa.array(found.counts), _lists(picked), _lists(again)], ["doc", "key", "words", "picked", "again"])

    return _ids(docs, id_col, text_col).mapInArrow(run, "doc long, key long, words long, picked array<long>, again array<long>")


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _starts(h: np.ndarray, known: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that may start a repeated passage and those that their later ranks need, with the pair of ranks at the seed."""
    seed = seed_of(words)
    runs = grams(h, seed)
    pick = picks(runs, words - seed + 1)
    none = np.zeros(0, dtype=np.int64)
    if not len(pick):
        return none, none, none
    start = np.flatnonzero(_isin(runs[pick].view(np.int64), known))
    wanted, width = start, 2 * seed
    while width < words:
        step = min(width, words - width)
        wanted = np.union1d(wanted, wanted + step)
        width += step
    first = runs.view(np.int64)
    return wanted, first[wanted], first[wanted + min(seed, words - seed)]


def _rerank(df: DataFrame, last: bool) -> DataFrame:
    """Sorts (r1, r2, doc, pos) and ranks equal pairs alike; unique ones drop out.

    Rows with one r1 are in one partition. A new rank is the old one plus the place among those of the old one, so the order
    of all ranks follows that of the passages' first words. last: gives the positions that aren't the first of their rank, and source, the document of the first, instead.
    Of a pair that goes on in the next batch only its first and its last row are kept.
    """

    def run(batches):
        rest, before = None, 0  # the rows that are kept, and the place of the first of them among those of its r1
        names = ["doc", "pos", "source"] if last else ["doc", "pos", "rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("r1", "r2", "doc", "pos")] + [np.zeros(batch.num_rows, dtype=bool)]
            r1, r2, doc, pos, done = own if rest is None else (np.concatenate(x) for x in zip(rest, own))
            n = len(r1)
            same1 = np.concatenate([[False], r1[1:] == r1[:-1]])
            same = same1 & np.concatenate([[False], r2[1:] == r2[:-1]])
            copy = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])])
            head = np.flatnonzero(~same)
            group = np.cumsum(~same) - 1
            several = (np.add.reduceat((~copy).astype(np.int64), head) > 1)[group]
            keep = several & ~copy & ~done
            place = np.arange(n) - np.maximum.accumulate(np.where(~same1, np.arange(n), 0))
            place[np.cumsum(~same1) == 1] += before
            if last:
                keep &= same
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep]), pa.array(doc[head[group]][keep])], names)
            else:
                rank = r1 + place[head[group]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep]), pa.array(rank[keep])], names)
            at = np.unique([head[-1], n - 1]) if several[-1] else head[-1:]
            rest, before = [x[at] for x in (r1, r2, doc, pos, np.full(n, several[-1]))], int(place[head[-1]])

    return df.mapInArrow(run, f"{_POSITION}, source long" if last else f"{_POSITION}, rank long")


def _rerank_hot(pairs: DataFrame, last: bool) -> DataFrame:
    """The same for pairs of which very many have one r1: by an aggregation, and with hashes of pairs, below 0, as ranks."""
    place = F.struct("doc", "pos")
    groups = pairs.groupBy("r1", "r2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    found = pairs.join(groups.select("r1", "r2", "first"), ["r1", "r2"])  # adaptive execution splits the hot ones
    if last:
        return found.where(place != F.col("first")).select("doc", "pos", F.col("first.doc").alias("source"))
    return found.select("doc", "pos", F.xxhash64("r1", "r2").bitwiseOR(F.lit(-(1 << 63)).cast("long")).alias("rank"))


def _numbered(df: DataFrame) -> DataFrame:
    """The pairs with their first rank as a place in the sorted order: partition and place of the first equal one."""

    def run(batches):
        base, place, before, value = TaskContext.get().partitionId() << 40, 0, None, 0
        for batch in batches:
            r1 = batch.column("r1").to_numpy()
            if not len(r1):
                continue
            new = np.concatenate([[before is None or r1[0] != before], r1[1:] != r1[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(r1)) + place, -1))
            at[at < 0] = value
            before, value, place = r1[-1], int(at[-1]), place + len(r1)
            yield pa.RecordBatch.from_arrays([pa.array(at + base), *(batch.column(c) for c in ("r2", "doc", "pos"))], ["r1", "r2", "doc", "pos"])

    return df.mapInArrow(run, _PAIR)


def _pairs(ranks: DataFrame, step: int, n: int) -> DataFrame:
    """The rank at each position with that at an offset in the same document, where there is one."""

    def run(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def paired(doc, pos, rank, stop: int):
            """The pairs of the rows before stop; their partners are looked for in all rows."""
            at = (np.cumsum(np.concatenate([[True], doc[1:] != doc[:-1]])) << 32) + pos
            there = np.minimum(np.searchsorted(at, at[:stop] + step), len(at) - 1)
            keep = at[there] == at[:stop] + step
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank[:stop][keep], rank[there[keep]], doc[:stop][keep], pos[:stop][keep])], ["r1", "r2", "doc", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos, rank = rest = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(rest, ("doc", "pos", "rank"))]
            first = int(np.searchsorted(doc, doc[-1]))
            stop = first + int(np.searchsorted(pos[first:], pos[-1] - step, side="right"))  # the partners of later ones may be in the next batch
            if stop:
                yield paired(doc, pos, rank, stop)
            rest = [x[stop:] for x in rest]
        if len(rest[0]):
            yield paired(*rest, len(rest[0]))

    return ranks.repartition(n, "doc").sortWithinPartitions("doc", "pos").mapInArrow(run, _PAIR)


def _merged(positions: DataFrame, words: int, n: int) -> DataFrame:
    """Joins overlapping repeated passages of a document that have one source."""

    def run(batches):
        names, span = ["doc", "start", "stop", "source"], None  # the span that may go on: document, start, last position, source
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos, source = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "pos", "source"))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (pos[1:] > pos[:-1] + words)])
            head = np.flatnonzero(new)
            columns = [doc[head], pos[head], pos[np.append(head[1:], len(doc)) - 1], source[head]]
            if span is not None:
                if span[0] == doc[0] and span[3] == source[0] and pos[0] <= span[2] + words:
                    columns[1][0] = span[1]
                else:
                    columns = [np.concatenate([[x], c]) for x, c in zip(span, columns)]
            span = [int(c[-1]) for c in columns]
            columns[2] = columns[2] + words
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in columns], names)
        if span is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (span[0], span[1], span[2] + words, span[3])], names)

    return positions.repartition(n, "doc").sortWithinPartitions("doc", "pos").mapInArrow(run, "doc long, start long, stop long, source long")


def _hot(rows: DataFrame, starts, total: int, hot: int) -> DataFrame | None:
    """The first ranks that more positions than the limit have, by a part of the documents; None if there are none."""
    if total <= hot:
        return None
    every = max(1, total // LOOKED)
    some = rows.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(every)) == 0).mapInArrow(starts, _PAIR)
    return some.groupBy("r1").count().where(F.col("count") * every > hot).select("r1")


def _spans(work: Workspace, docs: DataFrame, id_col: str, text_col: str, words: int, sent: int, hot: int) -> DataFrame:
    """(doc, start, stop, source, key) of passages(); key is the hash of the words that are meant if the id stands on several texts, else null."""
    spark = docs.sparkSession
    n, seed = partitions(spark), seed_of(words)
    about = work.store(outline(docs, id_col, text_col, words).where(F.col("words") >= words), "outline")
    one = about.groupBy("doc").agg(F.min(F.struct("key", "words")).alias("text"), F.max("key").alias("most"))
    one = work.store(one.select("doc", "text.*", (F.col("text.key") != F.col("most")).alias("several")), "documents")
    firsts = work.store(one.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "firsts")
    #: Documents that don't take part, or of which one of several texts does.
    other = work.store(one.join(if_small(firsts), "key", "left").where("several or first <> doc").select("doc", "key", "words", "several", "first", F.expr("coalesce(first <> doc, false)").alias("copy")), "others")
    runs = about.select("key", F.explode("picked").alias("run")).withColumn("twice", F.lit(False)).union(about.select("key", F.explode("again").alias("run")).withColumn("twice", F.lit(True)))
    repeated = work.store(runs.groupBy("run").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("twice").alias("twice")).where("a <> b or twice").select("run"), "repeated")

    rows = _ids(docs, id_col, text_col)
    known = None
    if repeated.limit(sent + 1).count() <= sent:
        known = spark.sparkContext.broadcast(np.sort(repeated.toPandas()["run"].to_numpy()))
        rows = rows.withColumn("runs", F.lit(None).cast("array<long>"))
    else:
        lists = about.select("doc", F.explode("picked").alias("run")).join(repeated, "run").groupBy("doc").agg(F.sort_array(F.collect_set("run")).alias("runs"))
        rows = rows.join(lists.withColumnRenamed("doc", "id"), "id")
    state = other.select(F.col("doc").alias("id"), "copy", F.when(F.col("several"), F.col("key")).alias("only"))
    rows = rows.join(if_small(state), "id", "left").select("id", "text", "runs", "copy", "only")

    def start(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pc.invert(pc.fill_null(part.column("copy"), False)))
                ids, lists, only = part.column("id").to_numpy(), part.column("runs"), part.column("only").to_pylist()
                found = _tokens(part.column("text"))
                columns = [[], [], [], []]
                for i, (a, b) in enumerate(zip(found.bounds, found.bounds[1:])):
                    h = found.hashes[a:b]
                    if b - a < words or only[i] is not None and _key(h) != only[i]:
                        continue
                    pos, r1, r2 = _starts(h, known.value if known is not None else lists[i].values.to_numpy(), words)
                    for column, x in zip(columns, (r1, r2, np.full(len(pos), ids[i]), pos)):
                        column.append(x)
                r1, r2, doc, pos = (np.concatenate([np.zeros(0, np.int64), *x]) for x in columns)
                yield pa.RecordBatch.from_arrays([pa.array(r1), pa.array(r2), pa.array(doc), pa.array(pos.astype(np.int32))], ["r1", "r2", "doc", "pos"])

    pairs = rows.mapInArrow(start, _PAIR)
    total = about.agg(F.sum("words")).first()[0] or 0
    frequent = _hot(rows, start, total, hot)
    several = None  # pairs whose first rank very many share
    if frequent is not None and not (frequent := work.store(frequent, "hot")).isEmpty():
        stored = work.store(pairs, "pairs")
        several = stored.join(if_small(frequent), "r1", "left_semi")
        pairs = stored.join(if_small(frequent), "r1", "left_anti")
    # the first ranks are evenly spread hashes: their upper bits are a range partition
    place = (F.shiftrightunsigned("r1", 40) * n / (1 << 24)).cast("int")
    pairs = _numbered(pairs.repartitionById(n, place).sortWithinPartitions("r1", "r2", "doc", "pos"))
    width, k = min(2 * seed, words), 0
    while width < words:
        ranks = _rerank(pairs, last=False)
        ranks = work.store(ranks if several is None else ranks.union(_rerank_hot(several, last=False)), f"ranks-{k}")
        step = min(width, words - width)
        pairs = _pairs(ranks, step, n)
        if several is not None:
            stored = work.store(pairs, f"pairs-{k}")
            pairs, several = stored.where("r1 >= 0"), stored.where("r1 < 0")
        pairs = pairs.repartition(n, "r1").sortWithinPartitions("r1", "r2", "doc", "pos")
        width, k = width + step, k + 1
    found = _rerank(pairs, last=True)
    found = work.store(found if several is None else found.union(_rerank_hot(several, last=True)), "found")
    work.drop(*(f"ranks-{j}" for j in range(k)))
    parts = work.store(_merged(found, words, n), "parts")
    texts = other.where("several").select("doc", "key")
    whole = other.where("copy").select("doc", F.lit(0).cast("long").alias("start"), F.col("words").alias("stop"), F.col("first").alias("source"), F.when(F.col("several"), F.col("key")).alias("key"))
    return parts.join(if_small(texts), "doc", "left").select("doc", "start", "stop", "source", "key").union(whole)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, sent: int = SENT, hot: int = HOT) -> DataFrame:
    """(doc_id, start, stop, source_id): runs of words, counted from 0, that repeat earlier passages of at least so many words.

    Earlier is by document id, then place. Passages that overlap or touch are one row if the first document that has them, source_id, is the same; it can
    be the document itself. Documents of fewer words, null and empty texts and rows without an id have no row, and an empty table gives none. Rows with the same id and words are one
    document; of rows with the same id and other words, those with the least hash of their words count. A text may be of any length. Other columns aren't looked at.
    """
    work = Workspace(docs.sparkSession, "suffix")
    return _spans(work, docs, id_col, text_col, words, sent, hot).select(F.col("doc").alias(id_col), "start", "stop", F.col("source").alias("source_id"))


def _free(names: list[str], wanted: str) -> str:
    """A name like the wanted one that none of the columns has."""
    taken = {x.lower() for x in names}
    while wanted in taken:
        wanted += "_"
    return wanted


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents without the passages that repeat earlier ones; those of which no word is left go, others and their columns stay.

    Rows without an id, and null, empty and short texts, stay as they are; rows that repeat an id and its words are cut alike, so their first copy stays in each; of rows with one id and
    other words, only those that passages() speaks of are cut. Columns may have any names. An empty table gives no row.
    """
    work, names = Workspace(docs.sparkSession, "suffix-cut"), docs.columns
    at_, id_, key_ = (_free(names, x) for x in ("cut_spans", "cut_id", "cut_key"))
    spans = work.store(_spans(work, docs, id_col, text_col, words, SENT, HOT), "spans")
    lists = work.store(spans.groupBy(F.col("doc").alias(id_)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(at_), F.min("key").alias(key_)), "lists")
    joined = docs.join(if_small(lists), docs[id_col].cast("long") == lists[id_], "left").drop(id_)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                marks, keys = part.column(at_), part.column(key_).to_pylist()
                at = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False) & part.column(text_col).is_valid().to_numpy(zero_copy_only=False))
                keep = np.ones(part.num_rows, dtype=bool)
                texts = part.column(text_col)
                if len(at):
                    found = _tokens(texts.take(pa.array(at)))
                    values = texts.to_pylist()
                    for k, i in enumerate(at):
                        a, b = found.bounds[k], found.bounds[k + 1]
                        if keys[i] is None or keys[i] == _key(found.hashes[a:b]):
                            values[i], left = _without(values[i].encode(), found.start[a:b], found.end[a:b], marks[int(i)].as_py())
                            keep[i] = left
                    texts = pa.array(values, texts.type)
                out = [texts if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)


def _without(raw: bytes, start: np.ndarray, end: np.ndarray, spans: list[dict]) -> tuple[str, bool]:
    """A text without the given runs of words and what lies between those, and whether a word is left. Runs are ordered and may overlap."""
    parts, at, done, left = [], 0, 0, len(start)
    for x in spans:
        a, b = max(x["start"], done), min(x["stop"], len(start))
        if a >= b:
            continue
        if a > done or not done:  # what lies between runs that touch goes, too
            parts.append(raw[at : start[a]])
        at, done, left = int(end[b - 1]), b, left - (b - a)
    return b"".join([*parts, raw[at:]]).decode("utf-8", "replace"), left > 0
