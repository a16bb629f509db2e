"""Near-duplicate documents: SimHash signatures, found by random bit sampling.

signatures: each document's distinct words and word pairs vote on the bits of a 256-bit signature.
groups: equal signatures are merged first. Then several hash tables each group the signatures by
sampled coordinates; the number of coordinates follows from the number of signatures, and a bucket
beyond the cap is split by further sampled coordinates, in several ways again. All pairs within a bucket are compared, and those
within the distance are linked; connected signatures form a group. There are as many tables as it takes to find a pair at
the largest distance with the wanted recall; nearer pairs are found more surely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import Workspace, if_small, without
from quarry.llm.tokens import grams, mix, slices, tokenize

BITS = 256
#: Signatures at most so many bits apart are near duplicates. Unrelated documents of one language are from 60 bits on apart, most about 120.
DISTANCE = 50
#: Of pairs at just this distance, the part that some table puts into one bucket; nearer ones are surer still.
RECALL = 0.95
#: Signatures of a bucket beyond which further coordinates are sampled, and how many a bucket should have on average.
CAP, TARGET = 8192, 2048
_SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_WORDS = [f"s{k}" for k in range(BITS // 64)]


def sign(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the rows as 64-bit words, and the number of features of each; a row without a word has none."""
    found = tokenize(column, scripts=True)
    n = len(found.bounds) - 1
    out, counts = np.zeros((n, BITS), dtype=bool), np.zeros(n, dtype=np.int64)
    for i in range(n):
        words = found.hashes[found.bounds[i] : found.bounds[i + 1]]
        features = np.unique(np.concatenate([words, grams(words, 2)]))
        counts[i] = len(features)
        votes = np.zeros(BITS, dtype=np.int64)
        for k in range(0, len(features), 1 << 14):
            part = features[k : k + (1 << 14)]
            bits = np.unpackbits(np.stack([mix(part ^ s) for s in _SEEDS], axis=1).view(np.uint8), axis=1)
            votes += bits.sum(axis=0, dtype=np.int32)
        out[i] = 2 * votes > len(features)
    return np.packbits(out, axis=1).view(np.uint64), counts


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0..s3) of the documents that have a word and an id; the others are near duplicates of nothing."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, counts = sign(part.column("text"))
                some = counts > 0
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(some)), *(pa.array(words[some, k].view(np.int64)) for k in range(BITS // 64))], ["id", *_WORDS])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return chosen.mapInArrow(run, "id long, " + ", ".join(f"{w} long" for w in _WORDS))


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)


def near_pairs(words: np.ndarray, distance: int = DISTANCE, block: int = 256):
    """Pairs i < j of signatures within the distance, every pair compared, in blocks of rows; by half of the words first, which leaves few."""
    n, half = len(words), words.shape[1] // 2
    columns = [np.ascontiguousarray(words[:, k]) for k in range(words.shape[1])]
    for a in range(0, n, block):
        far = np.bitwise_count(columns[0][a : a + block, None] ^ columns[0][None, a:])
        for c in columns[1:half]:
            far += np.bitwise_count(c[a : a + block, None] ^ c[None, a:])
        i, j = np.nonzero(far <= distance)
        keep = i < j
        i, j = i[keep] + a, j[keep] + a
        exact = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.uint16) for c in columns)
        near = exact <= distance
        yield i[near], j[near]


def _linked(ids: np.ndarray, words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows of a bucket just as all its near pairs do: each row with its component's least id."""
    order = np.argsort(ids, kind="stable")
    ids, words = ids[order], words[order]
    label = np.arange(len(ids))
    pairs = [np.concatenate(x) for x in zip(*near_pairs(words, distance))] if len(ids) > 1 else [np.zeros(0, np.int64)] * 2
    i, j = pairs
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[new[label]]
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _reached(rows: np.ndarray, others: np.ndarray, distance: int, block: int = 512) -> np.ndarray:
    """Which rows are within the distance of some of the others."""
    out = np.zeros(len(rows), dtype=bool)
    for a in range(0, len(rows), block):
        for b in range(0, len(others), 8 * block):
            far = np.zeros((len(rows[a : a + block]), len(others[b : b + 8 * block])), dtype=np.uint16)
            for k in range(rows.shape[1]):
                far += np.bitwise_count(rows[a : a + block, k, None] ^ others[None, b : b + 8 * block, k])
            out[a : a + block] |= (far <= distance).any(axis=1)
    return out


def _bucket(ids: np.ndarray, words: np.ndarray, distance: int, recall: float, cap: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a bucket. Up to the cap all pairs are compared.

    Beyond it, first the rows near to one row are linked and taken out while they are many: they are connected whatever their other
    pairs are, so that only those that are left are compared with them, each. What is left above the cap is
    sampled by additional coordinates, in so many tables as reach the recall.
    """
    edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(ids) > cap:
        pivots = rng.choice(len(ids), 8, replace=False)
        near = [np.bitwise_count(words ^ words[p]).sum(axis=1) <= distance for p in pivots]
        most = max(near, key=np.count_nonzero)
        if np.count_nonzero(most) < max(16, len(ids) // 64):
            break
        least = ids[most].min()
        joined = most | False
        joined[~most] = _reached(words[~most], words[most], distance)
        edges.append((ids[most], np.full(np.count_nonzero(most), least)))
        touched = joined & ~most
        edges.append((ids[touched], np.full(np.count_nonzero(touched), least)))
        ids, words = ids[~most], words[~most]
    if len(ids) <= cap:
        edges.append(_linked(ids, words, distance))
    else:
        more, tables = plan(len(ids), distance, recall)
        bits = _unpacked(words)
        for _ in range(tables):
            chosen = rng.permutation(BITS)[:more]
            key = np.packbits(bits[:, chosen], axis=1)
            _, part = np.unique(key, axis=0, return_inverse=True)
            order = np.argsort(part.ravel(), kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(part.ravel()[order])) + 1):
                edges.append(_linked(ids[rows], words[rows], distance))
    a, b = (np.concatenate(x) for x in zip(*edges))
    return a[a != b], b[a != b]


def plan(count: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """Coordinates of a bucket, so that it has about TARGET of so many signatures, and tables, so that the recall is reached."""
    first = max(0, math.ceil(math.log2(max(1, count) / TARGET)))
    agree = math.prod((BITS - distance - k) / (BITS - k) for k in range(first))
    return first, 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def links(sigs: DataFrame, count: int, distance: int = DISTANCE, recall: float = RECALL, cap: int = CAP, seed: int = 7) -> DataFrame:
    """(a, b): edges between near signatures. sigs: id, s0..s3 with distinct signatures, count of them."""
    first, tables = plan(count, distance, recall)
    chosen = [np.random.default_rng((seed, t)).permutation(BITS) for t in range(tables)]

    def key(t: int):
        parts = [F.shiftleft(F.shiftright(F.col(_WORDS[c // 64]), int(8 * (c % 64 // 8) + 7 - c % 8)).bitwiseAND(1), k) for k, c in enumerate(chosen[t][:first])]
        total = F.lit(0).cast("long")
        for p in parts:
            total = total.bitwiseOR(p)
        return F.struct(F.lit(t).alias("t"), total.alias("key"))

    def run(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        ids = table.column("id").to_numpy()
        words = np.stack([table.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
        a, b = _bucket(ids, words, distance, recall, cap, np.random.default_rng((seed, tables + t)))
        return pa.table({"a": a, "b": b})

    keyed = sigs.select("id", *_WORDS, F.explode(F.array(*(key(t) for t in range(tables)))).alias("at")).select("id", *_WORDS, "at.t", "at.key")
    return keyed.groupBy("t", "key").applyInArrow(run, "a long, b long")


def _groups(work: Workspace, docs: DataFrame, id_col: str, text_col: str, distance: int, recall: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of groups(), and the ids that stand on several rows with a word."""
    sigs = work.store(signatures(docs, id_col, text_col), "signatures")
    again = work.store(sigs.groupBy("id").count().where("count > 1").select("id"), "again")
    merged = work.store(sigs.groupBy(*_WORDS).agg(F.min("id").alias("id")), "distinct")
    near = work.store(links(merged, merged.count(), distance, recall, cap).distinct(), "near")
    same = sigs.join(merged.withColumnRenamed("id", "least"), _WORDS).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    found = components(near.union(same), work)
    work.drop("near", "signatures", "distinct")
    return found, again


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, recall: float = RECALL, cap: int = CAP) -> DataFrame:
    """(group_id, doc_id, keep) of every document in a group of two or more; the one with the least id is kept and names the group.

    Null and empty texts and texts without a word are in no group, neither are rows whose id is null; an empty table gives no row.
    Rows that repeat an id are one document; a document alone in its group has no row. A text may be of any length. Other columns aren't looked at.

    While no bucket has more signatures than the cap and there are at most TARGET, every pair within the distance is found; beyond, a pair at just the distance is found with a probability
    of recall at least, nearer ones more surely, and links over other members of a group add to that.
    """
    found, _ = _groups(Workspace(docs.sparkSession, "simhash"), docs, id_col, text_col, distance, recall, cap)
    return found.select(F.col("root").alias("group_id"), F.col("node").alias(id_col), (F.col("node") == F.col("root")).alias("keep"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, recall: float = RECALL, cap: int = CAP) -> DataFrame:
    """The documents without those that groups() doesn't keep; documents in no group stay as they are, with all their columns.

    Of rows that repeat an id and a text with a word one stays, any of them. Rows without an id, and null, empty and wordless texts, stay. An empty table stays empty.
    """
    work = Workspace(docs.sparkSession, "simhash-drop")
    found, again = _groups(work, docs, id_col, text_col, distance, recall, cap)
    gone = work.store(found.where("node <> root").select(F.col("node").alias(id_col)), "gone")
    kept = without(docs, gone, id_col)
    if again.isEmpty():
        return kept
    again = again.withColumnRenamed("id", id_col)
    several = docs.select("*").join(if_small(without(again, gone, id_col)), id_col, "left_semi").select(docs.columns).dropDuplicates([id_col, text_col])
    return without(kept, again, id_col).union(several)
