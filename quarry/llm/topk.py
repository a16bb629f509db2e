"""Exact top-k search by inner product of a set of queries, against all vectors.

Vectors are rotated by the singular vectors of the whole table, so that the first coordinates hold most of the products, and cut
into blocks by descending length. A block of queries meets blocks of vectors: what a query can reach at most is, by
Cauchy-Schwarz, its length times the block's; then the partial product of the first coordinates plus the product of the
lengths of the rests; only pairs that may still be among the k best are multiplied in full.

The longest vectors, of a bounded size, are sent to all queries first, which gives each a score that its k best have at least.
Then the queries go to the vectors, block by block of a bounded size, those that need like lengths together: files and row groups of vectors
too short for all of a block aren't read, and each task keeps its k best of each query before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace

K = 10
#: Digits of a score, and the part of the squared lengths that the first coordinates hold at least.
DIGITS, ENERGY = 6, 0.8
#: Bytes of a block of vectors or queries, of the longest vectors that are sent to all queries, of the queries that are sent to all vectors at once, and of a file of vectors.
BLOCK, LONGEST, SENT, FILE = 1 << 20, 16 << 20, 64 << 20, 128 << 20
#: Half a step of rounding on either side, and the error of a sum of products for each element, relative to the lengths.
_STEP, _ERROR = 10.0**-DIGITS, 2.0**-50


def _cleaned(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(fine).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """The singular vectors of the table by falling value, and how many of them hold the wanted part of its squares."""

    def partial(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"row": table.column("row")[:1], "sums": pa.array([np.sum(np.stack(table.column("sums").to_numpy()), axis=0)], pa.list_(pa.float64()))})

    sums = rows.select("v").mapInArrow(partial, "row long, sums array<double>").groupBy("row").applyInArrow(add, "row long, sums array<double>").toPandas()
    gram = np.stack(sums.sort_values("row")["sums"].to_list())
    values, axes = np.linalg.eigh(gram)
    axes, values = axes[:, ::-1], np.maximum(values[::-1], 0)
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    return axes, min(int(np.searchsorted(held, ENERGY)) + 1, dim)


def _rotated(x: np.ndarray, axes: np.ndarray, head: int) -> np.ndarray:
    """For each vector its length, the length of its rest, and the vector in the new axes."""
    turned = x @ axes
    return np.concatenate([np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((turned[:, head:] ** 2).sum(axis=1))[:, None], turned], axis=1)


def _blocks(rows: DataFrame, axes: np.ndarray, head: int, n: int, size: int) -> DataFrame:
    """(block, most, ids, data): blocks of vectors by falling length; most is the length of the longest."""
    dim = len(axes)

    def run(batches):
        part, kept, made = TaskContext.get().partitionId(), [], 0

        def block(x: np.ndarray, ids: np.ndarray):
            data = _rotated(x, axes, head)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in ((part << 32) + made, float(data[:, 0].max()), ids.tobytes(), data.tobytes())], ["block", "most", "ids", "data"])

        for batch in batches:
            kept.append((_matrix(batch.column("v"), dim), batch.column("id").to_numpy()))
            x, ids = (np.concatenate(c) for c in zip(*kept))
            while len(ids) >= size:
                yield block(x[:size], ids[:size])
                made, x, ids = made + 1, x[size:], ids[size:]
            kept = [(x, ids)]
        if kept and len(kept[0][1]):
            yield block(*kept[0])

    ordered = rows.withColumn("l", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).repartitionByRange(n, F.desc("l"), "id").sortWithinPartitions(F.desc("l"), "id")
    return ordered.select("id", "v").mapInArrow(run, "block long, most double, ids binary, data binary")


class Best:
    """The best pairs so far of a block of queries: query, id, score; and each query's k-th score, below which none is needed."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, least: np.ndarray, head: int):
        self.ids, self.data, self.k, self.least, self.head = ids, data, k, least.copy(), head
        self.rows, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.error = _ERROR * (data.shape[1] - 2)

    def _add(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        other = self.ids[rows] != found
        self.rows, self.found, self.scores = (np.concatenate(x) for x in ((self.rows, rows[other]), (self.found, found[other]), (self.scores, scores[other])))
        rounded = np.round(self.scores, DIGITS)
        order = np.lexsort((self.found, -rounded, self.rows))
        rows = self.rows[order]
        head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(head, np.diff(np.append(head, len(rows))))
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[self.rows[last]] = np.maximum(self.least[self.rows[last]], np.round(self.scores[last], DIGITS))
        self.rows, self.found, self.scores = self.rows[keep], self.found[keep], self.scores[keep]

    def meet(self, others: np.ndarray, x: np.ndarray) -> None:
        """Takes what the block of vectors has for the queries."""
        q, head = self.data, self.head
        most = x[:, 0].max()
        floor = self.least - _STEP - self.error * q[:, 0] * most  # what a computed bound has at least if the pair is needed
        rows = np.flatnonzero(q[:, 0] * most >= floor)
        if not len(rows):
            return
        bound = q[rows, 2 : 2 + head] @ x[:, 2 : 2 + head].T
        bound += q[rows, 1, None] * x[None, :, 1]
        i, j = np.nonzero(bound >= floor[rows, None])
        if not len(i):
            return
        if len(i) > 0.05 * bound.size:
            full = q[rows, 2:] @ x[:, 2:].T
            low = floor[rows]
            if len(others) > self.k:  # the k-th of this block alone is a bound too; one more, for a vector meets itself
                low = np.maximum(low, np.partition(full, -self.k - 1, axis=1)[:, -self.k - 1] - _STEP - self.error * q[rows, 0] * most)
            i, j = np.nonzero(full >= low[:, None])
            scores = full[i, j]
        else:
            scores = np.einsum("ij,ij->i", q[rows[i], 2:], x[j, 2:])
        self._add(rows[i], others[j], scores)

    def need(self) -> np.ndarray:
        """The length below which each query needs no vector."""
        length, low = self.data[:, 0], self.least - _STEP
        return np.where(length > 0, low / np.maximum(length * (1 + self.error), 1e-300), np.where(low <= 0, -np.inf, np.inf))


def _read(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=np.float64).reshape(-1, width)


def _asked(rows: DataFrame, longest: list, axes: np.ndarray, head: int, k: int, size: int) -> DataFrame:
    """(id, need, least, data) of each query: its vector in the new axes, the k-th score among the longest vectors, and the length that this asks of others."""
    sent = rows.sparkSession.sparkContext.broadcast(longest)
    dim = len(axes)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("id").to_numpy()
                best = Best(ids, _rotated(_matrix(part.column("v"), dim), axes, head), k, np.full(len(ids), -np.inf), head)
                for others, data in sent.value:
                    best.meet(*_read(others, data, dim + 2))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best.need()), pa.array(best.least), pa.array([x.tobytes() for x in best.data], pa.binary())], ["id", "need", "least", "data"])

    return rows.mapInArrow(run, "id long, need double, least double, data binary")


def _grouped(asked: DataFrame, n: int, size: int) -> DataFrame:
    """(part, need, ids, least, data): blocks of queries that need like lengths."""

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows = batch.slice(at, size)
                values = base + made, min(rows.column("need").to_pylist()), rows.column("id").to_numpy().tobytes(), rows.column("least").to_numpy().tobytes(), b"".join(rows.column("data").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], ["part", "need", "ids", "least", "data"])
                made += 1

    return asked.repartitionByRange(n, F.desc("need"), "id").sortWithinPartitions(F.desc("need"), "id").mapInArrow(run, "part long, need double, ids binary, least binary, data binary")


def _met(blocks: DataFrame, queries: list, k: int, head: int, width: int) -> DataFrame:
    """(id, other, score): the k best of each query in each task's vectors."""
    sent = blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        bests = [Best(*_read(ids, data, width), k, np.frombuffer(least), head) for ids, least, data in sent.value]
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data")):
                block = _read(ids.as_py(), data.as_py(), width)
                for best in bests:
                    best.meet(*block)
        for best in bests:
            if len(best.rows):
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.rows]), pa.array(best.found), pa.array(best.scores)], ["id", "other", "score"])

    return blocks.select("ids", "data").mapInArrow(run, "id long, other long, score double")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, queries: Column | None = None, block: int = BLOCK, longest: int = LONGEST, sent: int = SENT) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): for every query its k best others by inner product, by score rounded to DIGITS digits, then id.

    queries is a condition on the id column that names the vectors which are queries; without it all are. Those of a query are all vectors of
    its own number of elements but itself. Rows with a null id, a null or empty vector, or one with a null or
    infinite element are left out. Rows that repeat an id are one vector, the least of them. A query has fewer rows where there are fewer others; an empty table
    gives none. Equal scores are ranked by id. Other columns aren't looked at. block, longest and sent are bounds in bytes; they change no result.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    all_rows = work.store(_cleaned(vectors, id_col, vector_col), "rows")
    chosen = F.lit(True) if queries is None else queries
    found = None
    for dim, count in sorted(tuple(r) for r in all_rows.groupBy(F.size("v")).count().collect()):
        rows, width, name = all_rows.where(F.size("v") == dim), dim + 2, str(dim)
        size = max(1, block // (8 * width))
        asking = rows.withColumnRenamed("id", id_col).where(chosen).withColumnRenamed(id_col, "id").select("id", "v")
        number = asking.count()
        if not number or count < 2:
            continue
        axes, head = rotation(rows, dim)
        files = max(-(-count * 8 * width // FILE), min(spark.sparkContext.defaultParallelism, -(-count // size)))
        blocks = work.store(_blocks(rows, axes, head, files, size), f"blocks-{name}")
        first = blocks.orderBy(F.desc("most"), "block").limit(max(1, longest // block)).select("ids", "data").collect()
        asked = work.store(_asked(asking, [tuple(r) for r in first], axes, head, k, size), f"asked-{name}")
        parts = work.store(_grouped(asked, max(1, number * 8 * width // sent), size), f"queries-{name}")
        order = parts.select("part", "need").orderBy(F.desc("need"), "part").collect()
        together = max(1, sent // block)
        for at in range(0, len(order), together):
            some = order[at : at + together]
            given = parts.where(F.col("part").isin([r["part"] for r in some])).select("ids", "least", "data").collect()
            met = work.store(_met(blocks.where(F.col("most") >= min(r["need"] for r in some)), [tuple(map(bytes, r)) for r in given], k, head, width), f"found-{name}-{at}")
            found = met if found is None else found.union(met)
    work.drop("rows")
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` long, rank int, neighbor_id long, score double")
    scored = found.select(F.col("id").alias(id_col), F.col("other").alias("neighbor_id"), F.round("score", DIGITS).alias("score"))
    ranking = Window.partitionBy(id_col).orderBy(F.desc("score"), "neighbor_id")
    return scored.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k).select(id_col, "rank", "neighbor_id", (F.col("score") + 0.0).alias("score"))


def oracle(k: int = K, every: int = 50) -> str:
    return f"""
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), {DIGITS}) + 0.0 AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM pairs)
SELECT vec_id, rank::INT AS rank, neighbor_id, score FROM ranked WHERE rank <= {k}"""
