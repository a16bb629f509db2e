"""Keys with values and scores: exact search, prefix search, and completion by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import broadcast_if_small


def upsert(entries: DataFrame, order_col: str = "seq") -> DataFrame:
    """One row for each key: the one with the greatest order, with all its columns. Empty and null keys are left out."""
    rest = [c for c in entries.columns if c not in ("key", order_col)]
    last = entries.where("key <> ''").groupBy("key").agg(F.max_by(F.struct(*rest), order_col).alias("_last"))
    return last.select("key", *(F.col("_last")[c].alias(c) for c in rest))


def find(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys asked for with their values; null for those that aren't there."""
    return keys.join(terms, "key", "left")


def prefix(terms: DataFrame, start: str, limit: int | None = None) -> DataFrame:
    """Keys that begin so, themselves included, in order; a literal prefix reaches the scan."""
    found = terms.where(F.col("key").startswith(start)).orderBy("key")
    return found if limit is None else found.limit(limit)


def complete(terms: DataFrame, start: str, k: int = 10) -> DataFrame:
    """The k keys of the greatest score that begin so."""
    return terms.where(F.col("key").startswith(start)).orderBy(F.desc("score"), "key").limit(k)


def complete_all(terms: DataFrame, prefixes: DataFrame, k: int = 10) -> DataFrame:
    """(prefix, rank, key, score): the k best keys of each prefix.

    Keys and prefixes meet by the leading characters that the shortest prefixes have, one equi-join for each length that occurs.
    """
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    parts = None
    for n in lengths:
        own = prefixes.where(F.length("prefix") == n)
        found = terms.withColumn("prefix", F.substring("key", 1, n)).where(F.length("key") >= n).join(broadcast_if_small(own), "prefix")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = terms.withColumn("prefix", F.lit("")).limit(0)
    order = Window.partitionBy("prefix").orderBy(F.desc("score"), "key")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("prefix", "rank", "key", "score")


def character_ranks(words: DataFrame, col: str = "key", most: int = 54) -> DataFrame:
    """(ch, weight, rank) of the ASCII characters of words, each weighted by its distance from the word's end; the most frequent are ranked from 1, others have 0."""
    chars = words.select(F.length(col).alias("n"), F.posexplode(F.split(F.col(col), "")).alias("i", "ch")).where("ch <> ''")
    weights = chars.groupBy("ch").agg(F.sum((F.col("n") - F.col("i")).cast("long")).alias("weight"))
    place = F.row_number().over(Window.orderBy(F.desc("weight"), "ch"))  # one row for each character that occurs
    return weights.withColumn("place", place).select("ch", "weight", F.when(F.col("place") <= most, F.col("place")).otherwise(0).alias("rank"))


def common_prefix(a, b):
    """The length of the longest common beginning of two texts."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


class Terms:
    """A map of keys to values that is filled from memory and asked one key at a time."""

    def __init__(self, spark):
        self.spark, self._rows, self._table = spark, [], None

    def insert(self, key: str | bytes, value: int, score: float = 0.0) -> None:
        if isinstance(key, bytes):
            key = key.decode()
        if not isinstance(key, str):
            raise TypeError("keys are text or bytes")
        self._rows.append((key, int(value), float(score), len(self._rows)))
        self._table = None

    @property
    def table(self) -> DataFrame:
        if self._table is None:
            self._table = upsert(self.spark.createDataFrame(self._rows, "key string, value long, score double, seq long"))
        return self._table

    def find(self, key: str | bytes) -> int | None:
        key = key.decode() if isinstance(key, bytes) else key
        if not isinstance(key, str):
            raise TypeError("keys are text or bytes")
        row = self.table.where(F.col("key") == key).first()
        return None if row is None else row["value"]

    def prefix(self, start: str, limit: int = 10) -> list[tuple[str, int]]:
        return [(r["key"], r["value"]) for r in prefix(self.table, start, limit).collect()]

    def complete(self, start: str, k: int = 10) -> list[tuple[str, int, float]]:
        return [(r["key"], r["value"], r["score"]) for r in complete(self.table, start, k).collect()]

    def __len__(self) -> int:
        return self.table.count()
