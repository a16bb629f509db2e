"""Tables of a session in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def close() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before
            pass

    atexit.register(close)
    return path


#: Bytes of rows up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def _size(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_size(value[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        if (one := _least(kind.elementType)) and not _varies(kind.elementType):
            return F.coalesce(F.size(value), F.lit(0)).cast("long") * one + 24
        inner = F.aggregate(value, F.lit(24).cast("long"), lambda total, x: total + _size(x, kind.elementType))
        return F.coalesce(inner, F.lit(24).cast("long"))
    if isinstance(kind, T.MapType):
        return _size(F.map_keys(value), T.ArrayType(kind.keyType)) + _size(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def _varies(kind: T.DataType) -> bool:
    return any(map(_varies, (f.dataType for f in kind))) if isinstance(kind, T.StructType) else isinstance(kind, T.StringType | T.BinaryType | T.ArrayType | T.MapType)


def _least(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 8 + sum(_least(f.dataType) for f in kind)
    return 24 if isinstance(kind, T.ArrayType | T.MapType) else 16 if isinstance(kind, T.StringType | T.BinaryType) else 8


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows take no more bytes than the limit; no more rows are looked at than could."""
    most = limit // _least(df.schema) + 1
    total = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8).cast("long"))
    rows, size = df.limit(most).select(total.alias("size")).agg(F.count("*"), F.sum("size")).first()
    return rows < most and (size or 0) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table marked for broadcast, if measuring it up to the limit in bytes shows that it is small; Spark decides otherwise. A costly table should be stored before."""
    return F.broadcast(df) if is_small(df, limit) else df


def small_parts(df: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The table in parts, by a hash of the key, none of which is larger than the limit by expectation, each marked for broadcast. It is stored first if there are several."""
    if is_small(df, limit):
        return [F.broadcast(df)]
    spark, path = df.sparkSession, new_folder(df.sparkSession, "parts")
    total = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8).cast("long"))
    n = -(-2 * (df.select(total.alias("size")).agg(F.sum("size")).first()[0] or 0) // max(1, limit))
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n))).repartition("part").write.partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    return [F.broadcast(stored.where(F.col("part") == k).select(df.columns)) for k in range(n)]


#: Bytes of a stored table for each task where the work of a task takes many times their size in memory; and the least that is worth one.
TASK_BYTES, LEAST_BYTES = 4 << 20, 64 << 10


def stored_bytes(df: DataFrame) -> int | None:
    """The bytes of the files and other sources that a table comes from, whatever is made of them; None if Spark doesn't know. Nothing runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else None


def placed(df: DataFrame, *keys: str, each: int = TASK_BYTES) -> DataFrame:
    """The table shuffled by keys into so many tasks that each gets about so many bytes of the stored table, however large it is and whatever the session's settings; Spark decides if the size isn't known."""
    size = stored_bytes(df)
    if size is None:
        return df.repartition(*keys)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-size // each), min(cores, size // LEAST_BYTES)), *keys)


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many tasks as there are cores. Only one of fewer tasks, which is small, is shuffled; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
