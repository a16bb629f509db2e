"""Tables in the folder that all executors share, and joins with tables that may be small."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarry.storage import BROADCAST_BYTES
from quarry.storage import broadcast_if_small as if_small
from quarry.storage import remove as delete
from quarry.storage import shared_folder as folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by the shared folder, once in an application, so that it need not be installed there."""
    if spark.sparkContext.applicationId in _shipped:
        return
    home, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    path = f"{folder(spark)}/{home.name}-{uuid.uuid4().hex}.zip"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(path)
    atexit.register(_gone, spark, path)
    _shipped.add(spark.sparkContext.applicationId)


def _gone(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended before
        pass


class Workspace:
    """Tables of one run. They outlive lost executors; what is no longer needed is dropped at once, the rest when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_gone, spark, self.path)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, ids: DataFrame, id_col: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows whose id isn't among the ids; a null id stays."""
    return docs.join(if_small(ids.select(id_col), limit), id_col, "left_anti").select(docs.columns)
