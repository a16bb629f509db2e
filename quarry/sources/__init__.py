"""Records from files and from memory, as DataFrames of strings with an ordinal id."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.storage import new_folder

__all__ = ["documents", "free_name", "headers", "read", "read_csv", "read_json", "read_parquet", "resolve", "with_ids", "write_csv", "write_json"]


def read_csv(spark: SparkSession, path: str, nulls: bool = False) -> DataFrame:
    """CSV with a header: quoted fields may hold commas, line ends and doubled quotes. Every column is text; an empty field is empty text, or null if nulls are asked for and it isn't quoted.

    Where more than one task could read the files, their lines are looked at first: if each has an even number of quotes, no field holds a line end,
    and the files are split; else each file is one task's, and its records are spread over all tasks.
    """
    own = {"header": True, "quote": '"', "escape": '"', "inferSchema": False, "mode": "PERMISSIVE"}
    if nulls:  # an empty field that isn't quoted is read as this value, which then is null
        own["nullValue"] = uuid.uuid4().hex
    lines = spark.read.text(path)
    one = lines.rdd.getNumPartitions() <= 1
    split = not one and lines.where(F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1).isEmpty()
    df = spark.read.options(multiLine=not split, **own).csv(path)
    df = df if split or one else df.repartition(spark.sparkContext.defaultParallelism)
    return df if nulls else df.na.fill("")


def read_json(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A JSON object in each line. Without columns they are found by reading the file once; values that aren't text are read as text, null as empty."""
    reader = spark.read.option("primitivesAsString", True)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.json(path).na.fill("")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its extension."""
    for ends, reader in (((".csv",), read_csv), ((".json", ".jsonl"), read_json), ((".parquet",), read_parquet)):
        if path.rstrip("/").lower().endswith(ends):
            return reader(spark, path)
    raise ValueError(f"{path}: only csv, json, jsonl and parquet can be read")


def headers(spark: SparkSession, path: str) -> list[str]:
    """The columns of a file, and score."""
    return [*read(spark, path).columns, "score"]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv() gives back as it was, blanks around a text and empty texts included. Null is an empty field without quotes; in a table of one column, where that would be no line, it is empty text."""
    df.write.mode("overwrite").options(header=True, quoteAll=len(df.columns) == 1, quote='"', escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A name like the wanted one that no column has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows numbered from 0 in the order of the input, in a first column whose name no other column may have.

    The rows are stored with their places first, so that a plan that gives them in another order when it runs again can't number one twice; one small job counts the rows of each
    partition, and nothing is shuffled.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    spark, at = df.sparkSession, free_name([*df.columns, name], "at")
    path = new_folder(spark, "rows")
    df.withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.shiftright(at, 33)
    counts = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total)]
        total += counts[p]
    base = F.create_map(*before)[part] if before else F.lit(0)
    return stored.select((base + F.col(at).bitwiseAND((1 << 33) - 1)).cast("long").alias(name), *(F.col(f"`{c}`") for c in df.columns))


def documents(spark: SparkSession, records: Any, name: str = "doc_id") -> DataFrame:
    """A DataFrame with ordinal ids of a list of texts, of tuples or lists of fields, or of dicts (columns by name), or of a pandas or polars frame or series.

    None becomes empty text. Fields without a name are called field0, field1 and so on, or text if there is one. No record is an error.
    """
    if isinstance(records, DataFrame):
        return with_ids(records, name)
    if hasattr(records, "to_pandas"):
        records = records.to_pandas()
    if hasattr(records, "to_frame") and not hasattr(records, "columns"):
        records = records.to_frame(records.name if isinstance(records.name, str) and records.name else "text")
    if hasattr(records, "columns"):
        columns = [str(c) for c in records.columns]
        rows = [tuple(None if v != v else v for v in r) for r in records.itertuples(index=False, name=None)]
    else:
        rows = list(records)
        if not rows:
            raise ValueError("there are no documents")
        if isinstance(rows[0], dict):
            columns = sorted({str(k) for r in rows for k in r})
            rows = [tuple(r.get(c) for c in columns) for r in rows]
        elif isinstance(rows[0], list | tuple):
            columns = ["text"] if len(rows[0]) == 1 else [f"field{k}" for k in range(len(rows[0]))]
            if any(len(r) != len(columns) for r in rows):
                raise ValueError("documents have different numbers of fields")
        else:
            columns, rows = ["text"], [(r,) for r in rows]
    if not rows:
        raise ValueError("there are no documents")
    schema = T.StructType([T.StructField(name, T.LongType(), False), *(T.StructField(c, T.StringType(), False) for c in columns)])
    return spark.createDataFrame([(i, *("" if v is None else str(v) for v in r)) for i, r in enumerate(rows)], schema)


def resolve(df: DataFrame, fields: Sequence[str]) -> list[str]:
    """The table's own names of fields, in any case, in the table's order; unknown ones are left out, but one must be known."""
    wanted = {f.lower() for f in fields}
    found = [c for c in df.columns if c.lower() in wanted]
    if not found:
        raise ValueError(f"none of the fields {', '.join(fields)} is in the table")
    return found
