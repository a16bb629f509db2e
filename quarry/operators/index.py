"""The inverted index as DataFrames.

postings    field, term, doc_id, tf, first_pos, dl, bucket
dictionary  field, term, df, bucket
lengths     field, doc_id, dl
stats       field, num_docs, avgdl, num_terms, num_postings, num_tokens

A saved index is partitioned by bucket, a hash of the term, so that a join with a few query terms reads their buckets only,
and sorted by field and term in each file, so that row groups without them are skipped. A bucket that is large, be it by one term that is in every document, is
written by several tasks as several files: adaptive execution splits it by size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import STOP_WORDS, TOKENIZERS, is_valid, tokens
from quarry.sources import resolve
from quarry.storage import exists, new_folder, placed, remove

_TABLES = {
    "postings": "field string, term string, doc_id long, tf int, first_pos int, dl int, bucket int",
    "dictionary": "field string, term string, df long, bucket int",
    "lengths": "field string, doc_id long, dl int",
    "stats": "field string, num_docs long, avgdl double, num_terms long, num_postings long, num_tokens long",
}


def field_tokens(df: DataFrame, fields: Sequence[str], id_col: str = "doc_id", tokenizer: str = "space") -> DataFrame:
    """(doc_id, field, toks) for each record and field; a record is scanned once for all fields."""
    per_field = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f), tokenizer).alias("toks")) for f in fields))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(per_field).alias("f")).select("doc_id", "f.field", "f.toks")


def occurrences(parts: DataFrame) -> DataFrame:
    """(field, doc_id, dl, pos, term) of field_tokens(), positions counted from 0."""
    sized = parts.select("field", "doc_id", F.size("toks").alias("dl"), "toks")  # first, or each token would carry the array along
    return sized.select("field", "doc_id", "dl", F.posexplode("toks").alias("pos", "term"))


def counted(rows: DataFrame) -> DataFrame:
    """Frequency and first position of each term in each field of each document; counted on the map side first."""
    return rows.groupBy("field", "term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.min("pos").alias("first_pos"), F.max("dl").alias("dl"))


def indexed(rows: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """Occurrences without invalid terms and stop words, which count towards document lengths only."""
    rows = rows.where(is_valid(F.col("term")))
    return rows.where(~F.col("term").isin(*stop_words)) if stop_words else rows


def stop_list(stop_words: str | Sequence[str] | None) -> list[str]:
    """Upper-cased stop words: none, a list, or english."""
    if stop_words is None:
        return []
    if isinstance(stop_words, str):
        if stop_words.lower() != "english":
            raise ValueError("stop words are english or a list")
        return list(STOP_WORDS)
    return [_upper(w) for w in stop_words]


def _upper(text: str) -> str:
    return "".join(c.upper() if c.isascii() else c for c in text)


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    fields: tuple[str, ...]
    tokenizer: str
    stop_words: tuple[str, ...]
    postings: DataFrame
    dictionary: DataFrame
    lengths: DataFrame
    stats: DataFrame
    buckets: int
    path: str | None = None

    @classmethod
    def build(cls, df: DataFrame, fields: Sequence[str], id_col: str = "doc_id", tokenizer: str = "space", stop_words: str | Sequence[str] | None = None, buckets: int | None = None) -> SearchIndex:
        """The plan of an index over text columns; nothing runs yet. Null text is empty text."""
        if tokenizer not in TOKENIZERS:
            raise ValueError(f"tokenizers are {', '.join(TOKENIZERS)}")
        spark, fields, stop = df.sparkSession, resolve(df, fields), stop_list(stop_words)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # by document: the texts are shuffled, which are smaller than what is counted in them, and counting needs no other shuffle; a task's part is
        # bounded, as its counts take up to fifty times as much
        docs = placed(df.select(F.col(id_col).cast("long").alias("doc_id"), *fields), "doc_id")
        parts = field_tokens(docs, fields, "doc_id", tokenizer)
        postings = counted(indexed(occurrences(parts), stop)).withColumn("bucket", bucket(buckets))
        return cls(spark, tuple(fields), tokenizer, tuple(stop), postings, *_derived(postings, field_tokens(df, fields, id_col, tokenizer).select("field", "doc_id", F.size("toks").alias("dl")), buckets), buckets)

    def save(self, path: str) -> SearchIndex:
        """Writes the index to a folder, over what is there; dictionary and statistics are derived from the postings as written."""
        if self.path and self.path.rstrip("/") == path.rstrip("/"):
            return self
        if exists(self.spark, path):
            remove(self.spark, path)
        self.lengths.write.parquet(f"{path}/lengths")
        self.postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "field", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
        postings = _read(self.spark, self.postings, f"{path}/postings")
        dictionary, lengths, _ = _derived(postings, _read(self.spark, self.lengths, f"{path}/lengths"), self.buckets)
        dictionary.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/dictionary")
        dictionary = _read(self.spark, dictionary, f"{path}/dictionary")
        statistics(dictionary, lengths, self.fields).coalesce(1).write.parquet(f"{path}/stats")
        about = [(list(self.fields), self.tokenizer, list(self.stop_words), self.buckets)]
        self.spark.createDataFrame(about, "fields array<string>, tokenizer string, stop_words array<string>, buckets int").coalesce(1).write.parquet(f"{path}/about")
        return self.load(self.spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        if not exists(spark, f"{path}/about"):
            raise RuntimeError(f"no index is in {path}")
        about = spark.read.parquet(f"{path}/about").first()
        tables = [spark.read.schema(schema).parquet(f"{path}/{t}") for t, schema in _TABLES.items()]
        return cls(spark, tuple(about["fields"]), about["tokenizer"], tuple(about["stop_words"]), *tables, about["buckets"], path)

    def stored(self) -> SearchIndex:
        """The index, saved for the time of the session."""
        return self if self.path else self.save(new_folder(self.spark, "index"))


def _read(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _derived(postings: DataFrame, lengths: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    dictionary = postings.groupBy("bucket", "field", "term").agg(F.count("*").alias("df"))
    return dictionary, lengths, statistics(dictionary, lengths, None)


def statistics(dictionary: DataFrame, lengths: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """One row for each field; empty documents count."""
    docs = lengths.groupBy("field").agg(F.count("*").alias("num_docs"), F.avg("dl").alias("avgdl"), F.sum(F.col("dl").cast("long")).alias("num_tokens"))
    terms = dictionary.groupBy("field").agg(F.count("*").alias("num_terms"), F.sum("df").alias("num_postings"))
    both = docs.join(terms, "field", "left")
    return both.select("field", "num_docs", "avgdl", F.coalesce("num_terms", F.lit(0)).alias("num_terms"), F.coalesce("num_postings", F.lit(0)).alias("num_postings"), "num_tokens")
