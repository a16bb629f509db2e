"""The documents of a training corpus: cleaned, deduplicated, decontaminated and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, packing, simhash, suffix, toxicity
from quarry.llm.shared import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the lexicon, learnt from their labels, doesn't find toxic. Null and empty texts and null ids stay; repeated rows stay or go together; an empty table, or one without labels, is scored by the built-in lexicon."""
    return toxicity.reject(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, and all in no group. Null, empty and wordless texts and null ids stay; of rows that repeat an id and text one stays; an empty table stays empty."""
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that repeat earlier ones; those of which nothing is left go. n_chars follows the text. Null, empty and short texts and null ids stay as they are; an empty table stays empty."""
    return suffix.cut(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found. Null, empty and wordless texts and null ids stay; rows that repeat an id stay or go together; without documents or benchmark nothing goes."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start, tokens) of all documents with a token. Null and empty texts have no row; a null id stays null; repeated rows are packed each; an empty table gives no row."""
    return packing.packed(docs)


#: Each takes the documents that the one before kept; the last gives the bins instead.
STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("benchmark leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Folding, signatures, prefix doubling and packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the documents table; each stage's result is written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = k - 1, work.store(stage(spark, docs, sf_dir), str(k))
        if before >= 0:
            work.drop(str(before))
    return docs
