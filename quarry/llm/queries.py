"""One query for each operator of this subpackage, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language, packing, simhash, suffix, template, topk, toxicity, warc, wavelet
from quarry.llm.shared import Workspace, ship
from quarry.storage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(_table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of each token id that is divisible by 50, found in the files that all documents are written to."""
    work = Workspace(spark, "tokens")
    work.store(wavelet.write(wavelet.shards(_table(spark, sf_dir, "documents")), f"{work.path}/shards"), "written")
    return wavelet.lookup(wavelet.read(spark, f"{work.path}/shards"), range(0, wavelet.size_of(), 50))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(_table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op4_tokens": op4_tokens,
    "op3_decontaminate": op3_decontaminate,
    "op5_template": op5_template,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_suffix": op10_suffix,
}

ORACLES: dict[str, str] = {
    "op7_topk": topk.oracle(),
    "op8_warc": "SELECT page_id, url, html FROM pages",
}
