"""Search over records from files, memory or DataFrames, one object for index and source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sources
from quarry.operators import rank
from quarry.operators.index import SearchIndex

MOST = 1000


class BM25:
    """Ranked search. Give a path (csv, json, jsonl, parquet) with search_cols, or records in memory, or a DataFrame."""

    def __init__(self, spark: SparkSession, filename: str | None = None, documents: Any = None, search_cols: Sequence[str] = (), stopwords: str | Sequence[str] | None = None, k1: float = rank.K1, b: float = rank.B, bloom_df_threshold: float | None = None, tokenizer: str = "space"):
        if (filename is None) == (documents is None):
            raise ValueError("give a file or documents")
        self.spark, self.k1, self.b, self.threshold = spark, k1, b, bloom_df_threshold
        self.in_memory = documents is not None and not isinstance(documents, DataFrame)
        if filename is not None or isinstance(documents, DataFrame):
            given = documents if filename is None else sources.read(spark, filename)
            self.records = sources.with_ids(given, sources.free_name(given.columns, "doc_id"))  # stored: a file is parsed once
        else:
            self.records = sources.documents(spark, documents)
        self.index = SearchIndex.build(self.records, search_cols or self.records.columns[1:], self.records.columns[0], tokenizer, stopwords).stored()

    def columns(self) -> list[str]:
        return rank.ordered_columns(self.records.columns[1:], self.index.fields)

    def search_columns(self) -> list[str]:
        return list(self.index.fields)

    def save(self, path: str) -> None:
        """Saves index and records."""
        self.index.save(f"{path}/index")
        self.records.write.mode("overwrite").parquet(f"{path}/records")

    @classmethod
    def load(cls, spark: SparkSession, path: str, k1: float = rank.K1, b: float = rank.B, bloom_df_threshold: float | None = None) -> BM25:
        self = cls.__new__(cls)
        self.spark, self.k1, self.b, self.threshold, self.in_memory = spark, k1, b, bloom_df_threshold, False
        self.index, self.records = SearchIndex.load(spark, f"{path}/index"), spark.read.parquet(f"{path}/records")
        return self

    def search(self, queries: DataFrame, k: int | None = 10, query_max_df: int | None = None, relax: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, score) of a query table, many queries in one job."""
        if k is not None and not 1 <= k <= MOST:
            raise ValueError(f"k is from 1 to {MOST}, or None for all")
        if self.threshold is not None:
            return rank.candidates(self.index, queries, self.threshold, k, self.k1, self.b, query_max_df)
        return rank.bm25(self.index, queries, k, self.k1, self.b, query_max_df, relax)

    def search_phrases(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The same by idf weights with the bonus for phrases."""
        if not 1 <= k <= MOST:
            raise ValueError(f"k is from 1 to {MOST}")
        return rank.idf_phrase(self.index, queries, k)

    def _asked(self, query: str | Mapping[str, str] | None, boost_factors) -> DataFrame:
        return rank.queries_of(self.spark, query, self.index.fields, boost_factors)

    def get_topk_indices(self, query: str | Mapping[str, str] | None, query_max_df: int | None = None, k: int = 10, boost_factors: Sequence[float] | Mapping[str, float] | None = None) -> tuple[list[float], list[int]]:
        """Scores and ids."""
        rows = self.search(self._asked(query, boost_factors), k, query_max_df).orderBy("rank").collect()
        return [r["score"] for r in rows], [r["doc_id"] for r in rows]

    def get_topk_docs(self, query: str | Mapping[str, str] | None, k: int = 10, query_max_df: int | None = None, boost_factors: Sequence[float] | Mapping[str, float] | None = None) -> list[dict]:
        """Records with their scores, best first. A record's own score is left out."""
        if self.in_memory:
            raise RuntimeError("documents in memory have no records to fetch; use get_topk_indices")
        found = rank.with_records(self.search(self._asked(query, boost_factors), k, query_max_df), self.records, self.records.columns[0], rank_col="", score_col="")
        own = [c for c in self.records.columns[1:] if c.lower() != "score"]
        return [{**{c: r[c] for c in own}, "score": r[-1]} for r in found.orderBy(F.asc(found.columns[-2])).collect()]
