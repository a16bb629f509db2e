"""Queries over the driver's tables, each with its SQL twin."""
from quarry.plans.catalog import ORACLES, QUERIES, bm25_topk

__all__ = ["ORACLES", "QUERIES", "bm25_topk"]
