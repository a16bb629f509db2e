import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk


def plain(rows, k, asked=lambda i: True):
    out = []
    for i, v in rows:
        if not asked(i):
            continue
        scored = sorted((-round(float(np.dot(np.float64(v), np.float64(w))), topk.DIGITS), j) for j, w in rows if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s + 0.0) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r[0], r[1], r[2], r[3]) for r in df.collect())


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("kind,block,longest,sent", [("random", 512, 1024, 2560), ("skewed", 256, 256, 2048), ("ties", 512, 1024, 4096), ("one", 1 << 20, 1 << 24, 1 << 26), ("zero", 256, 512, 2048)])
def test_as_brute_force(spark, adaptive, kind, block, longest, sent):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 6)).astype(np.float32)
    if kind == "skewed":
        x *= np.exp(rng.normal(size=(70, 1)) * 2).astype(np.float32)
        x[:, 3:] *= 0.01
    if kind == "ties":
        x = rng.integers(-1, 2, (70, 6)).astype(np.float32)
        x[40:] = x[0]
    if kind == "zero":
        x[:50] = 0
    rows = [(int(i) * 3, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(topk.search(df, k=5, block=block, longest=longest, sent=sent)) == plain(rows, 5)


def test_many_partitions_and_a_query_set(spark, adaptive):
    """Many blocks in several tasks, and queries that go to them in several rounds: every list is right."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(3000, 16)) * np.exp(rng.normal(size=(3000, 1)) * 0.5)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    found = topk.search(df, k=10, queries=F.col("vec_id") % 10 == 0, block=8192, longest=16384, sent=24576)
    score = x[::10].astype(float) @ x.astype(float).T
    expected = []
    for n, line in enumerate(score):
        order = sorted((-round(float(s), topk.DIGITS), j) for j, s in enumerate(line) if j != n * 10)[:10]
        expected += [(n * 10, r + 1, j, -s + 0.0) for r, (s, j) in enumerate(order)]
    assert got(found) == sorted(expected)


def test_long_vectors(spark):
    """At lengths of a million, sums of products are off by more than a step of rounding: no neighbour is lost by it."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)) * 1e6
    x[30:] = x[:30] * (1 + 1e-13)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, exact = {}, x @ x.T
    for i, _, j, s in got(topk.search(df, k=3, block=640, longest=640, sent=2560)):
        found.setdefault(i, []).append(exact[i, j])
    for i, scores in found.items():
        best = np.sort(np.delete(exact[i], i))[::-1][:3]
        assert np.allclose(sorted(scores, reverse=True), best, rtol=1e-12)


def test_nulls_and_more(spark):
    rows = [(1, [1.0, 2.0]), (2, [0.5, None]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [float("nan"), 1.0]), (6, [2.0, 1.0]), (6, [2.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, float("inf")]), (9, [0.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, v int")
    assert got(topk.search(df, k=2)) == plain([(1, [1, 2]), (6, [2, 1]), (9, [0, 0]), (7, [1, 2, 3]), (10, [1, 0, 0])], 2)
    assert got(topk.search(df.limit(0))) == []
    assert got(topk.search(df.where("vec_id = 1"))) == []
    assert got(topk.search(df, queries=F.col("vec_id") == 2)) == []
    with pytest.raises(ValueError):
        topk.search(df, k=0)


def test_pruning_leaves_blocks_out():
    """Short vectors aren't multiplied once the long ones have set the bounds."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    long, short = (topk._rotated(x * f, np.eye(4), 2) for f in (100, 1e-3))
    ids = np.arange(40)
    best = topk.Best(ids, long, 3, np.full(40, -np.inf), 2)
    best.meet(ids + 100, long)
    assert (best.need() > 0.01).all()
    again = topk.Best(ids, long, 3, best.least, 2)
    again.meet(ids + 200, short)
    assert not len(again.rows)
