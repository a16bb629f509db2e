"""Names that clash, files that split, skewed terms, and tables too large to broadcast."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry import sources
from quarry.engine import BM25
from quarry.operators import codec, rank, sketch
from quarry.operators.index import SearchIndex
from quarry.storage import small_parts


def test_ids_leave_every_column_as_it_is(spark):
    df = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c")], "at long, _at string").repartition(2)
    rows = sources.with_ids(df).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)] == [0, 1, 2] and {(r["at"], r["_at"]) for r in rows} == {(7, "a"), (8, "b"), (9, "c")}
    with pytest.raises(ValueError):
        sources.with_ids(df, "_AT")
    assert sources.with_ids(df.limit(0)).count() == 0


def test_ids_are_fixed_after_a_shuffle(spark):
    df = spark.range(5000).selectExpr("id % 997 as k").groupBy("k").count()
    rows = sources.with_ids(df)
    assert [r.doc_id for r in rows.select("doc_id").orderBy("doc_id").collect()] == list(range(997)) and rows.exceptAll(rows).count() == 0


def test_records_with_columns_like_the_results(spark):
    df = spark.createDataFrame([(5, 70, "x", "blue cat"), (6, 80, "y", "red dog"), (7, 90, "z", "blue dog dog"), (8, 91, "z", "green")], "doc_id long, rank long, score string, text string")
    engine = BM25(spark, documents=df, search_cols=["text"])
    found = engine.get_topk_docs("blue cat", k=2)
    assert [(r["doc_id"], r["rank"], r["text"]) for r in found] == [(5, 70, "blue cat"), (7, 90, "blue dog dog")] and found[0]["score"] > found[1]["score"]
    for k in (0, 1001):
        with pytest.raises(ValueError):
            engine.get_topk_indices("blue", k=k)
    kept = rank.with_records(engine.search(rank.queries_of(spark, "cat", ("text",))), df.withColumnRenamed("doc_id", "key").withColumn("key", F.col("key") - 5), "key")
    assert kept.columns == ["key", "text", "rank", "score"] and kept.first()["rank"] == 1


@pytest.mark.parametrize("inside", [False, True])
def test_csv_is_split_where_no_field_holds_a_line_end(spark, tmp_path, inside):
    rng = random.Random(1)
    rows = [(str(i), rng.choice(["a, b", 'say ""x""', "plain", "line\nend" if inside else ""]), "") for i in range(3000)]
    path = tmp_path / "t.csv"
    path.write_text("n,text,more\n" + "".join(f'{n},"{t}",{m}\n' for n, t, m in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = sources.read_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 3 and ("Exchange" in df._jdf.queryExecution().toString()) == inside
        assert sorted(map(tuple, df.collect())) == sorted((n, t.replace('""', '"'), m) for n, t, m in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_codes_and_back(spark):
    rng = random.Random(2)
    lists = [[rng.randrange(1 << rng.randrange(1, 62)) for _ in range(n)] for n in (0, 1, 2, 7, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, xs array<long>")
    coded = df.select("id", F.array_join(F.transform("xs", codec.vbyte), "").alias("code"))
    for first in (None, 1, 3):
        got = {r.id: r.xs for r in coded.select("id", codec.vbyte_decode(F.col("code"), first).alias("xs")).collect()}
        assert got == {i: x[:first] for i, x in enumerate(lists)}
    assert coded.where("id = 1").select(codec.vbyte_decode(F.concat("code", F.lit("81"))).alias("x")).first().x == lists[1]


def test_a_term_of_all_documents_is_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(0, 40_000, 1, 8).selectExpr("id as doc_id", "concat('the w', id) as text")
    own = {"advisoryPartitionSizeInBytes": "32k", "coalescePartitions.enabled": "false"}  # as large as the table is small
    for name, value in own.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        SearchIndex.build(docs, ["text"], buckets=4).save(f"file://{tmp_path}/i")
    finally:
        for name in own:
            spark.conf.unset(f"spark.sql.adaptive.{name}")
    index = SearchIndex.load(spark, f"file://{tmp_path}/i")
    files = index.postings.where("term = 'THE'").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 40_000
    assert rank.bm25(index, rank.queries_of(spark, "w17 the", index.fields), k=1).first()["doc_id"] == 17


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the word{i % 7} end") for i in range(40)], "doc_id long, text string")
    index = SearchIndex.build(docs, ["text"]).stored()
    asked = rank.query_table(spark.range(500).selectExpr("id as query_id", "concat('word', id % 9) as text"), index.fields)
    hints = lambda df: df._jdf.queryExecution().logical().toString().count("strategy=broadcast")
    few = rank.bm25(index, asked)
    monkeypatch.setattr(rank, "SENT", 1000)
    many = rank.bm25(index, asked)
    assert hints(few) > hints(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_sketches_in_blocks_of_queries(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(4))) for i in range(30)], "doc_id long, text string")
    sketched, asked = sketch.documents(docs, ["text"]), sketch.queries(docs.withColumnRenamed("doc_id", "query_id"))
    assert len(small_parts(asked, "query_id", 500)) > 2
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sketch.overlap(sketched, asked, limit=500)) == rows(sketch.overlap(sketched, asked))
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(30)], "vec_id long, embedding array<double>")
    assert rows(sketch.nearest(vectors, vectors, 40, limit=500)) == rows(sketch.nearest(vectors, vectors, 40))


def test_nearest_compares_without_rows_of_pairs(spark):
    """Against brute force, with ties, null vectors and more vectors than a step takes; no pair is a row that would be sorted."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 1.0]) for _ in range(70)] if i % 9 else None) for i in range(0, 600, 2)] + [(-i, [1.0] * 70) for i in range(1, 100)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = sketch.nearest(vectors, vectors.where("vec_id % 5 = 0"), 70, k=12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    signs = {i: [x > 0 for x in v or [0.0] * 70] for i, v in rows}
    expected = []
    for q in (i for i in signs if i % 5 == 0):
        near = sorted((sum(a != b for a, b in zip(signs[q], signs[v])), v) for v in signs)[:12]
        expected += [(q, n, v, d) for n, (d, v) in enumerate(near, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("files", [1, 4])
def test_csv_gives_back_odd_texts(spark, tmp_path, files):
    texts = [" lead", "trail ", "\ttab\t", "a\rb", "a\r\nb", "\n", "end\n", "\\", '\\"', '"', '""', 'a"b,c"', "", None, "\u0000", "\ufeffx", "#c", "null", " ", "\x85", ", ", "\\N", "x" * 200_000]
    df = spark.createDataFrame([(i, t, " s ") for i, t in enumerate(texts)], "id long, text string, more string").repartition(files, "id")
    sources.write_csv(df, str(tmp_path / "odd.csv"))
    read = sources.read_csv(spark, str(tmp_path / "odd.csv"), nulls=True)
    assert sorted((int(r.id), r.text, r.more) for r in read.collect()) == [(i, t, " s ") for i, t in enumerate(texts)]
    assert sorted((int(r.id), r.text) for r in sources.read_csv(spark, str(tmp_path / "odd.csv")).collect()) == [(i, t or "") for i, t in enumerate(texts)]
    one = df.select(df.text).where("text is not null")
    sources.write_csv(one, str(tmp_path / "one.csv"))
    assert sorted(r.text for r in sources.read_csv(spark, str(tmp_path / "one.csv")).collect()) == sorted(t for t in texts if t is not None)


def test_overlap_of_fields_is_summed_where_the_documents_are(spark, monkeypatch):
    monkeypatch.setattr(rank, "PAIRS", 300)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(4)), rng.choice(["a b", "", "c"])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, title string")
    asked = spark.createDataFrame([(i, t) for i, t, _ in docs[:9]] + [(100, "")], "query_id long, text string")
    found = sketch.overlap(sketch.documents(df, ["text", "title"]), sketch.queries(asked), {"title": 2.5}, k=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id#" in plan and "hashpartitioning(word#" not in plan
    assert not any("Exchange hashpartitioning(query_id#" in x and "doc_id#" in x.split("ENSURE")[0] for x in plan.splitlines())
    bits = lambda t: {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 128 for w in t.upper().split()}
    expected = []
    for q, t, _ in docs[:9]:
        scores = sorted((-8 * (len(bits(t) & bits(x)) + 2.5 * len(bits(t) & bits(y))), d) for d, x, y in docs)
        expected += [(q, n, d, -s) for n, (s, d) in enumerate(scores[:5], 1) if s]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
