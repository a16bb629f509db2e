"""The eleven queries over the smallest tables, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import decontaminate, packing, simhash, suffix, template, toxicity, warc, wavelet
from quarry.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables aren't here")


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found, expected = QUERIES[name](spark, DIR).toPandas(), c.sql(ORACLES[name]).df()
    columns = sorted(found.columns)
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert columns == sorted(expected.columns) and text(found).equals(text(expected))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_queries_cover_the_tables(spark):
    docs, pages = read(spark, "documents"), read(spark, "pages")
    n = docs.count()
    assert QUERIES["op2_language"](spark, DIR).count() == QUERIES["op6_toxicity"](spark, DIR).count() == n
    files = wavelet.shards(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    enc, decoded = wavelet.encoding(), {}
    for f in files:
        shard = wavelet.Shard(f.file)
        ids = shard.ids()
        for k, (d, end) in enumerate(zip(shard.documents, shard.ends)):
            decoded[int(d)] = enc.decode(ids[shard.ends[k - 1] if k else 0 : end].tolist())
    assert decoded == {d: t or "" for d, t in texts.items()}
    expected = sorted((x, d, p) for d, t in texts.items() if t for p, x in enumerate(enc.encode_ordinary(t)) if x % 50 == 0)
    assert sorted(map(tuple, QUERIES["op4_tokens"](spark, DIR).collect())) == expected
    packed = QUERIES["op1_packing"](spark, DIR)
    lengths = spark.createDataFrame([(d, len(enc.encode_ordinary(t))) for d, t in texts.items() if t], "doc_id long, n long")
    assert packed.groupBy("doc_id").sum("tokens").exceptAll(lengths).count() == 0
    assert packed.select("doc_id").distinct().count() == lengths.count()
    assert packed.groupBy("bin_id").sum("tokens").where(f"`sum(tokens)` > {packing.CAPACITY}").count() == 0
    assert QUERIES["op5_template"](spark, DIR).select("page_id").distinct().count() == pages.where("html <> ''").count()


def test_near_duplicates_and_leaks_as_brute_force(spark):
    from tests_plain import groups, leaks, repeats

    docs = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    bench = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    assert sorted(map(tuple, QUERIES["op9_simhash"](spark, DIR).collect())) == groups(docs)
    assert sorted(map(tuple, QUERIES["op10_suffix"](spark, DIR).collect())) == repeats(docs, suffix.WORDS)
    assert sorted(tuple(r) for r in QUERIES["op3_decontaminate"](spark, DIR).collect()) == leaks(docs, bench, decontaminate.PHRASE)


def test_stages(spark):
    """Each stage does to its own input what its operator says, and run() is the stages one after another."""
    from tests_plain import groups, leaks, repeats

    docs = read(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = outs[-1] if k else docs
        outs.append(stage(spark, before, DIR).cache())
        if k < 4:
            assert outs[-1].columns == docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    ids = lambda df: {d for d, _ in rows(df)}
    lexicon = toxicity.learn(docs, read(spark, "labels"))
    assert ids(outs[0]) == {r.doc_id for r in toxicity.score(docs, lexicon).collect() if not r.toxic}
    assert ids(outs[1]) == ids(outs[0]) - {d for _, d, keep in groups(rows(outs[0])) if not keep}
    spans = repeats(rows(outs[1]), suffix.WORDS)
    touched = {d for d, *_ in spans}
    before = dict(rows(outs[1]))
    after = dict(rows(outs[2]))
    assert all(after[d] == before[d] for d in after if d not in touched)
    assert set(before) - set(after) <= touched
    assert repeats(list(after.items()), suffix.WORDS) == []
    bench = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    assert ids(outs[3]) == ids(outs[2]) - {d for d, *_ in leaks(rows(outs[2]), bench, decontaminate.PHRASE)}
    whole = corpus_pipeline.run(spark, DIR)
    assert whole.columns == outs[4].columns and {r.doc_id for r in whole.collect()} == {r.doc_id for r in outs[4].collect()} <= ids(outs[3])


def test_clashing_columns(spark):
    """Extra columns named like an operator's own don't matter."""
    docs = read(spark, "documents").selectExpr("*", "1 as id", "2 as n", "3 as `group`", "'x' as rest", "4 as doc", "5 as h", "6 as piece", "7 as `_cut`")
    docs = docs.drop("_cut")
    assert simhash.deduplicate(docs).columns == suffix.cut(docs).columns == docs.columns
    assert packing.packed(docs).count() > 0 and wavelet.shards(docs).count() > 0
    assert decontaminate.clean(docs, read(spark, "benchmark").selectExpr("*", "1 as item", "2 as n")).columns == docs.columns
    pages = read(spark, "pages").selectExpr("*", "1 as id", "'h' as host", "2 as uid", "3 as part", "4 as roles")
    assert template.extract(pages).count() > 0 and warc.round_trip(pages).count() == pages.count()


def odd(spark):
    """Nulls in every column, empty and repeated rows, an id on two texts, a long text, columns named like working ones."""
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "", "", 0), (None, text + " more", None, "b", 1), (None, None, None, None, None), (4, "\n ", "x", "y", 2), (5, text.upper() + " end", "en", "a", 7), (5, "short", "en", "a", 7), (6, "z " * 50_000, "en", "c", 5), (7, "you idiot moron scum", "en", "d", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as id", "2 as key", "3 as `group`", "4 as spans", "5 as toxic", "6 as node", "7 as start", "8 as tokens")


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, tmp_path, k):
    """Each stage keeps what its docstring says, with all columns, and takes an empty table."""
    for name, rows, schema in (("labels", [(7, 0, 1), (None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "unheard phrase"), (2, None), (None, "x")], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, (_, stage) = odd(spark), corpus_pipeline.STAGES[k]
    out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and none.columns == out.columns
    rows = sorted(((r.doc_id, r.text) for r in out.collect()) if k < 4 else ((r.doc_id, r.tokens) for r in out.collect()), key=str)
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    if k < 4:
        assert out.columns == docs.columns
        blank = [r for r in given if r[0] is None or not (r[1] or "").strip()]
        assert [r for r in rows if r in blank] == blank
    if k == 0:
        assert rows == [r for r in given if r[0] != 7]
    if k == 1:
        assert sorted(d for d, _ in rows if d) == [1, 2, 3, 4, 6, 7]
    if k == 2:
        assert [t for d, t in rows if d == 1] == [t for d, t in given if d == 1] and len([r for r in rows if r[0] == 6]) == 1
    if k == 3:
        assert rows == given
    if k == 4:
        assert {d for d, _ in rows} == {1, 4, 5, 6, 7, None} and sum(n for d, n in rows if d == 1) == 2 * sum(n for d, n in rows if d == 1) // 2
