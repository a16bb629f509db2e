"""Ranking against plain Python on small records."""

import math
import random
from collections import Counter

import pytest

from quarry.engine import BM25
from quarry.operators import rank
from quarry.operators.index import SearchIndex

DOCS = [
    (0, "the cat sat", "cat tales"),
    (1, "", "nothing"),
    (2, "the of and", "of"),
    (3, "cat cat cat dog", "cat"),
    (4, "- x", ""),
    (5, "line one\nline two cat", "é accent"),
    (6, "the dog the end", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, body string, title string")


def upper(x):
    return "".join(c.upper() if c.isascii() else c for c in x or "")


def split(x):
    return [t for t in upper(x).split(" ") if t]


def plain(docs, fields, texts, boosts=None, k1=1.2, b=0.4, max_df=None, stop=()):
    """Score of each matched document: fields is a list of columns, texts the query text of each."""
    scores = Counter()
    found = set()
    for c, text in zip(fields, texts):
        toks = {d[0]: split(d[c]) for d in docs}
        avg = sum(map(len, toks.values())) / len(toks)
        keep = lambda t: (len(t.encode()) > 1 or t.isalnum()) and t not in stop
        for q in split(text):
            if q in stop:
                continue
            df = sum(q in {t for t in own if keep(t)} for own in toks.values())
            if not df or max_df is not None and df > max_df:
                continue
            idf = math.log((len(toks) - df + 0.5) / (df + 0.5))
            for d, own in toks.items():
                tf = own.count(q)
                if tf and keep(q):
                    found.add(d)
                    scores[d] += (boosts or {}).get(c, 1.0) * idf * tf / (tf + k1 * (1 - b + b * len(own) / avg))
    return sorted(((d, round(scores[d], 4)) for d in found), key=lambda x: (-x[1], x[0]))


def got(df):
    return [(r.doc_id, r.score) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def index(docs):
    return SearchIndex.build(docs, ["TITLE", "body"]).stored()


def ask(spark, index, query, boosts=None):
    return rank.queries_of(spark, query, index.fields, boosts)


def test_one_text_for_all_fields(spark, index):
    assert index.fields == ("body", "title")
    assert got(rank.bm25(index, ask(spark, index, "the cat"), k=None)) == plain(DOCS, [1, 2], ["the cat"] * 2)


def test_negative_scores_stay(spark, docs):
    index = SearchIndex.build(docs.where("doc_id <> 1"), ["body"])
    found = got(rank.bm25(index, ask(spark, index, "cat the"), k=None))
    assert found == plain([d for d in DOCS if d[0] != 1], [1], ["cat the"])


def test_fields_and_boosts(spark, index):
    query = {"Title": "cat", "BODY": "dog end", "other": "x"}
    assert got(rank.bm25(index, ask(spark, index, query, {"title": 3.0}), k=None)) == plain(DOCS, [1, 2], ["dog end", "cat"], {2: 3.0})
    one, two = (dict(got(rank.bm25(index, ask(spark, index, "dog", [w, w]), k=None))) for w in (1.0, 2.0))
    assert all(abs(two[d] - 2 * one[d]) < 2e-4 for d in one)
    with pytest.raises(ValueError):
        ask(spark, index, "x", [1.0])


def test_repeated_and_permuted_tokens(spark, index):
    once, twice = (dict(got(rank.bm25(index, ask(spark, index, q), k=None))) for q in ("dog", "dog dog"))
    assert all(abs(twice[d] - 2 * once[d]) < 2e-4 for d in once)
    assert got(rank.bm25(index, ask(spark, index, "end cat dog"))) == got(rank.bm25(index, ask(spark, index, "dog end cat")))


def test_limits_and_stop_words(spark, index, docs):
    assert got(rank.bm25(index, ask(spark, index, "the end"), k=None, max_df=2)) == plain(DOCS, [1, 2], ["the end"] * 2, max_df=2)
    assert got(rank.bm25(index, ask(spark, index, "the"), max_df=1)) == []
    assert len(got(rank.bm25(index, ask(spark, index, "the cat"), k=None, max_df=0, relax=True))) > 0
    stopped = SearchIndex.build(docs, ["body"], stop_words="english")
    assert got(rank.bm25(stopped, ask(spark, stopped, "the cat of"), k=None)) == plain(DOCS, [1], ["the cat of"], stop={"THE", "OF", "AND"})


def test_nothing_found(spark, index):
    for q in ("zzz", "", None, "-"):
        assert got(rank.bm25(index, ask(spark, index, q))) == []
    with pytest.raises(ValueError):
        ask(spark, index, ["x"])
    with pytest.raises(ValueError):
        rank.bm25(index, ask(spark, index, "x"), k=0)


def test_partitions_do_not_matter(spark, docs, index):
    other = SearchIndex.build(docs.repartition(5), ["body", "title"], buckets=3)
    assert got(rank.bm25(other, ask(spark, other, "the cat dog"))) == got(rank.bm25(index, ask(spark, index, "the cat dog")))


def test_save_and_load(spark, docs, tmp_path):
    index = SearchIndex.build(docs, ["body"], stop_words=["dog"])
    for _ in range(2):
        index.save(f"file://{tmp_path}/i")
    again = SearchIndex.load(spark, f"file://{tmp_path}/i")
    assert again.stop_words == ("DOG",)
    assert got(rank.bm25(again, ask(spark, again, "cat dog the"))) == got(rank.bm25(index, ask(spark, index, "cat dog the")))
    with pytest.raises(RuntimeError):
        SearchIndex.load(spark, f"file://{tmp_path}/none")


def test_empty_table(spark, docs):
    index = SearchIndex.build(docs.limit(0), ["body"]).stored()
    assert got(rank.bm25(index, ask(spark, index, "cat"))) == []


def test_candidates(spark, index, docs):
    found = dict(got(rank.candidates(index, ask(spark, index, {"body": "the end"}), 0.3, k=None)))
    exact = dict(plain(DOCS, [1], ["the end"]))
    assert found == {6: exact[6]}
    seeded = got(rank.candidates(index, ask(spark, index, {"body": "the cat"}), 0.1, k=None, seeds=1))
    seed = max((d for d in DOCS if "THE" in split(d[1])), key=lambda d: (split(d[1]).count("THE"), d[0]))[0]
    assert [d for d, _ in seeded] == [seed]


def plain_phrase(docs, query):
    """A sequential account of the ranking by idf and phrases, one field."""
    toks = [split(d) for d in docs]
    df = Counter(t for own in toks for t in set(own))
    kept = [q for q in split(query) if df[q]]
    weight = [1 + math.log2(len(toks) / df[q]) for q in kept]
    last, score = {}, {}
    for i, (q, w) in enumerate(zip(kept, weight)):
        high = w < 1 + math.log2(100) or w < 0.4 * sum(weight) / len(kept)
        for d, own in enumerate(toks):
            if q not in own:
                continue
            pos = own.index(q)
            if d in score:
                score[d] += w * (1.75 if i and pos == last[d] + 1 else 1.0)
                last[d] = pos
            elif not high:
                score[d], last[d] = w, pos
    return sorted(((d, round(s, 4)) for d, s in score.items()), key=lambda x: (-x[1], x[0]))


def test_idf_phrase(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = [" ".join(rng.choice(words[: 20 if rng.random() < 0.5 else 3000]) for _ in range(8)) for _ in range(400)]
    index = SearchIndex.build(spark.createDataFrame(list(enumerate(docs)), "doc_id long, body string"), ["body"], tokenizer="alnum").stored()
    asked = [(i, " ".join(docs[i].split()[2:6]) + " w0 w1") for i in range(0, 60, 3)]
    found = rank.idf_phrase(index, rank.query_table(spark.createDataFrame(asked, "query_id long, text string"), index.fields), k=1000).collect()
    for i, q in asked:
        own = [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == i]
        assert own == plain_phrase(docs, q)
    assert found


def test_engine(spark, tmp_path):
    texts = ["blue shirt", "red shirt shirt", "", None, "green hat"]
    engine = BM25(spark, documents=texts)
    assert engine.get_topk_indices("shirt")[1] == [1, 0]
    with pytest.raises(RuntimeError):
        engine.get_topk_docs("shirt")
    path = tmp_path / "a.csv"
    path.write_text('id,"na,me",note\n1,"say ""hi"" now","two\nlines"\n2,plain,\n')
    engine = BM25(spark, filename=str(path), search_cols=["NA,ME"], b=0.75)
    docs = engine.get_topk_docs("NOW")
    assert docs[0]["na,me"] == 'say "hi" now' and docs[0]["note"] == "two\nlines" and isinstance(docs[0]["score"], float)
    assert engine.columns() == ["na,me", "score", "id", "note"]
    engine.save(f"file://{tmp_path}/saved")
    assert BM25.load(spark, f"file://{tmp_path}/saved", b=0.75).get_topk_docs("now") == docs
    with pytest.raises(ValueError):
        engine.search_phrases(rank.queries_of(spark, "x", engine.index.fields), k=1001)


def test_memory_sources(spark):
    import pandas as pd

    for given in ([["a b", "c"], ("d", None)], [{"x": "a b", "y": "c"}, {"y": None, "x": "d"}], pd.DataFrame({"x": ["a b", "d"], "y": ["c", None]})):
        engine = BM25(spark, documents=given)
        assert engine.get_topk_indices("d")[1] == [1]
    with pytest.raises(ValueError):
        BM25(spark, documents=[])
    with pytest.raises(ValueError):
        BM25(spark, documents=["x"], search_cols=["none"])


def test_scores_are_summed_where_the_documents_are(spark, monkeypatch):
    """A stored index, whose postings go to the documents' tasks, gives what one that isn't stored gives; pairs of query and document aren't shuffled but for the best."""
    monkeypatch.setattr(rank, "PAIRS", 300)
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.expovariate(0.15)), 40)}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(30))), word()) for i in range(200)], "doc_id long, body string, title string")
    plan = SearchIndex.build(docs, ["body", "title"])
    stored = plan.stored()
    texts = [(i, " ".join(word() for _ in range(6))) for i in range(20)] + [(None, "w30 w1 w2"), (50, "w0 w1"), (51, "w1 w0 w2")]
    asked = rank.query_table(spark.createDataFrame(texts, "query_id long, text string"), plan.fields, boosts=[1.0, 2.0])
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
    found = rank.bm25(stored, asked)
    assert same(found, rank.bm25(plan, asked)) and same(rank.bm25(stored, asked, k=None), rank.bm25(plan, asked, k=None))
    shuffled = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in shuffled and "Exchange hashpartitioning(doc_id#" in shuffled
    assert not any("Exchange hashpartitioning(query_id#" in x and "doc_id#" in x.split("ENSURE")[0] for x in shuffled.splitlines())
    for more in ({}, {"max_df": 12}, {"seeds": 3}):
        assert same(rank.candidates(stored, asked, 0.1, **more), rank.candidates(plan, asked, 0.1, **more))
    monkeypatch.setattr(rank, "RARE", 3.0)
    assert same(rank.idf_phrase(stored, asked, 20), rank.idf_phrase(plan, asked, 20))
