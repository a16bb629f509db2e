import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import suffix
from quarry.llm.tokens import tokenize


def words(text):
    return tuple(tokenize(pa.array([text], pa.string()), scripts=True, signs=True).hashes.tolist())


def plain(rows, n):
    """Spans of words in passages of n words that occur before, by document id and place; ids are unique."""
    first, copies, out = {}, {}, []
    for d, text in sorted(rows):
        own = words(text)
        if len(own) < n:
            continue
        if own in copies:
            out.append((d, 0, len(own), copies[own]))
            continue
        copies[own] = d
        spans = []
        for p in range(len(own) - n + 1):
            run = own[p : p + n]
            source = first.setdefault(run, (d, p))
            if source != (d, p):
                if spans and p <= spans[-1][1] and spans[-1][2] == source[0]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n, source[0]])
        out += [(d, *s) for s in spans]
    return sorted(out)


def made(seed, n=50):
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    shared = [fresh(rng.choice([8, 12, 20])) for _ in range(5)]
    rows = []
    for d in range(n):
        text = fresh(rng.randrange(0, 30))
        kind = d % 6
        if kind == 1:
            text[3:3] = rng.choice(shared)
        if kind == 2:
            text += rng.choice(shared) + fresh(2) + rng.choice(shared)
        if kind == 3:
            text = ["a", "b", "c"] * rng.randrange(3, 9)
        if kind == 4 and rows:
            text = rng.choice(rows)[1].upper().split()
        rows.append((d * 3, " ".join(text)))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n,sent,hot", [(8, 10, suffix.HOT), (8, 10**6, 2), (5, 10, 0), (11, 10**6, 4), (1, 10**6, suffix.HOT), (2, 10, 1)])
def test_as_brute_force(spark, n, sent, hot):
    """Also where ranks that few positions share count as hot, in part or all."""
    rows = made(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain(rows, n)
    assert expected and got(suffix.passages(docs, words=n, sent=sent, hot=hot)) == expected


def test_batches_do_not_matter(spark):
    """Ranks, pairs and spans that go on over many small batches."""
    rows = made(3, 30)
    rows += [(1000, "x " * 400), (1001, "y " + "x " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(suffix.passages(docs, words=8)) == plain(rows, 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_signs_between_blanks_and_scripts_without_blanks(spark):
    """A passage of a table, and one of Chinese, of over fifty words."""
    table = " | ".join(f"cell{i}" for i in range(27))
    chinese = "".join(chr(0x4E00 + 37 * i % 2000) for i in range(60))
    rows = [(1, f"first {table} end"), (2, f"second {table} stop"), (3, f"前{chinese}。"), (4, f"x{chinese}，后")]
    found = got(suffix.passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == [(2, 1, 54, 1), (4, 1, 61, 3)] == plain(rows, 50)


def test_cut_leaves_one_copy(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"one {passage}, two", "x"), (2, f"Three ({passage.upper()}) four.", "y"), (3, passage, "z"), (4, None, None), (5, "", ""), (None, passage, "n"), (6, f"own words {passage} and {passage}", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    left = {r.doc_id: (r.text, r.start) for r in suffix.cut(docs, words=10).collect()}
    assert left == {1: (rows[0][1], "x"), 2: ("Three () four.", "y"), 4: (None, None), 5: ("", ""), None: (passage, "n"), 6: ("own words  and ", "q")}


def test_cut_any_columns_and_several_texts_of_an_id(spark):
    """Working names as columns; a text whose id has another one is cut only where its own words are meant."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [(1, f"{a} one"), (2, f"two {a}"), (2, f"{b} two"), (3, f"three {b}"), (3, f"three {b}"), (4, None), (None, a)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, _cut int, _cut_id int, cut_id int, cut_spans int, cut_key int")
    left = suffix.cut(docs, words=10)
    assert left.columns == docs.columns
    texts = {}
    for r in left.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
        assert tuple(r)[2:] == (1, 2, 3, 4, 5)
    assert texts[1] == [f"{a} one"] and texts[4] == [None] and texts[None] == [a]
    one, other = sorted(texts[2], key=lambda t: "b" in t)
    meant = min((f"two {a}", f"{b} two"), key=lambda t: suffix._key(tokenize(pa.array([t]), scripts=True, signs=True).hashes))
    assert (one, other) == (("two ", f"{b} two") if meant.startswith("two") else (f"two {a}", f"{b} two"))
    assert texts[3] == [f"three {b}"] * 2 if meant.startswith("two") else texts[3] == ["three "] * 2


def test_overlapping_spans():
    raw = b"a b, c; d e"
    start, end = np.array([0, 2, 5, 8, 10]), np.array([1, 3, 6, 9, 11])
    spans = lambda *x: [{"start": a, "stop": b} for a, b in x]
    assert suffix._without(raw, start, end, spans((1, 3), (2, 4))) == ("a  e", True)
    assert suffix._without(raw, start, end, spans((0, 3), (1, 2))) == ("; d e", True)
    assert suffix._without(raw, start, end, spans((0, 2), (2, 5))) == ("", False)


def test_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"p{i}" for i in range(20))
    rows = [(1, text, 0), (1, text, 1), (2, text, 2), (2, text + " more", 3), (3, "short", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos long")
    assert got(suffix.passages(docs, words=10)) == [(2, 0, 20, 1)]
    assert got(suffix.passages(docs.limit(0), words=10)) == []
    assert suffix.cut(docs.limit(0), words=10).columns == docs.columns


def test_very_long_text(spark):
    long = " ".join(f"u{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "before " + long[:3000]), (3, "a " * 100_000)], "doc_id long, text string")
    found = got(suffix.passages(docs))
    assert [(r[0], r[3]) for r in found] == [(2, 1), (3, 3)]
    assert found[1][1:3] == (1, 100_000)
