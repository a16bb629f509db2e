import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import tokens
from quarry.llm.components import components
from quarry.llm.shared import Workspace, without


def test_components_as_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 1), (7, None)] + [(1, 2)] * 3
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.node, r.root) for r in components(df, Workspace(spark, "test")).collect()} == {(x, find(x)) for x in list(root)}
    assert components(df.limit(0), Workspace(spark, "test")).count() == 0


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, x string")
    gone = spark.createDataFrame([(1,), (None,)], "doc_id long")
    for limit in (0, 1 << 20):
        left = without(docs, gone, "doc_id", limit)
        assert left.columns == docs.columns and sorted(r.x for r in left.collect()) == ["b", "c"]


ALPHABET = st.text(alphabet="aZé9Ω漢 \n.,-—_'ÄöĀ", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=6))
def test_tokens_as_one_by_one(texts):
    found = tokens.tokenize(pa.array(texts, pa.string()))
    assert len(found.bounds) == len(texts) + 1
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        own = slice(found.bounds[i], found.bounds[i + 1])
        words = [raw[a:b].decode() for a, b in zip(found.start[own], found.end[own])]
        expected, now = [], ""
        for c in text or "":
            if c.isascii() and c.isalnum() or ord(c) >= 0xC0 and not 0x2000 <= ord(c) < 0x2040:
                now += c
            elif now:
                expected.append(now)
                now = ""
        assert words == expected + [now] * bool(now)
        for w, h in zip(words, found.hashes[own]):
            assert h == tokens.tokenize(pa.array([w.replace("Ä", "ä").replace("Z", "z")])).hashes[0]


def test_chunks_do_not_matter(monkeypatch):
    text = " ".join(f"w{i}é" for i in range(2000))
    one = tokens.tokenize(pa.array([text, None, text]))
    monkeypatch.setattr(tokens, "_CHUNK", 100)
    two = tokens.tokenize(pa.array([text, None, text]))
    assert all((getattr(one, k) == getattr(two, k)).all() for k in ("hashes", "start", "end", "bounds"))


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "", "y" * 300, "z"])], ["text"])
    parts = list(tokens.slices(batch, "text", 60))
    assert sum(p.num_rows for p in parts) == 5 and [p.num_rows for p in parts] == [3, 1, 1]
    assert np.array_equal(pa.concat_arrays([p.column(0) for p in parts]), batch.column(0))
