import math
import random

import pyarrow as pa

from quarry.llm import decontaminate as D
from quarry.llm.tokens import tokenize


def words(text):
    return tokenize(pa.array([text], pa.string())).hashes.tolist()


def plain(docs, items, phrase, share=D.SHARE, width=D.WIDTH):
    """All matches by comparing every place with every place."""
    found = []
    for d, text in docs:
        own = words(text)
        for k, item in items:
            asked = words(item)
            n = min(phrase, len(asked))
            if n >= D.FEWEST:
                for shift in range(-len(asked), len(own)):
                    run = 0
                    for j in range(len(asked) + 1):
                        if j < len(asked) and 0 <= shift + j < len(own) and own[shift + j] == asked[j]:
                            run += 1
                        else:
                            if run >= n:
                                found.append((d, k, "phrase", shift + j - run, shift + j, run))
                            run = 0
            distinct = set(asked)
            if len(distinct) < D.DISTINCT:
                continue
            need, reach = math.ceil(share * len(distinct)), int(width * len(asked))
            spans = []
            for p, w in enumerate(own):
                if w not in distinct:
                    continue
                inside = [q for q in range(p, min(p + reach, len(own))) if own[q] in distinct]
                n = len({own[q] for q in inside})
                if n >= need:
                    if spans and p < spans[-1][1]:
                        spans[-1][1:] = [max(spans[-1][1], inside[-1] + 1), max(spans[-1][2], n)]
                    else:
                        spans.append([p, inside[-1] + 1, n])
            found += [(d, k, "proximity", *s) for s in spans]
    return sorted(found)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "item_id", "kind", "start", "stop", "words").collect())


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 14, 20, 30])))) for k in range(8)]
    docs = []
    for d in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        item = rng.choice(items)[1].split()
        kind = d % 5
        if kind == 1:
            text[5:5] = item
        if kind == 2:
            text[3:3] = [w.upper() + "," for w in item[: len(item) * 2 // 3]]
        if kind == 3:
            rng.shuffle(item)
            text = text[:4] + item + text[4:]
        if kind == 4:
            text[0:0] = [x for w in item for x in ([w, "filler"] if rng.random() < 0.2 else [w])]
        docs.append((d, " ".join(text)))
    return docs, items


def test_as_brute_force(spark):
    for seed, segment in ((1, 200), (2, 1 << 20)):
        docs, items = made(seed)
        a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        expected = plain(docs, items, 8)
        assert {x[2] for x in expected} == {"phrase", "proximity"}
        assert got(D.matches(a, b, phrase=8, segment=segment)) == expected
        assert got(D.matches(a, b, phrase=8, segment=segment, block=20)) == expected


def test_nulls_and_more(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(1, f"x. {item.upper()} y", 1), (2, None, 1), (3, "", 2), (None, item, 3), (4, "alpha beta", 4), (1, f"x. {item.upper()} y", 5), (5, "...", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (None, item, 1), (7, item, 2)], "item_id long, text string, doc_id long")
    assert got(D.matches(docs, bench)) == [(1, 7, "phrase", 1, 14, 13)] * 2 + [(1, 7, "proximity", 1, 14, 13)] * 2
    left = D.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert D.matches(a, b).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == docs.count()


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "so the Answer, it is: forty-two!"), (2, "answer it"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "answer it is forty"), (2, "Answer")], "item_id long, text string")
    assert got(D.matches(docs, bench)) == [(1, 1, "phrase", 2, 6, 4), (1, 2, "phrase", 2, 3, 1), (2, 2, "phrase", 0, 1, 1)]
    assert got(D.matches(docs, bench, fewest=4)) == [(1, 1, "phrase", 2, 6, 4)]
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [3]


def test_scripts_without_blanks(spark):
    items = [(1, "水的沸点是多少？"), (2, "日本の首都、東京"), (3, "น้ำเดือด"), (4, "𠀀𠀁")]
    docs = [(1, "问：水的沸点是多少，谢谢"), (2, "x日本の首都東京y"), (3, "เมื่อน้ำเดือดแล้ว"), (4, "a𠀀𠀁b"), (5, "水 沸 点")]
    found = got(D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert [r[:5] for r in found] == [(1, 1, "phrase", 1, 8), (2, 2, "phrase", 1, 8), (3, 3, "phrase", 5, 13), (4, 4, "phrase", 1, 3)]
    split = tokenize(pa.array(["Où, 한국어 ＡＢ！é", None, "中文a"]), scripts=True)
    assert split.counts.tolist() == [4, 0, 3] and list(zip(split.start.tolist(), split.end.tolist()))[4:] == [(0, 3), (3, 6), (6, 7)]


def test_very_long_text(spark):
    item = " ".join(f"v{i}" for i in range(20))
    long = "lorem ipsum dolor " * 200_000
    docs = spark.createDataFrame([(1, long + item), (2, long), (3, "x" * 3_000_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r[2:] for r in got(D.matches(docs, bench))} == {("phrase", 600_000, 600_020, 20), ("proximity", 600_000, 600_020, 20)}
