import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import simhash


def made(seed, bases=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for b in range(bases):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(len(copy) // 30):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
        if b % 7 == 0:
            rows += [rows[-1].upper()] * 2
    return list(enumerate(rows))


def plain(rows, distance=simhash.DISTANCE):
    """Groups by comparing every two signatures."""
    words, counts = simhash.sign(pa.array([t for _, t in rows], pa.string()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if counts[i] and counts[j] and np.bitwise_count(words[i] ^ words[j]).sum() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((min(g), d, d == min(g)) for g in groups.values() if len(g) > 1 for d in g)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_brute_force(spark):
    rows = made(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain(rows)
    assert len(expected) > 20 and got(simhash.groups(docs)) == expected
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == {d for d, _ in rows} - {d for _, d, keep in expected if not keep}


def test_recall_of_sampled_buckets():
    """Tables of sampled coordinates find the pairs at the largest distance as often as was asked for."""
    rng = np.random.default_rng(0)
    first, tables = simhash.plan(10**6)
    hits = 0
    for _ in range(500):
        unlike = rng.choice(simhash.BITS, simhash.DISTANCE, replace=False)
        hits += any(not np.isin(np.random.default_rng((7, t)).permutation(simhash.BITS)[:first], unlike).any() for t in range(tables))
    assert first > 5 and hits >= 0.9 * 500


def linked(a, b):
    """Least id that each id is connected with."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("hot", [0, 400])
def test_oversized_buckets(hot):
    """Pairs at the distance and chains of them, among unlike rows, with and without a great group of copies."""
    rng = np.random.default_rng(hot)
    bits = rng.integers(0, 2, (600, simhash.BITS)).astype(bool)
    for i in range(0, 200, 2):
        bits[i + 1] = bits[i]
        bits[i + 1, rng.choice(simhash.BITS, 40, replace=False)] ^= True
    copies = np.repeat(bits[599:], hot, axis=0) ^ (rng.random((hot, simhash.BITS)) < 0.05)
    words = np.packbits(np.concatenate([bits, copies]), axis=1).view(np.uint64)
    ids = rng.permutation(len(words)).astype(np.int64)
    exact, found = linked(*simhash._linked(ids, words, simhash.DISTANCE)), linked(*simhash._bucket(ids, words, simhash.DISTANCE, simhash.RECALL, 64, rng))
    together = lambda g: {(x, r) for x, r in g.items() if x != r}
    assert len(together(exact)) >= 100 + max(hot - 1, 0) * 0.9
    assert together(found) <= together(exact) or hot
    assert len(together(found) & together(exact)) >= 0.9 * len(together(exact))


def test_capped_buckets_find_the_same_groups(spark):
    rows = made(2, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, found = plain(rows), got(simhash.groups(docs, cap=8))
    assert len(set(found) & set(expected)) >= 0.9 * len(expected)


def test_near_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (50, 4)).astype(np.uint64)
    words[10:20] = words[0] ^ (np.uint64(1) << rng.integers(0, 60, (10, 4)).astype(np.uint64))
    found = {(int(a), int(b)) for i, j in simhash.near_pairs(words, 12, block=7) for a, b in zip(i, j)}
    assert found == {(i, j) for i in range(50) for j in range(i + 1, 50) if np.bitwise_count(words[i] ^ words[j]).sum() <= 12}


def test_nulls_and_more(spark):
    rows = [(1, "alpha beta gamma delta", "a"), (2, "Alpha, beta gamma delta!", "b"), (3, None, "c"), (4, None, "d"), (5, "", "e"), (6, "...", "f"), (None, "alpha beta gamma delta", "g"), (2, "Alpha, beta gamma delta!", "h"), (7, "other words are here", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id string")
    assert got(simhash.groups(docs)) == [(1, 1, True), (1, 2, False)]
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns and sorted(r.group_id for r in left.collect()) == ["a", "c", "d", "e", "f", "g", "i"]
    again = docs.union(docs.where("doc_id in (1, 7)")).union(docs.where("doc_id = 1")).union(spark.createDataFrame([(7, "a text of its own", "j")], docs.schema))
    assert sorted(r.group_id for r in simhash.deduplicate(again).collect()) == ["a", "c", "d", "e", "f", "g", "i", "j"]
    assert got(simhash.groups(docs.limit(0))) == [] and simhash.deduplicate(docs.limit(0)).count() == 0


def test_scripts_without_blanks(spark):
    """A Chinese and a Thai text with a few characters changed are near copies; others of their script aren't."""
    rng = random.Random(6)
    rows = []
    for low, n in ((0x4E00, 2000), (0x0E01, 40)):
        text = [chr(low + rng.randrange(n)) for _ in range(400)]
        copy = list(text)
        copy[7] = copy[200] = chr(low + 3)
        rows += ["".join(text), "".join(copy), "".join(chr(low + rng.randrange(n)) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert got(simhash.groups(docs)) == [(0, 0, True), (0, 1, False), (3, 3, True), (3, 4, False)]


def test_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 2_000_000)], "doc_id long, text string")
    assert got(simhash.groups(docs)) == [(1, 1, True), (1, 2, False)]


@pytest.mark.parametrize("count", [0, 1, 10**3, 10**6, 10**9])
def test_plan(count):
    first, tables = simhash.plan(count)
    assert count / 2**first <= 2 * simhash.TARGET or first == 0
    assert tables >= 1
