from itertools import product

import numpy as np
import pytest

from quarry.llm import packing
from quarry.llm.wavelet import encoding


def fewest(sizes, capacity):
    """The fewest bins by trying every assignment."""
    for n in range(1, len(sizes) + 1):
        for where in product(range(n), repeat=len(sizes) - 1):
            fill = [0] * n
            for s, b in zip(sizes, (0, *where)):
                fill[b] += s
            if max(fill) <= capacity:
                return n
    return 0


def check(sizes, capacity):
    bins = packing.pack(np.array(sizes), capacity)
    fill = np.bincount(bins, weights=sizes)
    assert len(bins) == len(sizes) and fill.max() <= capacity and fill.min() > 0
    return fill


@pytest.mark.parametrize("seed", range(12))
def test_as_few_bins_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    capacity = 20
    sizes = rng.integers(1, capacity + 1, 7).tolist()
    assert len(check(sizes, capacity)) == fewest(sizes, capacity)


def improvable(sizes, bins, capacity):
    """Whether a move or an exchange between underfull bins raises the sum of squared fills."""
    fill = np.bincount(bins, weights=sizes)
    n = len(fill)
    for a, b in product(range(n), repeat=2):
        if a == b or fill[a] == capacity or fill[b] == capacity:
            continue
        own, other = [i for i in range(len(sizes)) if bins[i] == a], [i for i in range(len(sizes)) if bins[i] == b]
        given = [sizes[i] for i in own] + [sizes[i] + sizes[j] for i in own for j in own if i < j]
        singles = [sizes[i] for i in other]
        for k, g in enumerate(given):
            taken = [0, *singles] if k < len(own) else singles
            if k < len(own):
                taken = taken + [sizes[i] + sizes[j] for i in other for j in other if i < j]
            for t in taken:
                moved = g - t
                if 0 < moved <= capacity - fill[b] and fill[b] - fill[a] + moved > 0:
                    return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_no_step_is_left(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(5, 60, 60)
    bins = packing.pack(sizes, 100)
    assert bins.max() + 1 == -(-sizes.sum() // 100) or not improvable(sizes.tolist(), bins, 100)


def test_search_betters_best_fit():
    rng = np.random.default_rng(1)
    fewer = 0
    for _ in range(30):
        sizes = rng.integers(20, 55, 40)
        fewer += len(packing.best_fit(sizes, 100)) - len(check(sizes, 100))
    assert fewer > 0


@pytest.mark.parametrize("seed", range(4))
def test_sums_of_a_bin(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 9, 30)
    items = rng.permutation(30)[: 2 + 4 * seed]
    (single, one, _), (double, left, right) = packing._sums(items, sizes)
    assert single.tolist() == sorted({int(sizes[i]) for i in items}) and (sizes[one] == single).all()
    assert double.tolist() == sorted({int(sizes[i] + sizes[j]) for i in items for j in items if i != j})
    assert (sizes[left] + sizes[right] == double).all() and (left != right).all() and set(left) | set(right) <= set(items)


def test_many_alike_items_need_little_memory():
    """A thousand bins of nine-token texts: no table of all their pairs is made."""
    import tracemalloc

    tracemalloc.start()
    fill = np.bincount(packing.pack(np.full(232_448, 9), 2048)) * 9
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert len(fill) == 1024 and fill.max() == 2043


def test_all_pieces_of_all_documents(spark):
    enc = encoding()
    texts = ["a b c", "", None, "x " * 25, "one, two!", "a b c", " \n", " " * 30_000]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, tokens long, bin_id int")
    given = docs.union(docs.limit(1))
    rows = packing.packed(given, capacity=10).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.tokens) for r in rows)
    expected = []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        n = len(enc.encode_ordinary(t)) if t and len(t) <= 10_000 else 3 * len(enc.encode_ordinary(" " * 10_000)) if t else 0
        expected += [(-1 if i == 4 else i, p, 10 * p, min(10, n - 10 * p)) for p in range(-(-n // 10))]
    assert got == sorted(expected)
    fill = {}
    for r in rows:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.tokens
    assert max(fill.values()) <= 10
    assert packing.packed(docs.limit(0)).count() == 0
    assert packing.packed(docs, capacity=10, length_col="tokens").count() == 8
    with pytest.raises(ValueError):
        packing.packed(docs, capacity=0)


def test_repeated_rows_are_spread(spark):
    """Rows that repeat an id and a text, and the pieces of one long document, don't meet in one group."""
    docs = spark.createDataFrame([(1, 30)] * 2000 + [(None, 30)] * 1000 + [(2, 60_000)], "doc_id long, n long")
    rows = packing.packed(docs, capacity=100, bins=50, length_col="n").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.bin_id >> 32, []).append(r.tokens)
    assert len(groups) > 20 and sum(map(len, groups.values())) == 3600
    assert max(map(sum, groups.values())) < 2 * 100 * 50


def test_groups_cover_everything(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(1 + id * 7 % 90 as int) as n")
    rows = packing.packed(docs, capacity=100, bins=50, length_col="n").collect()
    assert len(rows) == 3000 and len({r.bin_id >> 32 for r in rows}) > 10
    total = sum(r.tokens for r in rows)
    assert len({r.bin_id for r in rows}) < 1.06 * total / 100
