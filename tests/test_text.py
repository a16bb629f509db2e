import itertools
import random
import re

from pyspark.sql import functions as F
import pytest

from quarry.functions import text
from quarry.operators import codec, complete


def rows(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_tokenizers(spark):
    got = rows(spark, ["a  b\tc é-Él", "", None, " ", 'x"y']).select(text.space_tokens(F.col("x")), text.alnum_tokens(F.col("x")), text.sketch_tokens(F.col("x"))).collect()
    assert got[0][0] == ["A", "B\tC", "é-ÉL"]
    assert got[0][1] == ["A", "B", "C", "é", "ÉL"]
    assert got[0][2] == ["A", "B\tC", "é", "ÉL"]
    assert [list(r) for r in got[1:4]] == [[[], [], []]] * 3
    assert got[4][0] == ['X"Y'] and got[4][1] == ["X", "Y"]


def test_unknown_tokenizer():
    with pytest.raises(ValueError):
        text.tokens(None, "other")


def test_valid_tokens(spark):
    got = rows(spark, ["A", "-", "7", "AB", "é", "--"]).where(text.is_valid(F.col("x"))).collect()
    assert [r.x for r in got] == ["A", "7", "AB", "é", "--"]


def test_stop_words():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 127
    assert {"THE", "S", "T", "DON"} <= set(text.STOP_WORDS)


def test_query_fields(spark):
    got = rows(spark, ["title=under+my+skin&ARTIST=x=y&junk&title=last", "", None]).select(text.query_fields(F.col("x"))).collect()
    assert got[0][0] == {"TITLE": "LAST", "ARTIST": "X=Y"}
    assert got[1][0] == {} and got[2][0] == {}


def test_highlight(spark):
    got = rows(spark, ["A <b> The (end)."]).select(text.highlight(F.col("x"), "the -- (end)")).first()[0]
    assert got == 'A &lt;b&gt; <span class="highlight">The</span> <span class="highlight">(end)</span>.'


def test_clean_and_split(spark):
    got = rows(spark, ["a-b,  c\n\nd"]).select(text.clean(F.col("x"))).first()[0]
    assert got == "ab c d"
    assert rows(spark, ["abcdefg"]).select(text.split_long(F.col("x"), 3)).first()[0] == ["abc", "def", "g"]


def plain_fnv(value):
    h = 0xCBF29CE484222325
    for i in range(8):
        h = ((h ^ (value >> 8 * i & 255)) * 0x100000001B3) % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def plain_vbyte(value):
    out = []
    while value > 127:
        out.append(value % 128 + 128)
        value //= 128
    return bytes([*out, value]).hex().upper()


def test_codes(spark):
    values = [0, 1, 127, 128, 16383, 16384, 123456789, (1 << 53) + 1, (1 << 62) + 12345, (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.vbyte(F.col("v")), codec.vbyte_length(F.col("v")), codec.fnv1a(F.col("v"))).collect()
    for v, code, length, h in got:
        assert code == plain_vbyte(v) and length == len(code) // 2 and h == plain_fnv(v)


def test_run_lengths(spark):
    freq = [1] * 300 + [2, 1, 1]
    postings = spark.createDataFrame([("f", "T", i, t) for i, t in enumerate(freq)], "field string, term string, doc_id long, tf int")
    got = [(r.run, r.tf, r.length) for r in codec.run_lengths(postings).orderBy("run").collect()]
    assert got == [(1, 1, 255), (2, 1, 45), (3, 2, 1), (4, 1, 2)]
    assert [r.gap for r in codec.delta_gaps(postings).orderBy("doc_id").collect()] == [0] + [1] * 302


TRIE = [("ostritch", 24, 3), ("test", 420, 2), ("testing", 69, 2), ("tes", 24, 2), ("waddup", 54, 4), ("newting", 44, 5), ("tosting", 69, 2), ("toaster", 84, 2), ("magisterialness", 64, 6), ("abracadabra", 121, 7), ("rapper", 85, 8), ("apple", 25, 2), ("apocryphol", 25, 2), ("apacryphol", 25, 2), ("apicryphol", 25, 2), ("eager", 25, 2), ("mantequilla", 25, 2), ("initial", 25, 2), ("initial", 32, 2), ("", 1, 99)]


def test_terms(spark):
    terms = complete.Terms(spark)
    for key, value, score in TRIE:
        terms.insert(key.encode() if key == "apple" else key, value, score)
    assert len(terms) == 18
    assert terms.find("initial") == 32 and terms.find(b"tes") == 24 and terms.find("testin") is None
    assert terms.prefix("tes") == [("tes", 24), ("test", 420), ("testing", 69)]
    assert [k for k, _, _ in terms.complete("", 3)] == ["rapper", "abracadabra", "magisterialness"]
    assert [k for k, _, _ in terms.complete("ap", 2)] == ["apacryphol", "apicryphol"]
    with pytest.raises(TypeError):
        terms.insert(5, 1)


def test_complete_all(spark):
    terms = spark.createDataFrame([("ab", 1.0), ("abc", 3.0), ("b", 2.0), ("ba", 2.0)], "key string, score double")
    prefixes = spark.createDataFrame([("a",), ("ab",), ("b",), ("x",)], "prefix string")
    got = {(r.prefix, r.rank, r.key) for r in complete.complete_all(terms, prefixes, 2).collect()}
    assert got == {("a", 1, "abc"), ("a", 2, "ab"), ("ab", 1, "abc"), ("ab", 2, "ab"), ("b", 1, "b"), ("b", 2, "ba")}
    assert complete.complete_all(terms, prefixes.limit(0), 2).count() == 0


def test_bloom_sizes(spark):
    assert codec.bloom_hashes(1e-7) == 23
    assert spark.range(1).select(codec.bloom_bits(F.lit(50000), 1e-7)).first()[0] == 1677386


def test_tokens_of_mixed_texts(spark):
    """Texts and words of ASCII only, and others, are folded in different ways, but alike."""
    rows = ["the Cat's  mat-2", "é Straße ǆ ok-no", "", None, " ", "ÀbC dé.f", "ĳ ı ſ k", "中文 ab 字cd"]
    up = lambda x: "".join(c.upper() if c.isascii() else c for c in x or "")
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("t", text.space_tokens(F.col("t")), text.alnum_tokens(F.col("t")), text.sketch_tokens(F.col("t")), text.ascii_upper(F.col("t"))).collect()
    for t, space, alnum, sketched, upper in got:
        assert upper == up(t) and space == [x for x in up(t).split(" ") if x]
        assert alnum == [x for x in re.split(text.NOT_ALNUM, up(t)) if x] and sketched == [x for x in re.split(text.NOT_SKETCH, up(t)) if x]


def test_lists_of_terms_are_sorted_once(spark):
    """Runs and gaps of several terms against plain Python; encoding shuffles and sorts the postings once."""
    rng = random.Random(4)
    lists = {t: [(d, rng.choice([1, 1, 1, 2])) for d in sorted(rng.sample(range(2000), n))] for t, n in (("A", 900), ("B", 1), ("C", 300))}
    lists["D"] = [(d, 3) for d in range(511)]
    rows = [("f", t, d, tf) for t, own in lists.items() for d, tf in own]
    postings = spark.createDataFrame(rng.sample(rows, len(rows)), "field string, term string, doc_id long, tf int")
    runs = codec.run_lengths(postings)
    got = {}
    for r in sorted(runs.collect(), key=lambda r: (r.term, r.run)):
        got.setdefault(r.term, []).append((r.tf, r.length))
    for t, own in lists.items():
        expected = []
        for tf, group in itertools.groupby(tf for _, tf in own):
            n = len(list(group))
            expected += [(tf, 255)] * (n // 255) + [(tf, n % 255)] * (n % 255 > 0)
        assert got[t] == expected
    plan = codec.run_lengths(postings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.term, r.place, r.tf) for r in codec.from_run_lengths(runs).collect()) == sorted((t, n, tf) for t, own in lists.items() for n, (_, tf) in enumerate(own, 1))
    gaps = codec.numbered_gaps(postings)
    assert gaps._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.term, r.doc_id) for r in codec.from_gaps(gaps.drop("doc_id")).collect()) == sorted((t, d) for t, own in lists.items() for d, _ in own)
