import math
import random

import pytest

from quarry.llm import toxicity as T

LEXICON = T.Lexicon({"idiot": 1.0, "scum": 0.5, "trash": 1.0}, {"vilen": 1.0}, ("trash can", "pond scum", "can idiot", "scum trash can"), 0.1)


def plain(text):
    """Score by looking at one folded word after another."""
    codes, starts = T.fold([text or ""])
    words = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split()
    weight, i = 0.0, 0
    entries = {f: v for w, v in LEXICON.words.items() for f in (T._pattern(w), T._pattern(w + "s"), T._pattern(w) + "es")}
    exempt = [tuple(T._pattern(x).split()) for e in LEXICON.exceptions for x in (e, e + "s")]
    for i, w in enumerate(words):
        value = entries.get(w, 0.0) + sum(v for p, v in LEXICON.prefixes.items() if w.startswith(T._pattern(p)))
        for e in exempt:
            for k in range(len(e)):
                if i - k >= 0 and tuple(words[i - k : i - k + len(e)]) == e:
                    value = 0.0
        weight += value
    return weight, len(words)


@pytest.mark.parametrize("text", ["You idiot", "IDIOTS!", "1d10t", "idіоt", "ídiòt", "i​diot", "tra$h", "an idiotic idea", "trash cans and trash", "pond scum, scum", "vilenesses vilen", "", "!!!", "Tom is", "@ home 4 you", "trash can idiot scum", "pond scum trash can idiot idiot", "you idiot\U0001f600", "\U0001f621idiot\U0001f621", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "scum 中文\U00020000 idiot"])
def test_as_plain(text):
    value, weight, words = T.scores(LEXICON.automaton(), [text])
    expected, n = plain(text)
    assert weight[0] == pytest.approx(expected) and words[0] == n and value[0] == pytest.approx(expected / max(n, 1))


def test_random_texts():
    rng = random.Random(1)
    parts = ["idiot", "1d1ot", "trash", "can", "cans", "pond", "scum", "vilenX", "fine", "word", "-", "ok"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)]
    _, weight, words = T.scores(LEXICON.automaton(), texts)
    for t, w, n in zip(texts, weight, words):
        assert (pytest.approx(w), n) == plain(t)


def test_overlapping_exceptions_cancel_once():
    lexicon = T.Lexicon(dict(T.WORDS))
    _, weight, _ = T.scores(lexicon.automaton(), ["circus clown car idiot", "circus clown car", "clown"])
    assert weight.tolist() == [1.0, 0.0, 1.0]


def test_threshold_as_every_cut():
    """The least cost over all cuts between two scores, each kind weighted by its share among all labels."""
    rng = random.Random(3)
    for _ in range(50):
        marks = [(rng.randrange(12) / 10, int(rng.random() < 0.4)) for _ in range(rng.randrange(2, 40))]
        shares = {0: rng.randrange(1, 1000), 1: rng.randrange(1, 1000)}
        values = sorted({x for x, _ in marks})
        if len(values) < 2:
            assert T._threshold(marks, shares) == T.THRESHOLD
            continue
        n = {k: max(1, sum(y == k for _, y in marks)) for k in (0, 1)}
        cost = lambda c: sum(shares[1] / n[1] for x, y in marks if y and x < c) + sum(shares[0] / n[0] for x, y in marks if not y and x >= c)  # noqa: E731, B023
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        assert cost(T._threshold(marks, shares)) == pytest.approx(min(map(cost, cuts)))


def test_learnt_entries_as_counted_one_by_one(spark):
    """Entries and weights by plain counting of distinct words and following words."""
    rng = random.Random(8)
    common = [f"wort{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(120):
        toxic = i % 3 == 0
        text = [rng.choice(common) for _ in range(25)]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grobix", "grobixen", "Gr0bixa", "flumm"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    found = T.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    pairs, totals = {0: set(), 1: set()}, [0, 0]
    for (_, text), (_, k) in zip(rows, marks):
        codes, _ = T.fold([text])
        words = codes.astype("<u4").tobytes().decode("utf-32-le").split()
        totals[k] += len(words)
        pairs[k] |= {(w, n) for w, n in zip(words, [*words[1:], ""]) if len(w) >= 4}
    counts = {}
    for k in (0, 1):
        for w, _ in pairs[k]:
            for form in {w + " ", *(w[:n] for n in T.PREFIX if len(w) >= n)}:
                counts.setdefault(form, [0, 0])[k] += 1
    fine = {}
    for form, (c, t) in counts.items():
        ratio = math.log((t + 0.5) / totals[1]) - math.log((c + 0.5) / totals[0])
        low = ratio - T.ERRORS * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= T.CONTEXTS and low >= math.log(T.LIFT) and ratio >= math.log(T.PURE):
            fine[form] = min(1.0, low / (2 * math.log(T.LIFT)))
    starts = {f: v for f, v in fine.items() if not f.endswith(" ") and not any(g != f and f.startswith(g) for g in fine if not g.endswith(" "))}
    assert starts and {f[:4] for f in starts} == {T._pattern("grob"), T._pattern("flum")}
    assert found.prefixes == pytest.approx(starts)
    assert {w for w in found.words if w not in T.WORDS} == {f.strip() for f in fine if f.endswith(" ") and not any(f.startswith(g) for g in starts)}


def test_disguises_fold_alike():
    for x in ("id1ot", "IDIOT", "ｉｄｉｏｔ", "ídiot", "іdіоt", "!diot"):
        assert T._pattern(x) == T._pattern("idiot")
    for x, y in (("wow!", "wow"), ("wow!!!", "wow"), ("a$$hole", "asshole"), ("pi$$", "piss"), ("$cum", "scum"), ("scum$", "scums"), ("scum$$$", "scum"), ("@ $ !", ""), ("m0r0n@@@x", "moron x"), ("8a5tard", "bastard"), ("@", "")):
        assert T._pattern(x) == T._pattern(y), x


def test_every_row_has_a_score(spark):
    rows = [(1, "you idiot", 1), (2, None, 2), (3, "", 3), (None, "scum", 4), (1, "you idiot", 5), (4, "fine words " * 100_000 + "idiot", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight long")
    got = sorted(T.score(docs, LEXICON).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.words, r.toxic) for r in got] == [(1, 2, True), (1, 2, True), (2, 0, False), (3, 0, False), (4, 200_001, False), (None, 1, True)]
    left = T.reject(docs, LEXICON)
    assert left.columns == docs.columns and sorted(r.weight for r in left.collect()) == [2, 3, 6]
    assert T.score(docs.limit(0), LEXICON).count() == 0 and T.reject(docs.limit(0), LEXICON).count() == 0


def test_learning(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(300):
        text = [f"w{rng.randrange(200)}" for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for x in ["blorkish", "blorkian", "worthless"][: rng.randrange(2, 4)]:
                text.insert(rng.randrange(60), x)
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    lexicon = T.learn(docs.where("doc_id % 2 = 0"), labels)
    got = {r.doc_id: r.toxic for r in T.score(docs.where("doc_id % 2 = 1"), lexicon).collect()}
    truth = dict(marks)
    assert sum(got[d] == bool(truth[d]) for d in got) >= 0.97 * len(got)
    assert T.learn(docs, labels.limit(0)).words.keys() == T.WORDS.keys()
    assert T.learn(docs.limit(0), labels).threshold == T.THRESHOLD


def test_labelled_tables(spark):
    """Held-out documents of the tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = T.learn(docs, labels.where("doc_id % 2 = 0"))
    rows = T.score(docs, lexicon).join(labels.where("doc_id % 2 = 1 and toxic is not null").select("doc_id", F_toxic()), "doc_id").collect()
    toxic, clean = [r for r in rows if r.truth], [r for r in rows if not r.truth]
    assert sum(r.toxic for r in toxic) >= 0.9 * len(toxic) and sum(r.toxic for r in clean) <= 0.02 * len(clean)


def F_toxic():
    from pyspark.sql import functions as F

    return F.col("toxic").alias("truth")


def test_code_points_beyond_the_first_plane():
    automaton = T.Lexicon(dict(T.WORDS)).automaton()
    bold = "".join(chr(0x1D41A + ord(c) - ord("a")) for c in "idiot")
    script = "".join(chr(0x1D4D0 + ord(c) - ord("A")) for c in "IDIOT")
    framed = "".join(chr(0x1F130 + ord(c) - ord("A")) for c in "IDIOT")
    toxic = ["you idiot\U0001f621", "\U0001f621idiot", "idi\U000e0100ot", f"a {bold}!", script, framed, "idi\U0001d7ced", "sh\U0001d7cft", "shi\U0001d7d5", "a$$h0le\U0001f621"]
    expected = [1, 1, 1, 1, 1, 1, 0, 1, 1, 1]
    assert T.scores(automaton, toxic)[1].tolist() == expected
    assert T.scores(automaton, ["\U00020000idiot", "\U00020000 \U00020001", "\U0001f621"])[2].tolist() == [1, 2, 0]
    assert T.scores(automaton, ["\U00020000idiot"])[1].tolist() == [0]
