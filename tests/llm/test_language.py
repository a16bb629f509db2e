import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import language as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ein", "ver", "ich"], "cc": ["eau", "ç", "è", "oi", "tion"]}


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        rows.append((lang, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 40)))))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(300, 1)
    return L.fit([t for _, t in rows], [x for x, _ in rows])


def test_held_out_accuracy(model):
    rows = made(300, 2)
    best, top, accepted = model.decide(pa.array([t for _, t in rows]))
    right = np.array([model.languages[k] == x for k, (x, _) in zip(best, rows)])
    assert right.mean() > 0.98 and accepted.mean() > 0.98 and right[accepted].mean() > 0.99


def test_rejection(model):
    _, top, accepted = model.decide(pa.array(["", None, "!!! ...", "zzzq wwwx qqqj vvvz 0193 8842 zzxxq"]))
    assert not accepted.any() and (top[:3] == 0).all()


def plain_features(word):
    """Features of a word one by one."""
    text = b" " + word + b" "
    out = []
    for n in L.LENGTHS:
        for i in range(len(text) - n + 1):
            code = 0
            for b in text[i : i + n]:
                code = (code * 257 + b + 1) % 2**64
            out.append((n, code))
    return len(out) + 1


def test_features():
    for word in ("a", "ka", "lorem", "éà"):
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        features, ends = L.word_features(raw, np.array([0]), np.array([len(raw)]))
        assert len(features) == ends[0] == plain_features(word.encode())
    one = L.distinct_words(pa.array(["Ka ka KA"]))
    assert len(one[3]) == 1 and (one[1] == 0).all()


def test_linear_lookup_is_the_average(model):
    """A document's scores from words are those of averaging all its features."""
    text = "kalo mitu schung kalo"
    p, _, n = model.predict(pa.array([text]))
    found, number, features, ends = L.distinct_words(pa.array([text]))
    head = np.concatenate([[0], ends[:-1]])
    every = np.concatenate([features[head[w] : ends[w]] for w in number])
    logits = (model.scores[every].mean(axis=0) + model.bias) / model.temperature
    assert n[0] == len(every) and np.allclose(p[0], L.softmax(logits))


def alike(n, seed, shares):
    """Two languages of the same syllables, in unlike shares, so that short texts are often undecidable."""
    rng = random.Random(seed)
    weights = {"xx": shares, "yy": shares[::-1]}
    rows = []
    for i in range(n):
        lang = ("xx", "yy")[i % 2]
        rows.append((lang, " ".join("".join(rng.choices(("ka", "lo", "mi", "tu", "re"), weights[lang], k=3)) for _ in range(rng.randrange(2, 40)))))
    return rows


@pytest.mark.parametrize("shares", [(5, 4, 3, 2, 1.5), (4, 3.5, 3, 2.5, 2)])
def test_rejection_keeps_its_bound(shares):
    """Of accepted texts of two languages much alike few are wrong, although many texts are undecidable."""
    rows = alike(800, 1, shares)
    model = L.fit([t for _, t in rows], [x for x, _ in rows])
    rows = alike(4000, 2, shares)
    best, _, accepted = model.decide(pa.array([t for _, t in rows]))
    right = np.array([model.languages[k] == x for k, (x, _) in zip(best, rows)])
    assert right.mean() < 0.99 and accepted.mean() > 0.2
    assert (~right[accepted]).mean() <= 3 * L.WRONG
    assert 0 < model.lost < 1


def test_confidence_as_every_threshold():
    rng = np.random.default_rng(2)
    for _ in range(40):
        top = rng.integers(50, 100, 300) / 100
        right = rng.random(300) < 0.9 + 0.1 * top
        fine = [t for t in np.unique(top) if (~right[top >= t]).mean() <= L.WRONG]
        assert L._limit(top, right) == (min(fine) if fine else np.nextafter(1, 2))


def test_steps_as_one_by_one():
    """Stochastic gradient descent over features one after another gives the same scores."""
    rows = made(9, 4)
    texts, langs = [t for _, t in rows], [x for x, _ in rows]
    model = L.fit(texts, langs, epochs=2, rate=0.3, dim=3, seed=11)
    rng = np.random.default_rng(11)
    used = rng.permutation(np.arange(9))
    table, names = rng.uniform(-1 / 3, 1 / 3, (L.BUCKETS, 3)), sorted(set(langs))
    weights, bias, steps = np.zeros((3, 3)), np.zeros(3), 0
    for _ in range(2):
        for i in rng.permutation(used):
            _, number, features, ends = L.distinct_words(pa.array([texts[i]]))
            every = [int(f) for w in number for f in features[ends[w - 1] if w else 0 : ends[w]]]
            hidden = sum(table[f] for f in every) / len(every)
            logits = np.array([sum(hidden[d] * weights[d, k] for d in range(3)) + bias[k] for k in range(3)])
            p = np.exp(logits) / np.exp(logits).sum()
            error = np.array([p[k] - (names[k] == langs[i]) for k in range(3)])
            rate = 0.3 * (1 - steps / 18)
            steps += 1
            back = [sum(weights[d, k] * error[k] for k in range(3)) for d in range(3)]
            for d in range(3):
                for k in range(3):
                    weights[d, k] -= rate * hidden[d] * error[k]
            bias -= 0.1 * rate * error
            for f in every:
                for d in range(3):
                    table[f, d] -= rate * 3 * back[d] / len(every)
    assert np.allclose(model.scores, table @ weights) and np.allclose(model.bias, bias)


def test_very_long_text_and_ties(model):
    long = "kalo " * 300_000 + "schung"
    best, top, accepted = model.decide(pa.array([long]))
    assert model.languages[best[0]] == "aa" and accepted[0]
    flat = L.Model(["b", "c"], np.zeros((L.BUCKETS, 2)), np.zeros(2), np.ones(L.BUCKETS))
    assert flat.decide(pa.array(["kalo"]))[0].tolist() == [0]


def test_query(spark):
    rows = [(i, t, x, "x") for i, (x, t) in enumerate(made(150, 3))] + [(None, "kalo mitu", "aa", ""), (900, None, "bb", ""), (901, "", None, ""), (902, "kalo", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    model = L.learn(docs)
    out = {r.doc_id: r for r in L.identify(docs.union(docs.where("doc_id = 902")), model).collect()}
    assert L.identify(docs, model).count() == len(rows)
    assert out[900].language == out[901].language == L.UNKNOWN and out[900].best is None
    assert sum(out[i].language == rows[i][2] for i in range(150)) >= 147
    assert L.identify(docs.limit(0), model).count() == 0
    empty = L.learn(docs.limit(0))
    assert {r.language for r in L.identify(docs, empty).collect()} == {L.UNKNOWN}


def test_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taught = docs.where("doc_id % 2 = 0")
    rows = L.identify(docs.where("doc_id % 2 = 1"), L.learn(taught)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    accepted = [r for r in rows if r.accepted]
    assert len(accepted) > 0.98 * len(rows)
    assert sum(r.best == r.lang for r in accepted) > 0.99 * len(accepted)
