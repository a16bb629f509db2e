"""The language of documents, by averaged hashed subword embeddings and a linear softmax.

A word's features are itself and the byte runs of LENGTHS bytes in it with its ends marked, hashed into BUCKETS rows of an
embedding table. A document is the average of the embeddings of all its features; a linear softmax gives the
probabilities. Table and weights are learnt together by stochastic gradient descent in numpy. On a held-out part a temperature
is fitted that is higher for texts of few features, whose averages are less sure, and the confidence below which a document is rejected, so that of those accepted few are wrong.

The model being linear, a word's features are looked up once for each distinct word of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import Tokens, mix, slices, tokenize, utf8, word_mask

BUCKETS, DIM, LENGTHS = 1 << 16, 16, (2, 3, 4)
#: Labelled documents of a language that the model learns from, at most: those first by a hash of their id.
LEARN = 400
EPOCHS, RATE = 5, 0.5
#: Words of the parts of held-out documents that take part in calibration, and how many of each length a document gives.
PARTS, EACH = (1, 2, 4, 8, 16), 2
#: Of held-out documents that are accepted so many may be wrong, of whole ones and of those with a few words of each.
WRONG = 0.005
#: The language of a rejected document.
UNKNOWN = "und"


def word_features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words given by their bytes, and the ends of each word's features."""
    low = word_mask(raw)[1] if len(raw) else raw
    length = (end - start + 2).astype(np.int64)  # with a mark at each end
    bounds = np.concatenate([[0], np.cumsum(length)])
    text = np.full(bounds[-1], 32, dtype=np.uint64)
    inner = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    body = (inner > 0) & (inner < np.repeat(length, length) - 1)
    text[body] = low[(np.repeat(start, length) + inner - 1)[body]]
    word = np.repeat(np.arange(len(start)), length)
    left = np.repeat(length, length) - inner
    found, owner = [], []
    code = np.zeros(len(text), dtype=np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(text) < n:
            break
        code = code[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :] + np.uint64(1)
        if n in LENGTHS:
            there = left[: len(code)] >= n
            found.append(mix(code[there] + np.uint64(n << 56)))
            owner.append(word[: len(code)][there])
    with np.errstate(over="ignore"):
        whole = np.zeros(len(start), dtype=np.uint64)
        if len(start):
            powers = np.uint64(0x9E3779B97F4A7C15) * (2 * inner.astype(np.uint64) + np.uint64(1))
            whole = np.add.reduceat(mix(text + powers), bounds[:-1])
    found.append(mix(whole))
    owner.append(np.arange(len(start)))
    feature, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (feature[order] % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(np.bincount(owner, minlength=len(start)))


def distinct_words(column: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a column, for each the number of its word, and the features of the words with their ends."""
    found = tokenize(column)
    _, first, number = np.unique(found.hashes, return_index=True, return_inverse=True)
    raw, offsets = utf8(column)
    base = offsets[np.searchsorted(found.bounds, first, side="right") - 1]
    features, ends = word_features(raw, base + found.start[first], base + found.end[first])
    return found, number, features, ends


@dataclass
class Model:
    """scores: for each bucket the part of the logits that it gives; known: whether it was seen in learning; lost: the share of right held-out documents that are rejected."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    known: np.ndarray
    temperature: float = 1.0
    spread: float = 0.0
    confidence: float = 0.5
    familiar: float = 0.5
    lost: float = 0.0

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, the share of features that were seen in learning, and the number of features, of each row."""
        found, number, features, ends = distinct_words(column)
        n, k = len(found.bounds) - 1, len(self.languages)
        if not len(number) or not k:
            return np.full((n, k), 1 / max(k, 1)), np.zeros(n), np.zeros(n, dtype=np.int64)
        head = np.concatenate([[0], ends[:-1]])
        table = np.concatenate([self.scores, self.known[:, None], np.ones((BUCKETS, 1))], axis=1)
        words = np.add.reduceat(table[features], head, axis=0)
        total = np.zeros((n, k + 2))
        some = found.counts > 0
        for c in range(k + 2):
            total[some, c] = np.add.reduceat(words[number, c], found.bounds[:-1][some])
        size = np.maximum(total[:, -1], 1)
        return softmax((total[:, :k] / size[:, None] + self.bias) / self._heat(size)), total[:, k] / size, total[:, -1].astype(np.int64)

    def _heat(self, size: np.ndarray) -> np.ndarray:
        """The temperature of texts of so many features."""
        return self.temperature * np.sqrt(1 + self.spread / size)[:, None]

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The most probable language's number, of equally probable ones the first by name, its probability, and whether it is accepted."""
        p, familiar, features = self.predict(column)
        if not self.languages:
            return np.zeros(len(p), dtype=np.int64), np.zeros(len(p)), np.zeros(len(p), dtype=bool)
        best = p.argmax(axis=1)
        top = np.where(features > 0, p[np.arange(len(p)), best], 0.0)
        return best, top, (features > 0) & (top >= self.confidence) & (familiar >= self.familiar)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each row and how often each occurs."""
    found, number, features, ends = distinct_words(column)
    head = np.concatenate([[0], ends[:-1]])
    out = []
    for a, b in zip(found.bounds, found.bounds[1:]):
        words, times = np.unique(number[a:b], return_counts=True)
        parts = [features[head[w] : ends[w]] for w in words]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        weight = np.repeat(times, [len(p) for p in parts])
        ids, at = np.unique(flat, return_inverse=True)
        out.append((ids, np.bincount(at, weights=weight, minlength=len(ids))))
    return out


def fit(texts: list[str], languages: list[str], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 5) -> Model:
    """The model of labelled texts; a fifth of them is held out for temperature and rejection."""
    names = sorted(set(languages))
    rows = _counted(pa.array(texts, pa.string()))
    y = np.array([names.index(x) for x in languages], dtype=np.int64)
    used = np.flatnonzero([len(ids) > 0 for ids, _ in rows])
    rng = np.random.default_rng(seed)
    used = rng.permutation(used)
    held = used[: len(used) // 5] if len(used) >= 10 else used[:0]
    train = used[len(held) :]
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    weights, bias, known = np.zeros((dim, len(names))), np.zeros(len(names)), np.zeros(BUCKETS)
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, times = rows[i]
            share = times / times.sum()
            step = rate * (1 - steps / (epochs * len(train)))
            steps += 1
            hidden = share @ table[ids]
            error = softmax(hidden @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            table[ids] -= step * dim * np.outer(share, back)
    for i in train:
        known[rows[i][0]] = 1
    model = Model(names, table @ weights, bias, known)
    if len(held):
        short = [(" ".join(words[k : k + n]), y[i]) for i in held for words in [texts[i].split()] for n in PARTS if len(words) >= n for k in rng.integers(len(words) - n + 1, size=EACH).tolist()]
        _calibrate(model, pa.array([texts[i] for i in held], pa.string()), y[held], pa.array([x for x, _ in short], pa.string()), np.array([k for _, k in short], dtype=np.int64))
    return model


def _calibrate(model: Model, column: pa.Array, y: np.ndarray, short: pa.Array, short_y: np.ndarray) -> None:
    """Temperature by the least loss over held-out documents and parts of each; confidence by the errors among those accepted."""
    whole, familiar, size = model.predict(column)
    part, _, part_size = model.predict(short)
    size, both = np.maximum(np.concatenate([size, part_size]), 1), np.concatenate([y, short_y])
    logits = np.log(np.maximum(np.concatenate([whole, part]), 1e-300))
    places = np.arange(len(both)), both

    def loss(heat: tuple[float, float]) -> float:
        model.temperature, model.spread = heat
        return float(-np.log(np.maximum(softmax(logits / model._heat(size))[places], 1e-12)).mean())

    grid = [(float(t), c) for t in np.exp(np.linspace(np.log(0.05), np.log(5), 40)) for c in (0.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)]
    model.temperature, model.spread = min(grid, key=loss)
    p = softmax(logits / model._heat(size))
    top, right = p.max(axis=1), p.argmax(axis=1) == both
    own = slice(0, len(y))
    model.confidence = max(_limit(top, right), _limit(top[own], right[own]))
    model.lost = float((top[own][right[own]] < model.confidence).mean()) if right[own].any() else 0.0
    model.familiar = float(0.5 * familiar.min())


def _limit(top: np.ndarray, right: np.ndarray) -> float:
    """The least confidence from which on no more than the allowed share is wrong; above 1 if there is none."""
    order = np.argsort(-top, kind="stable")
    top, wrong = top[order], np.cumsum(~right[order]) / np.arange(1, len(top) + 1)
    last = np.append(top[1:] != top[:-1], True)  # equal ones are accepted together
    enough = np.flatnonzero(last & (wrong <= WRONG))
    return float(top[enough[-1]]) if len(enough) else float(np.nextafter(1, 2))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = LEARN) -> Model:
    """The model of at most so many documents of each language; rows without a language or words teach nothing. Without any, it rejects all."""
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(11), id_col).alias("h")).where(f"lang is not null and lang <> '{UNKNOWN}' and id is not null")
    names = [r.lang for r in chosen.select("lang").distinct().collect()]
    firsts = [chosen.where(F.col("lang") == x).orderBy("h", "id").limit(limit).select("id", "lang") for x in sorted(names)]
    if not firsts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS))
    ids = firsts[0]
    for x in firsts[1:]:
        ids = ids.union(x)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids.distinct()), "id").toPandas()
    rows = rows.drop_duplicates(["id", "lang"]).sort_values(["id", "lang"])
    return fit(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, best, confidence, accepted) of every row, from its whole text; language is that of the best guess, or und if it is rejected.

    Null, empty and wordless texts are rejected with confidence 0 and no best guess; a null id stays null; repeated rows each
    have a row. A text may be of any length; of equally probable languages the first by name is the guess. An empty table gives no row. Other columns aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        names = np.array([*model.languages, None], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                best, top, accepted = model.decide(part.column("text"))
                best = np.where(top > 0, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.where(accepted, names[best], UNKNOWN), pa.string()), pa.array(names[best], pa.string()), pa.array(top), pa.array(accepted)], [id_col, "language", "best", "confidence", "accepted"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` long, language string, best string, confidence double, accepted boolean")
