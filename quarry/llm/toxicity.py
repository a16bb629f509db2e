"""Toxic documents by a weighted lexicon.

Texts are folded (case, accents, lookalike letters of other scripts, digits and signs that stand for letters,
invisible characters), so that every word is lower-case Latin between single blanks. One Aho-Corasick automaton
finds all lexicon entries and exception phrases; an entry within an exception, or within several, doesn't count.
The score is the summed weight for each word of the document; documents from a threshold on are toxic.
Weights, further entries and the threshold are learnt from labelled documents where there are any.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace
from quarry.llm.tokens import slices

#: Whole words and their weights.
WORDS = {w: 1.0 for w in ("idiot", "idiotic", "moron", "moronic", "imbecile", "loser", "scum", "scumbag", "trash", "worthless", "pathetic", "disgusting", "stupid", "clown", "dumbass", "asshole", "bastard", "bitch", "bullshit", "fuck", "fucking", "fucker", "motherfucker", "shit", "shitty", "cunt", "dickhead", "douchebag", "retard", "retarded", "slut", "whore", "vermin", "subhuman")} | {w: 0.5 for w in ("dumb", "crap", "filth", "filthy", "garbage", "hate", "jerk", "ugly")}
#: Phrases in which entries are meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clown car", "circus clown", "class clown", "idiot proof", "idiot s guide", "garbage collection", "garbage collector", "garbage truck", "pond scum", "stupid simple", "dumb terminal", "dumb waiter", "hate speech detection", "no loser", "sore loser")
#: Labelled documents of each kind, at most, that the lexicon learns from: those first by a hash of their id.
LEARN_TOXIC, LEARN_CLEAN = 2000, 6000
#: The threshold where there are no labelled documents: one entry in 200 words.
THRESHOLD = 0.005
#: A learnt entry is so many times as frequent in toxic documents, and LIFT times by the lower bound of this many standard errors; it has at least so many contexts.
PURE, LIFT, ERRORS, CONTEXTS = 20.0, 4.0, 2.0, 6
PREFIX = range(4, 9)


_BLANK = ord(" ")


def _fold_table() -> np.ndarray:
    """For each code point what it becomes; a blank ends words, 0 is left out."""
    table = np.full(1 << 16, ord(" "), dtype=np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        kind = unicodedata.category(x)
        if kind in ("Mn", "Me", "Cf"):
            table[c] = 0
        elif kind[0] == "L" or kind == "Nd":
            base = unicodedata.normalize("NFKD", x.lower())
            letters = [y for y in base if unicodedata.category(y)[0] in "LN"]
            table[c] = ord(letters[0].lower()) if letters else c
    like = {
        "аạɑα": "a", "ЬƄв": "b", "сϲⅽς": "c", "ԁɗ": "d", "еєҽε": "e", "ƒ": "f", "ɡց": "g", "һհн": "h", "іıɩιї": "i", "јϳ": "j", "кκ": "k", "ⅼӏ": "l", "мⅿ": "m", "пոη": "n", "оοσօ": "o", "рρ": "p",
        "ԛզ": "q", "гг": "r", "ѕꜱ": "s", "тτ": "t", "υսц": "u", "νѵⅴ": "v", "ѡԝω": "w", "хχ×": "x", "уүγ": "y", "ᴢ": "z",
        "0": "o", "1|!": "i", "3": "e", "4@": "a", "5$": "s", "7": "t", "8": "b",
    }
    for shapes, letter in like.items():
        for x in {*shapes, *shapes.upper()}:
            if len(x) == 1:
                table[ord(x)] = ord(letter)
    for c in range(1 << 16):  # accented or capital forms of the lookalikes
        if 127 < table[c] < 1 << 16 and table[table[c]] not in (0, _BLANK):
            table[c] = table[table[c]]
    for x in "lL":  # a written 1 or | can be either; both become i
        table[ord(x)] = ord("i")
    table[table == ord("l")] = ord("i")
    more = np.full(0x110000 - (1 << 16), _BLANK, dtype=np.uint32)
    for c in (*range(1 << 16, 4 << 16), *range(14 << 16, 15 << 16)):  # no other planes have characters of their own
        x = chr(c)
        kind = unicodedata.category(x)
        if kind in ("Mn", "Me", "Cf"):
            more[c - (1 << 16)] = 0
        elif kind[0] == "L" or kind == "Nd" or kind == "So":
            letters = [y for y in unicodedata.normalize("NFKD", x.lower()) if unicodedata.category(y)[0] in "LN"]
            base = ord(letters[0].lower()) if letters else c
            if kind == "So" and not (len(letters) == 1 and letters[0].isascii() and letters[0].isalpha()):
                continue  # a sign, but for a letter in a frame
            more[c - (1 << 16)] = table[base] if base < 1 << 16 and table[base] not in (0, _BLANK) else base
    return np.concatenate([table, more])


_FOLD = _fold_table()
#: Signs that can be letters: within a word; at its end, too, but for the first two; three of one kind are none.
_SIGNS = np.array([ord(x) for x in "!|@$"], dtype=np.uint32)


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts one after another as code points, each begun and ended by a blank, and where they begin."""
    raw = np.frombuffer("".join(f"\n{x}\n" for x in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.cumsum([len(x) + 2 for x in texts], dtype=np.int64)
    out = _FOLD[raw]
    at = np.flatnonzero(np.isin(raw, _SIGNS))  # signs between lines are at neither end, for each text begins and ends with a line end
    if len(at):
        run = np.cumsum(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (raw[at[1:]] != raw[at[:-1]])])) - 1
        size, first, last = np.bincount(run)[run], at[np.searchsorted(run, run)], at[np.searchsorted(run, run, side="right") - 1]
        word = lambda x: (_FOLD[raw[x]] != _BLANK) & ~np.isin(raw[x], _SIGNS)
        ends = np.isin(raw[at], _SIGNS[:2])
        out[at[(size > 2) | ~(word(last + 1) | ~ends & word(first - 1))]] = _BLANK
    blank = out == _BLANK
    keep = out != 0
    head = np.zeros(len(raw), dtype=bool)
    head[stops[:-1]] = True
    head[:1] = True
    keep[1:] &= ~(blank[1:] & blank[:-1]) | head[1:]
    starts = np.concatenate([[0], stops])
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[starts]


def _pattern(word: str) -> str:
    return fold([word])[0].astype("<u4").tobytes().decode("utf-32-le").strip()


@dataclass
class Lexicon:
    """Weights of whole words and of beginnings of words, all folded; exception phrases; the threshold."""

    words: dict[str, float]
    prefixes: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    threshold: float = THRESHOLD

    def automaton(self) -> ahocorasick.Automaton:
        values: dict[str, float] = {}
        for w, v in self.words.items():
            for form in {_pattern(w), _pattern(w) + "s", _pattern(w) + "es"}:
                values[f" {form} "] = max(v, values.get(f" {form} ", 0.0))
        for p, v in self.prefixes.items():
            values[f" {_pattern(p)}"] = v
        single = ahocorasick.Automaton()
        for x, v in values.items():
            single.add_word(x, v)
        if values:
            single.make_automaton()
        out = ahocorasick.Automaton()
        for x, v in values.items():
            out.add_word(x, (v, len(x)))
        for x in self.exceptions:
            for form in {x, x + "s"}:
                phrase = f" {_pattern(form)} "
                if phrase not in values and values and any(True for _ in single.iter(phrase)):
                    out.add_word(phrase, (0.0, len(phrase)))
        if len(out):
            out.make_automaton()
        return out


def scores(automaton: ahocorasick.Automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, summed weight and number of words of each text; a null or wordless text scores 0."""
    codes, starts = fold([x or "" for x in texts])
    blanks = np.concatenate([[0], np.cumsum(codes == _BLANK)])
    words = np.maximum(blanks[starts[1:]] - blanks[starts[:-1]] - 1, 0)
    weight = np.zeros(len(texts))
    if len(automaton):
        hits = list(automaton.iter(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")))
        if hits:
            stop, value, size = (np.fromiter(x, dtype=t, count=len(hits)) for x, t in (((x for x, _ in hits), np.int64), ((v for _, (v, _) in hits), float), ((n for _, (_, n) in hits), np.int64)))
            start, phrase = stop - size, value == 0
            order = np.argsort(start[phrase], kind="stable")
            begins, ends = start[phrase][order], np.maximum.accumulate(np.append(np.int64(-1), stop[phrase][order]))
            counts = ~phrase & (ends[np.searchsorted(begins, start, side="right")] < stop)  # no exception that begins before ends after it
            np.add.at(weight, np.searchsorted(starts, stop[counts], side="right") - 1, value[counts])
    return weight / np.maximum(words, 1), weight, words


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = LEARN_TOXIC, clean: int = LEARN_CLEAN) -> Lexicon:
    """The lexicon with entries, weights and threshold from at most so many labelled documents of each kind.

    An entry is a word or a beginning of words; its evidence is the number of distinct words and following words
    that it occurs with, so that copies of a document count once. Without documents of both kinds it is the built-in lexicon.
    """
    base = Lexicon({w: v for w, v in WORDS.items()})
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").distinct()
    ranked = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, toxic), (0, clean))]
    work = Workspace(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ranked[0].union(ranked[1])), "id")

    def words(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, starts = fold(part.column("text").to_pylist())
                text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                found = [text[a:b].split() for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), part.column("text"), pa.array(found, pa.list_(pa.string()))], ["id", "toxic", "text", "words"])

    sample = work.store(rows.mapInArrow(words, "id long, toxic int, text string, words array<string>"), "sample")
    totals = {r.toxic: (r.docs, r.words or 0) for r in sample.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum(F.size("words")).alias("words")).collect()}
    if not all(totals.get(k, (0, 0))[1] for k in (0, 1)):
        return base
    context = sample.select("toxic", F.explode(F.arrays_zip(F.col("words"), F.slice(F.concat("words", F.array(F.lit(""))), 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))).alias("w")).select("toxic", F.col("w.words").alias("word"), F.col("w.next").alias("next")).where(F.length("word") >= PREFIX[0]).distinct()
    forms = F.concat(F.array(F.concat(F.col("word"), F.lit(" "))), *(F.when(F.length("word") >= n, F.array(F.substring("word", 1, n))).otherwise(F.array().cast("array<string>")) for n in PREFIX))
    counted = context.select("toxic", F.explode(forms).alias("form")).groupBy("form").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / totals[1][1]) - F.log((F.col("c") + 0.5) / totals[0][1])
    low = ratio - ERRORS * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = {r.form: r.low for r in counted.where(F.col("t") >= CONTEXTS).withColumn("low", low).where((F.col("low") >= float(np.log(LIFT))) & (ratio >= float(np.log(PURE)))).select("form", "low").collect()}
    prefixes: dict[str, float] = {}
    top = float(np.log(LIFT)) * 2
    for x in sorted((x for x in found if not x.endswith(" ")), key=lambda x: (len(x), x)):
        if not any(x[:n] in prefixes for n in PREFIX if n < len(x)):
            prefixes[x] = min(1.0, found[x] / top)
    words_ = {w: v for w, v in base.words.items()}
    known = {_pattern(w) for w in words_}
    prefixes = {p: v for p, v in prefixes.items() if not any(k.startswith(p) for k in known)}
    for x in (x.strip() for x in found if x.endswith(" ")):
        if x not in known and not any(x[:n] in prefixes for n in PREFIX):
            words_[x] = min(1.0, found[x + " "] / top)
    lexicon = Lexicon(words_, prefixes)
    automaton = lexicon.automaton()

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(scores(automaton, part.column("text").to_pylist())[0])], ["toxic", "score"])

    marks = [(r.score, r.toxic) for r in sample.select("toxic", "text").mapInArrow(score, "toxic int, score double").collect()]
    shares = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    lexicon.threshold = _threshold(marks, shares)
    work.drop("sample")
    return lexicon


def _threshold(marks: list[tuple[float, int]], shares: dict[int, int]) -> float:
    """The score from which on the fewest labelled documents are on the wrong side, in the middle of the gap there.

    Each kind counts by its share among all labels, so that the bounds of the sample don't matter. Without two different scores it is THRESHOLD.
    """
    marks = sorted(marks)
    x, y = np.array([m[0] for m in marks]), np.array([m[1] for m in marks])
    cuts = np.unique(x)
    if len(cuts) < 2:
        return THRESHOLD
    each = {k: shares.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    toxic, clean = np.sort(x[y == 1]), np.sort(x[y == 0])
    missed = np.searchsorted(toxic, cuts[1:]) * each[1]
    wrong = (len(clean) - np.searchsorted(clean, cuts[1:])) * each[0]
    best = int(np.argmin(missed + wrong))
    return float((cuts[best] + cuts[best + 1]) / 2)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, weight, score, toxic) of every row, in whole texts.

    Null, empty and wordless texts score 0 and aren't toxic; a null id stays null; repeated rows each have a row. A text may be of any length; one that scores just the threshold is toxic.
    An empty table gives no row. Other columns aren't looked at.
    """
    automaton, threshold = lexicon.automaton(), lexicon.threshold

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, weight, words = scores(automaton, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words), pa.array(weight), pa.array(value), pa.array((weight > 0) & (value >= threshold))], [id_col, "words", "weight", "score", "toxic"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` long, words long, weight double, score double, toxic boolean")


def reject(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic by score(), with all their columns, whatever these are called.

    Null, empty and wordless texts and null ids stay; repeated rows stay or go together; an empty table stays empty.
    """
    automaton, threshold = lexicon.automaton(), lexicon.threshold

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                value, weight, _ = scores(automaton, part.column(text_col).to_pylist())
                yield part.filter(pa.array((weight == 0) | (value < threshold)))

    return docs.mapInArrow(run, docs.schema)
