import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import wavelet as W


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 2), (1000, 50257), (70_001, 300), (32768, 7), (65536, 1)])
def test_as_the_ids(n, top):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.5, n), top - 1).astype(np.uint32)
    shard = W.Shard(W.build(ids, np.array([7, 9]), np.array([n // 2, n])))
    assert (shard.ids() == ids).all() and shard.size == n
    for token in [0, 1, 2, top - 1, top + 9]:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.locate(token) == places.tolist()
        for k in {0, len(places) // 2, len(places) - 1} & set(range(len(places))):
            assert shard.select(token, k) == places[k]
        for at in {0, n // 3, n, n + 5}:
            assert shard.rank(token, at) == (ids[:at] == token).sum()
    for place in {0, n // 2, n - 1} & set(range(n)):
        assert shard.access(place) == ids[place]
        assert shard.document(place) == ((7, place) if place < n // 2 else (9, place - n // 2))
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(1, shard.count(1))


def test_all_occurrences_of_many_tokens():
    ids = np.minimum(np.random.default_rng(4).zipf(1.3, 200_000), 999).astype(np.uint32)
    shard = W.Shard(W.build(ids, np.array([5, 6, 7]), np.array([0, 150_000, 200_000])))
    wanted = np.arange(0, 1300, 7)
    token, place = shard.locate_all(wanted)
    expected = [(t, p) for t in wanted.tolist() for p in np.flatnonzero(ids == t).tolist()]
    assert list(zip(token.tolist(), place.tolist())) == expected
    assert shard.counts_of(wanted)[0].tolist() == [int((ids == t).sum()) for t in wanted]
    doc, inner = shard.documents_at(place)
    assert (doc == np.where(place < 150_000, 6, 7)).all() and (inner == np.where(place < 150_000, place, place - 150_000)).all()


def test_lookups_unpack_few_blocks():
    ids = np.random.default_rng(0).integers(0, 50257, 1 << 19).astype(np.uint32)
    shard = W.Shard(W.build(ids, np.array([1]), np.array([len(ids)])))
    shard.access(100)
    assert len(shard._unpacked) <= 2 * shard.planes < shard.planes * shard.blocks
    with pytest.raises(ValueError):
        W.Shard(b"something else" * 4)


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = ["Hello, world's end.\n\n  It's 12 <|endoftext|> naïve", "", None, "a", "word " * 30_000, " " * 1_000_000] + [" ".join(rng.choice(["the", "cat", "séa", "123", "?!"]) for _ in range(50)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "a", 1), (None, "gone", 1)], "doc_id long, text string, shard long").repartition(3)
    made = W.shards(docs, size=3000).cache()
    enc = W.encoding()
    got = []
    for r in made.collect():
        shard = W.Shard(r.file)
        assert (r.documents, r.tokens, r.bytes) == (len(shard.documents), shard.size, len(r.file))
        ids, start = shard.ids(), 0
        for d, end in zip(shard.documents, shard.ends):
            got.append((int(d), enc.decode(ids[start:end].tolist())))
            start = end
    assert sorted(got) == sorted([(i, t or "") for i, t in enumerate(texts)] + [(3, "a")])
    token = enc.encode_ordinary(" cat")[0]
    expected = sorted((i, p) for i, t in [*enumerate(texts), (3, "a")] for p, x in enumerate(W.token_ids(enc, t or "")) if x == token)
    assert sorted((r.doc_id, r.place) for r in W.lookup(made, [token, token]).collect()) == expected
    for _ in range(2):
        files = W.write(made, f"file://{tmp_path}/shards").collect()
    assert len(list((tmp_path / "shards").iterdir())) == made.count()
    (tmp_path / "shards" / "0000.wvlt.part").write_bytes(b"unfinished")
    back = W.read(spark, f"file://{tmp_path}/shards")
    assert sorted(map(tuple, back.collect())) == sorted((r.shard, r.file) for r in made.collect())
    assert sorted((r.doc_id, r.place) for r in W.lookup(back.withColumn("token", back.shard), [token, 10**9]).collect()) == expected
    assert W.lookup(made, []).count() == 0
    assert all(W.Shard(open(f.path, "rb").read()).size >= 0 for f in files)
    assert W.shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unlike", [W.UNLIKE, 1])
def test_columns_are_tokenized_as_their_texts(monkeypatch, unlike):
    rng = random.Random(3)
    blanks = [chr(c) for c in (9, 10, 13, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2003, 0x200B, 0x2028, 0x205F, 0x3000)]
    signs = [*blanks, *" " * 20, *"abzAB019.,!?'-_é“’à€Àжя中日٣½😀\u0301⊀\0", "'s", "'ll", "don't", " the", "  ", "\n\n", "   b"]
    monkeypatch.setattr(W, "UNLIKE", unlike)
    monkeypatch.setattr(W, "KEPT", 300)
    monkeypatch.setattr(W, "PIECE", 20)
    monkeypatch.setattr(W, "BLANKS", 40)
    monkeypatch.setattr(W, "_LONG_BLANKS", re.compile(r"(\s{40})"))
    encoder = W.Encoder()
    columns = [[], [""], [None, None, "a"], [" " * 85 + "a  b" + " " * 40, "  x", "b" * 3000]]
    for _ in range(60):
        columns.append([None if rng.random() < 0.05 else "".join(rng.choice([rng.choice(signs), rng.choice(blanks) * rng.choice([1, 1, 1, 39, 41, 80])]) for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(30)])
    for texts in columns:
        ids, bounds = encoder(pa.array(texts, pa.string()))
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(ids)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [W.token_ids(encoder.enc, t or "") for t in texts]
        assert len(encoder.kept) == len(encoder.ids) <= 300


def test_words_are_tokenized_once(spark):
    """Of a corpus of few words the tokenizer gets few characters, and op4_tokens' files hold what it would have made of each text."""
    rng = random.Random(5)
    words = ["cat", "dog's", "séa", "Straße,", "(12", "3.5%)", "unbelievabilities"]
    texts = [" ".join(rng.choice(words) for _ in range(500)) for _ in range(50)]
    given, encoder = [], W.Encoder()
    plain = encoder.enc

    class Counting:
        def encode_ordinary(self, text):
            given.append(len(text))
            return plain.encode_ordinary(text)

    encoder.enc = Counting()
    for text in texts:
        assert encoder(pa.array([text]))[0].tolist() == plain.encode_ordinary(text)
    assert sum(given) < 0.01 * sum(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made, own = W.shards(docs, size=4000).collect(), W.shards(docs, size=4000, encode=plain.encode_ordinary).collect()
    assert len(made) > 2 and [tuple(r) for r in made] == [tuple(r) for r in own]
