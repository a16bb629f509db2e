"""Token ids of a corpus as wavelet matrices, one compressed file for each shard.

A wavelet matrix has a plane of bits for each bit of the ids, the highest first; after a plane the ids are
stably parted into those with 0 and those with 1. With the ones counted up to each block, rank and select on the planes give the
token at a place, how often a token occurs up to a place, and the place of each occurrence, without the ids themselves.
A file holds the planes in blocks that are compressed for themselves, so a lookup unpacks only the blocks that it meets.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tokens import slices, utf8

#: Ids of a shard, about; bits of a block (a power of two, 1 << 15 at most).
SHARD, BLOCK = 1 << 20, 1 << 15
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space characters in a row that the tokenizer meets at once, at most.
BLANKS = 10_000
_LONG_BLANKS = re.compile(rf"(\s{{{BLANKS}}})")
#: Pieces of texts whose ids a process keeps, at most, bytes of such a piece, and bytes of texts that are cut together, about.
KEPT, PIECE, COLUMN = 1 << 17, 64, 1 << 22
UNLIKE = 0.5
_MAGIC = b"WVLT0001"
#: Bytes that are white space for the tokenizer, for it or for BLANKS, and those that may be the last two of white space beyond ASCII.
_SPACE, _BLANK, _LAST, _LAST_BUT_ONE = (np.isin(np.arange(256), x) for x in ([*range(9, 14), 32], [*range(9, 14), *range(28, 33)], [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0xC2, 0x80, 0x81, 0x9A]))
#: ASCII letters and digits, and signs.
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
_SIGN = np.isin(np.arange(256), range(33, 127)) & ~_WORD
#: Ones of each byte, and the place of each of them, from the highest bit on.
_EIGHT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_BEFORE = np.arange(0, BLOCK + 1, 8, dtype=np.uint16)
_ONES, _PLACE = _EIGHT.sum(axis=1, dtype=np.uint8), np.argsort(1 - _EIGHT, axis=1, kind="stable").astype(np.uint8)


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    """The public byte-level tokenizer of a file of ranks; special tokens in a text are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def size_of(vocabulary: str = VOCABULARY) -> int:
    """One more than the greatest id."""
    return encoding(vocabulary).n_vocab


def token_ids(enc, text: str) -> list[int]:
    """The ids of a text. White space of more than BLANKS characters in a row is cut there, for the pattern looks back over all of it."""
    if len(text) <= BLANKS or not (parts := _LONG_BLANKS.split(text))[1:]:
        return enc.encode_ordinary(text)
    return [x for part in parts if part for x in enc.encode_ordinary(part)]


class Encoder:
    """token_ids() for columns: texts are cut into pieces whose ids don't depend on their neighbours, and each distinct piece is tokenized once.

    The pattern never runs from other characters into white space, nor from a letter or digit into a sign, so a text may be cut there; where that isn't plain from
    the bytes, it isn't cut. Short pieces are kept from column to column, KEPT at most; if there are more, those of the last column stay.
    A column of which more than UNLIKE of the pieces are met for the first time is tokenized text by text, which costs less then.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        self.enc = encoding(vocabulary)
        self.lengths = np.zeros(self.enc.n_vocab, dtype=np.int64)
        for token in self.enc.token_byte_values():
            self.lengths[self.enc.encode_single_token(token)] = len(token)
        self.kept, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.uint32()))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after another, and where each row's begin and end; null rows are empty."""
        raw, offsets = utf8(column)
        starts = _piece_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        place = pc.index_in(pieces.dictionary, value_set=self.kept)
        if place.null_count > UNLIKE * len(pieces):
            rows = [np.array(token_ids(self.enc, x or ""), dtype=np.uint32) for x in column.to_pylist()]
            return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        ids = self._of(pieces.dictionary, place).take(pieces.indices)
        return ids.flatten().to_numpy(), _bounds(ids)[np.searchsorted(starts, offsets)]

    def _of(self, pieces: pa.Array, place: pa.Array) -> pa.Array:
        """The ids of each of these distinct pieces, of which some have a place among the kept ones."""
        new = pieces.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().copy()
        place[place < 0] = len(self.kept) + np.arange(len(new))
        made = self._encoded(new)
        ids = pa.concat_arrays([self.ids, made]).take(pa.array(place))
        if len(self.kept) + len(new) > KEPT:
            stay = pa.array(_short(pieces) & (np.arange(len(pieces)) < KEPT))
            self.kept, self.ids = pieces.filter(stay), ids.filter(stay)
        elif len(new):
            stay = pa.array(_short(new))
            self.kept, self.ids = pa.concat_arrays([self.kept, new.filter(stay)]), pa.concat_arrays([self.ids, made.filter(stay)])
        return ids

    def _encoded(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces, by the tokenizer: of those that begin with white space and don't end with it as one text, whose ids are parted by their lengths."""
        raw, offsets = utf8(pieces)
        last = raw[offsets[1:] - 1]
        joined = _short(pieces) & _SPACE[raw[offsets[:-1]]] & ~_BLANK[last] & ~(_LAST[last] & _LAST_BUT_ONE[raw[offsets[1:] - 2]])
        text, stops = utf8(pieces.filter(pa.array(joined)))
        ids = np.array(self.enc.encode_ordinary(text.tobytes().decode()), dtype=np.uint32)
        bounds = np.searchsorted(np.cumsum(self.lengths[ids]), stops, side="right")
        others = pa.array([token_ids(self.enc, x) for x in pieces.filter(pa.array(~joined)).to_pylist()], pa.large_list(pa.uint32()))
        order = np.empty(len(pieces), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])] = np.arange(len(pieces))
        return pa.concat_arrays([pa.LargeListArray.from_arrays(bounds, ids), others]).take(pa.array(order))


def _short(pieces: pa.Array) -> np.ndarray:
    return np.diff(utf8(pieces)[1]) <= PIECE


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list begins and ends among the values of all."""
    at = lists.offsets.to_numpy()
    return at - at[0]


def _piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which a row begins, or white space after a character that is none, or a sign after a letter or digit of ASCII."""
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = _SPACE[raw[1:]] & ~_BLANK[raw[:-1]]
    wide = np.flatnonzero(cut[1:] & (raw[:-1] >= 0x80)) + 1
    cut[wide[_LAST[raw[wide - 1]] & _LAST_BUT_ONE[raw[wide - 2]]]] = False
    cut[1:] |= _SIGN[raw[1:]] & _WORD[raw[:-1]]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for all tasks of a process."""
    return Encoder(vocabulary)


def build(ids: np.ndarray, documents: np.ndarray, ends: np.ndarray, level: int = 6) -> bytes:
    """The file of a shard: ids of all its documents, one after another, the documents' own ids, and where each ends."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, counts, blocks = [], [], []
    now, after, ones = ids, np.empty_like(ids), np.empty_like(ids)
    for p in range(planes - 1, -1, -1):
        bit, low, high = np.uint32(1 << p), 0, [0]
        for k in range(0, len(ids), BLOCK):
            block = now[k : k + BLOCK]
            bits = (block & bit) != 0
            blocks.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            one, zero = np.flatnonzero(bits), np.flatnonzero(~bits)
            high.append(high[-1] + len(one))
            np.take(block, one, out=ones[high[-2] : high[-1]], mode="clip")
            np.take(block, zero, out=after[low : low + len(zero)], mode="clip")
            low += len(zero)
        counts.append(high)
        zeros.append(low)
        after[low:] = ones[: high[-1]]
        now, after = after, (np.empty_like(ids) if now is ids else now)
    parts = [np.asarray(documents, dtype="<i8").tobytes(), np.asarray(ends, dtype="<i8").tobytes(), np.asarray(zeros, dtype="<i8").tobytes(), np.asarray(counts, dtype="<i8").tobytes()]
    head = zlib.compress(b"".join(parts), level)
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8").tobytes()
    return b"".join([_MAGIC, struct.pack("<QQIQ", len(ids), len(documents), planes, len(head)), head, places, *blocks])


def _groups(blocks: np.ndarray, chosen: np.ndarray | None = None) -> Iterable[tuple[int, np.ndarray]]:
    """Each block among them, and where it stands, but for those that aren't chosen."""
    order = np.argsort(blocks, kind="stable")
    if chosen is not None:
        order = order[chosen[order]]
    if len(order):
        for here in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            yield int(blocks[here[0]]), here


class Shard:
    """A file that build() wrote: access, rank, select, count and locate. Blocks are unpacked when they are met."""

    def __init__(self, file: bytes):
        if file[:8] != _MAGIC:
            raise ValueError("not a file of token ids")
        self.file = memoryview(file)
        self.size, n, self.planes, head = struct.unpack_from("<QQIQ", file, 8)
        at = 8 + struct.calcsize("<QQIQ")
        values = np.frombuffer(zlib.decompress(self.file[at : at + head]), dtype="<i8")
        self.documents, self.ends, self.zeros, counts = np.split(values, np.cumsum([n, n, self.planes]))
        self.counts = counts.reshape(self.planes, -1)
        self.blocks = self.counts.shape[1] - 1
        at += head
        self.places = np.frombuffer(self.file[at : at + 8 * (self.planes * self.blocks + 1)], dtype="<i8") + at + 8 * (self.planes * self.blocks + 1)
        self._unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of bits of a block, zeros after the last, and the ones before each byte."""
        k = plane * self.blocks + block
        if k not in self._unpacked:
            raw = np.zeros(BLOCK // 8, dtype=np.uint8)
            there = zlib.decompress(self.file[self.places[k] : self.places[k + 1]])
            raw[: len(there)] = np.frombuffer(there, dtype=np.uint8)
            ones = np.zeros(BLOCK // 8 + 1, dtype=np.uint16)
            np.cumsum(_ONES[raw], dtype=np.uint16, out=ones[1:])
            self._unpacked[k] = raw, ones
        return self._unpacked[k]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        return np.unpackbits(self._block(plane, block)[0])[: min(BLOCK, self.size - block * BLOCK)]

    def _bit(self, plane: int, place: int) -> int:
        inside = place % BLOCK
        return int(self._block(plane, place // BLOCK)[0][inside // 8]) >> (7 - inside % 8) & 1

    def _rank1(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        return int(self._ranks(plane, np.array([place]))[0])

    def _ranks(self, plane: int, places: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place; each block is met once for all places in it."""
        block, inside = places // BLOCK, places % BLOCK
        out = self.counts[plane, block]
        for b, here in _groups(block, inside > 0):
            raw, ones = self._block(plane, b)
            byte, bit = inside[here] // 8, inside[here] % 8
            out[here] += ones[byte] + _ONES[raw[byte] & ((0xFF00 >> bit) & 0xFF)]
        return out

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the bit's occurrence k, from 0."""
        return int(self._selects(plane, bit, np.array([k]))[0])

    def _selects(self, plane: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """The place of each of the bit's occurrences, from 0."""
        ones = self.counts[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.size) - ones
        block = np.searchsorted(before, ks, side="right") - 1
        out = np.zeros(len(ks), dtype=np.int64)
        for b, here in _groups(block):
            raw, ones = self._block(plane, b)
            ones = ones if bit else _BEFORE - ones
            k = ks[here] - int(before[b])
            byte = np.searchsorted(ones, k.astype(np.uint16), side="right") - 1
            out[here] = b * BLOCK + byte * 8 + _PLACE[raw[byte] if bit else ~raw[byte], k - ones[byte]]
        return out

    def access(self, place: int) -> int:
        """The token at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        token = 0
        for p in range(self.planes):
            bit = self._bit(p, place)
            ones = self._rank1(p, place)
            token = token << 1 | bit
            place = int(self.zeros[p]) + ones if bit else place - ones
        return token

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for p in range(self.planes):
            a, b = self._rank1(p, start), self._rank1(p, stop)
            start, stop = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (start - a, stop - b)
        return start, stop

    def rank(self, token: int, place: int) -> int:
        """Occurrences of a token before a place."""
        if token < 0 or token >> self.planes:
            return 0
        start, stop = self._range(token, 0, min(max(place, 0), self.size))
        return stop - start

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """The place of a token's occurrence k, from 0."""
        start, stop = self._range(token, 0, self.size) if 0 <= token < 1 << self.planes else (0, 0)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        place = start + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            place = self._select(p, bit, place - int(self.zeros[p]) * bit)
        return place

    def _back(self, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places after the last plane, of such tokens, as places in the text."""
        places = places.copy()
        for p in range(self.planes - 1, -1, -1):
            bits = tokens >> (self.planes - 1 - p) & 1
            for bit in (0, 1):
                here = np.flatnonzero(bits == bit)
                if len(here):
                    places[here] = self._selects(p, bit, places[here] - int(self.zeros[p]) * bit)
        return places

    def counts_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each token occurs, and where its places begin after the last plane: two ranks a plane for all tokens together."""
        start, stop = np.zeros(len(tokens), dtype=np.int64), np.full(len(tokens), self.size, dtype=np.int64)
        for p in range(self.planes):
            a, b = self._ranks(p, start), self._ranks(p, stop)
            bit = (tokens >> (self.planes - 1 - p) & 1).astype(bool)
            zeros = int(self.zeros[p])
            start, stop = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, stop - b)
        known = (tokens >= 0) & (tokens >> self.planes == 0)
        return np.where(known, stop - start, 0), start

    def locate_all(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, place) of every occurrence of distinct tokens, by token, then place; the places of all go back plane by plane together."""
        tokens = np.asarray(tokens, dtype=np.int64)
        number, start = self.counts_of(tokens)
        owner = np.repeat(tokens, number)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        return owner, self._back(owner, np.repeat(start, number) + inner)

    def locate(self, token: int) -> list[int]:
        """The places of all occurrences, in order."""
        return self.locate_all(np.array([token]))[1].tolist()

    def documents_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document that each place is in, and the place in it."""
        k = np.searchsorted(self.ends, places, side="right")
        return self.documents[k], places - np.where(k > 0, self.ends[k - 1], 0)

    def document(self, place: int) -> tuple[int, int]:
        """The document that a place is in, and the place in it."""
        k = int(np.searchsorted(self.ends, place, side="right"))
        return int(self.documents[k]), place - int(self.ends[k - 1] if k else 0)

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last, in which they are in order of bits."""
        bits = [np.concatenate([self._bits(p, b) for b in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8) for p in range(self.planes)]
        out = np.zeros(self.size, dtype=np.uint32)
        for p in range(self.planes - 1, -1, -1):
            one = bits[p].astype(bool)
            back = np.empty(self.size, dtype=np.uint32)
            back[~one], back[one] = out[: int(self.zeros[p])], out[int(self.zeros[p]) :]
            out = back | one.astype(np.uint32) << np.uint32(self.planes - 1 - p)
        return out


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, size: int = SHARD, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """(shard, documents, tokens, bytes, file): all texts' token ids; shard names the input partition and the place in it.

    A shard ends with the document that brings it to so many ids; a document of more ids than that is in one shard, too. Null and empty texts are documents without ids;
    repeated rows are documents of their own; rows without an id are left out, for their places couldn't be named. An empty table gives no row.
    Other columns aren't looked at.
    """

    def run(batches):
        to_ids = None if encode else encoder(vocabulary)
        base, made = TaskContext.get().partitionId() << 32, 0
        names, parts, total = [], [], 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in parts])
            file = build(np.concatenate([np.zeros(0, np.uint32), *parts]), np.array(names), ends)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (base + made, len(names), total, len(file), file)], ["shard", "documents", "tokens", "bytes", "file"])

        for batch in batches:
            for part in slices(batch, "text", COLUMN):
                if encode:
                    found = (np.array(encode(text or ""), dtype=np.uint32) for text in part.column("text").to_pylist())
                else:
                    ids, bounds = to_ids(part.column("text"))
                    found = (ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                for name, those in zip(part.column("id").to_pylist(), found):
                    parts.append(those)
                    names.append(name)
                    total += len(parts[-1])
                    if total >= size:
                        yield shard()
                        made, names, parts, total = made + 1, [], [], 0
        if names:
            yield shard()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return chosen.mapInArrow(run, "shard long, documents long, tokens long, bytes long, file binary")


def write(made: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's file to the folder, which all executors share; gives (shard, path, bytes). No shard gives no row and leaves the folder as it is.

    A file gets its name only when it is whole, so that an attempt that is lost or made twice leaves nothing wrong.
    """

    def run(batches):
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        there.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for shard, file in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist()):
                path = f"{root}/{shard:016x}.wvlt"
                part = f"{path}.{uuid.uuid4().hex}"
                with there.open_output_stream(part) as out:
                    out.write(file)
                there.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(paths, pa.string()), batch.column("bytes")], ["shard", "path", "bytes"])

    return made.mapInArrow(run, "shard long, path string, bytes long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, file) of all files that write() left in a folder; unfinished ones aren't read. An empty folder gives no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvlt").load(folder)
    return files.select(F.conv(F.regexp_extract("path", r"([0-9a-f]{16})\.wvlt$", 1), 16, 10).cast("long").alias("shard"), F.col("content").alias("file"))


def lookup(made: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """(token, doc_id, place): every occurrence of the tokens, from the shards' files; repeated tokens count once, unknown ones have no row.

    Each shard is asked for all tokens together, so that a block of bits is unpacked and counted once. A document that stands in several rows has
    its occurrences once for each; a document without any has no row, and no shard or no token gives none. Other columns than file aren't looked at.
    """
    wanted = np.array(sorted(set(tokens)), dtype=np.int64)

    def run(batches):
        for batch in batches:
            for file in batch.column("file"):
                shard = Shard(file.as_py())
                token, place = shard.locate_all(wanted)
                doc, inner = shard.documents_at(place)
                for at in range(0, len(token), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (token, doc, inner)], ["token", "doc_id", "place"])

    return made.select("file").mapInArrow(run, "token long, doc_id long, place long")
