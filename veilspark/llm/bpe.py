"""Byte-level BPE: encoding and decoding of whole texts.

Each distinct word is merged once per worker and remembered; ``Encoder.encode_all`` takes a
whole column of texts and encodes each of its distinct pieces once. Merging keeps a contiguous
array of part boundaries with the rank of each adjacent pair next to it: scan for the least
rank, delete the boundary between the two parts, refresh the ranks on either side. Scanning
costs the square of a word's length, so words beyond ``SCAN_BYTES`` use a heap over the same
ranks and give the same parts.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Callable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import private, slices, text_column, with_columns
from .words import buffers

# Fixed value: the pattern that splits a text before the merges of this kind of vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCAN_BYTES = 96  # longest word that is merged by scanning
KEEP_BYTES = 64  # longest word that is remembered
KEEP_WORDS = 300_000  # words remembered by a worker before it starts afresh
BLOCK_BYTES = 4 << 20  # of text whose distinct pieces are encoded at once
_NONE = 1 << 40

# First bytes of letters that are surely no white space. A blank before such a letter always
# begins a word of the pattern, whatever stands before it.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable Latin-1 letters stand
    for themselves, the other bytes for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids and merge ranks of a byte-level BPE file; a bounded thing that is sent to tasks."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letter = _byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        self.id = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {raw(a) + raw(b): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def scan_merge(word: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """Parts of ``word`` by repeated scans for the least rank."""
    bounds = list(range(len(word) + 1))
    ranks = [rank.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        del bounds[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        if i < len(ranks):
            ranks[i] = rank.get(word[bounds[i] : bounds[i + 2]], _NONE)
    return [word[i:j] for i, j in zip(bounds, bounds[1:])]


def heap_merge(word: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The same parts for long words, in time n log n."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == stop and end[i] == j):
            continue
        alive[j] = 0
        after[i], end[i] = after[j], stop
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if 0 <= left and right < n and (r := rank.get(word[left : end[right]])) is not None:
                heapq.heappush(heap, (r, left, right, end[right]))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = after[i]
    return out


class _Runs(dict):
    """Ids (packed) of a blank and the run of non-blank letters after it, made when first seen."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, run: str) -> bytes:
        # A run that is empty or begins with white space belongs to a longer stretch of
        # white space and cannot be split off by itself.
        if not run or run[0].isspace():
            raise ValueError
        ids = self.encoder.words(" " + run)
        if len(run) <= KEEP_BYTES:
            if len(self) >= self.encoder.keep:
                self.clear()
            self[run] = ids
        return ids


def _bytes(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of a new array without nulls."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[: off[-1]] if off[-1] else np.zeros(0, np.uint8), off


class Encoder:
    """Texts to ids packed as little-endian unsigned 32-bit integers.

    ``encode_word`` gives the ids of one word; without it words are merged here by rank.
    """

    def __init__(self, vocabulary: Vocabulary, encode_word: Callable[[str], list[int]] | None = None, keep: int = KEEP_WORDS):
        self.vocabulary, self.keep = vocabulary, keep
        self.pattern = regex.compile(PATTERN)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.names = names
        self.merged: dict[str, bytes] = {}
        self.runs = _Runs(self)
        self.plain = encode_word

    def word(self, word: str) -> bytes:
        raw, v = word.encode(), self.vocabulary
        parts = (scan_merge if len(raw) <= SCAN_BYTES else heap_merge)(raw, v.rank)
        ids = packed([v.id[p] for p in parts])
        if len(raw) <= KEEP_BYTES:
            if len(self.merged) >= self.keep:
                self.merged.clear()
            self.merged[word] = ids
        return ids

    def words(self, text: str) -> bytes:
        """A text without special tokens, split by the pattern."""
        if self.plain:
            return packed(self.plain(text))
        known = self.merged
        return b"".join([known.get(w) or self.word(w) for w in self.pattern.findall(text)])

    def ordinary(self, text: str) -> bytes:
        """Split at single blanks where that cannot change the pattern's words."""
        head, blank, rest = text.partition(" ")
        if not blank:
            return self.words(text)
        try:
            tail = b"".join(map(self.runs.__getitem__, rest.split(" ")))
        except ValueError:
            return self.words(text)
        return self.words(head) + tail if head else tail

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(n in text for n in self.names):
            return self.ordinary(text)
        ids = self.vocabulary.special
        return b"".join(
            packed([ids[p]]) if p in ids else self.ordinary(p)
            for p in self.special.split(text)
            if p
        )

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of every text of an Arrow column; null counts as empty.

        Texts are cut before blanks that a letter follows, which the pattern does anyway, and
        of equal pieces in a block one is encoded.
        """
        texts = pa.compute.fill_null(texts, "")
        apart = np.zeros(len(texts), dtype=bool)
        for name in self.names:
            apart |= pa.compute.match_substring(texts, name).to_numpy(zero_copy_only=False)
        raw, off = buffers(pa.compute.if_else(pa.array(apart), "", texts) if apart.any() else texts)
        begins = np.zeros(len(raw) + 1, dtype=bool)
        blank = np.flatnonzero(raw[:-1] == 0x20)
        begins[blank[_SOLID[raw[blank + 1]]]] = True
        begins[off[1:] - 1] = False  # what follows is another text
        begins[off] = True
        at = np.flatnonzero(begins)  # of pieces, and the end
        ids, counts, done = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)], 0
        while done < len(at) - 1:
            stop = max(done + 1, int(np.searchsorted(at, at[done] + BLOCK_BYTES, "right")) - 1)
            bounds = at[done : stop + 1]
            made, n = self._pieces(raw[bounds[0] : bounds[-1]], bounds - bounds[0])
            ids.append(made)
            counts.append(n)
            done = stop
        flat = np.concatenate(ids).view(np.uint8)
        ends = 4 * np.cumsum(np.concatenate(counts))[np.searchsorted(at, off)]
        out = [flat[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(apart).tolist():
            out[i] = self.encode(texts[i].as_py())
        return out

    @cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each id."""
        out = np.zeros(max(self.vocabulary.id.values()) + 1, np.int64)
        out[list(self.vocabulary.id.values())] = list(map(len, self.vocabulary.id))
        return out

    def _pieces(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie side by side, and how many each has."""
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]
        ).dictionary_encode()
        distinct, which = column.dictionary, column.indices.to_numpy()
        raw, off = _bytes(distinct)
        # Pieces that begin with a blank and a letter do not change each other's words: one call
        # encodes them, and the bytes of its ids tell where each ends.
        joins = (raw[off[:-1]] == 0x20) & (np.diff(off) > 1)
        joins[joins] = _SOLID[raw[off[:-1][joins] + 1]]
        joined, _ = _bytes(distinct.filter(pa.array(joins)))
        ids = [np.frombuffer(self.words(joined.tobytes().decode()), "<u4")]
        size = np.cumsum(self.sizes[ids[0]])
        ends = np.cumsum(np.diff(off)[joins])
        last = np.searchsorted(size, ends)
        if len(size) != (last[-1] + 1 if len(last) else 0) or not np.array_equal(size[last], ends):
            raise ValueError("ids that do not keep the bytes of a text")
        n = np.empty(len(distinct), np.int64)
        n[joins] = np.diff(last, prepend=-1)
        for i in np.flatnonzero(~joins).tolist():
            ids.append(np.frombuffer(self.words(distinct[i].as_py().decode()), "<u4"))
            n[i] = len(ids[-1])
        start = np.empty(len(distinct), np.int64)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        start[order] = np.cumsum(n[order]) - n[order]
        count = n[which]
        place = np.repeat(start[which] - np.cumsum(count) + count, count)
        place += np.arange(len(place))
        return np.concatenate(ids)[place], count


def _decoder(vocabulary: Vocabulary) -> list[bytes]:
    size = max([*vocabulary.id.values(), *vocabulary.special.values()]) + 1
    out = [b""] * size
    for token, i in vocabulary.id.items():
        out[i] = token
    for token, i in vocabulary.special.items():
        out[i] = token.encode()
    return out


def encode_texts(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens`` to every row.

    Columns of these names are replaced. Null and empty texts have no ids. A special token's
    string in a text is that token, as in the tokenizers library. Texts of any length and
    repeated rows are encoded whole, each for itself; an empty table gives an empty one. The
    vocabulary (bounded by its file) is broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    text = private(docs, "text")
    rows = docs.withColumn(text, text_column(text_col))
    schema = with_columns(docs, ids="binary", n_tokens="long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for start, n in slices(batch, text):
                part = batch.slice(start, n)
                ids = [encoder.encode(t) for t in part.column(text).to_pylist()]
                made = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                yield pa.RecordBatch.from_arrays([made.get(c) if c in made else part.column(c) for c in schema.names], names=schema.names)

    return rows.mapInArrow(encode, schema)


def decode_ids(rows: DataFrame, vocabulary_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text of packed ids as column ``to``; bytes that are no UTF-8 become U+FFFD.

    Null ids give the empty text. Ids outside the vocabulary are an error.
    """
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    schema = with_columns(rows, **{to: "string"})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _decoder(vocabulary.value).__getitem__
        for batch in batches:
            for start, n in slices(batch, ids_col):
                part = batch.slice(start, n)
                texts = [
                    b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                    for x in part.column(ids_col).to_pylist()
                ]
                made = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([made if c == to else part.column(c) for c in schema.names], names=schema.names)

    return rows.mapInArrow(decode, schema)
