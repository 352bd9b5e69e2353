"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A stretch of letters is merged by an agenda: a heap of adjacent symbol pairs whose joint
string is a piece, best score first, leftmost first among equals. Taking a pair joins its
symbols and offers the two new pairs at their sides; a pair of which a symbol has grown or
gone since is passed over. Symbols that are no piece are spelt in byte pieces.

Merges cannot reach across two letters that no piece has side by side: a blank after another
letter, a line feed, most punctuation after a word. Texts are cut there, and each distinct
stretch is merged once per worker and remembered. Stretches met for the first time are held
against the sentencepiece library, an Arrow batch at a time.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .tables import private, slices, text_column, with_columns

SPACE = "▁"  # fixed value: how pieces write a blank
MERGE_TYPE = 2  # fixed values of the model file: its type, and the kinds of a piece
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
LETTER, MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", ",.;:!?#)]}\"'"
KEEP_LETTERS = 64  # longest stretch that is remembered
KEEP_STRETCHES, KEEP_PARTS = 600_000, 100_000  # stretches, and parts of some, remembered by a worker before it starts afresh


class Pieces:
    """Ids, scores and byte pieces of a model file; bounded by the file and sent to tasks."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.file = Path(path).read_bytes()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.file)
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        kinds = [p.type for p in model.pieces]
        if trainer.model_type != MERGE_TYPE or USER_DEFINED in kinds:
            raise ValueError("the vocabulary is not of the merge type")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("vocabularies that rewrite the text are not supported")
        self.prefix = bool(normalizer.add_dummy_prefix)
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type not in (UNKNOWN, CONTROL, BYTE)}
        # 0 for the best score; pieces of equal score share a rank
        scores = {p.piece: p.score for p in model.pieces if p.type not in (UNKNOWN, CONTROL, BYTE)}
        place = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in scores.items()}
        spelt = [(int(p.piece[3:5], 16), i) for i, p in enumerate(model.pieces) if p.type == BYTE]
        self.bytes = [i for _, i in sorted(spelt)]
        self.unknown = kinds.index(UNKNOWN)
        # what each id reads as, with blanks
        self.surface = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for value, i in spelt:
            self.surface[i] = bytes([value])
        for i, kind in enumerate(kinds):
            if kind == CONTROL:
                self.surface[i] = b""
        self.surface[self.unknown] = trainer.unk_surface.encode()
        self.spelt = frozenset(self.bytes)
        self.control = frozenset(i for i, kind in enumerate(kinds) if kind == CONTROL)
        # letters that stand side by side in some piece: merges happen between such only
        self.beside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.at_blanks = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.at_lines = not any("\n" in p for p in self.beside)
        # what never goes on from a letter, so that a word before it stands alone
        letter = re.compile(LETTER)
        joined = {two[1] for two in self.beside if letter.match(two)}
        self.ends = "".join(c for c in MARKS if c not in joined)


def merge(stretch: str, rank: dict[str, int]) -> list[str]:
    """Symbols of ``stretch`` (blanks written as SPACE) after all merges. Entries of the agenda
    are ``rank * 2**32 + left``; one whose rank is no longer that of the pair at ``left`` is
    passed over."""
    n = len(stretch)
    symbol = list(stretch)
    pair = list(map(rank.get, map(add, symbol, symbol[1:])))
    agenda = [(r << 32) | i for i, r in enumerate(pair) if r is not None]
    if not agenda:
        return symbol
    heapq.heapify(agenda)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair.append(None)
    while agenda:
        top = heapq.heappop(agenda)
        left = top & 0xFFFFFFFF
        if pair[left] != top >> 32:
            continue
        right = after[left]
        grown = symbol[left] = symbol[left] + symbol[right]
        symbol[right], pair[right] = "", None
        beyond = after[left] = after[right]
        r = None
        if beyond < n:
            before[beyond] = left
            r = rank.get(grown + symbol[beyond])
            if r is not None:
                heapq.heappush(agenda, (r << 32) | left)
        pair[left] = r
        back = before[left]
        if back >= 0:
            r = pair[back] = rank.get(symbol[back] + grown)
            if r is not None:
                heapq.heappush(agenda, (r << 32) | back)
    return list(filter(None, symbol))


class Disagreement(RuntimeError):
    """The library encodes a stretch differently."""


class Encoder:
    """Texts to ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: Pieces, check: bool = True):
        self.pieces = pieces
        self.library = sentencepiece.SentencePieceProcessor(model_proto=pieces.file) if check else None
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        line = r"\n" if pieces.at_lines else ""
        word = rf" *{LETTER}++(?=[{re.escape(pieces.ends)} {line}]|$)"
        self.stretch = re.compile(rf"{word}| *[^ {line}]+| +" + "|\n" * pieces.at_lines)

    @classmethod
    def of(cls, pieces: Pieces, check: bool) -> Encoder:
        """The encoder that this worker keeps beside a broadcast vocabulary, so that its later
        tasks know what earlier ones merged."""
        kept = pieces.__dict__.setdefault("encoders", {})
        if check not in kept:
            kept[check] = cls(pieces, check)
        return kept[check]

    def ids(self, stretch: str) -> bytes:
        """Ids of a stretch that no merge leaves: cut between letters that no piece has side by
        side, each part merged by itself."""
        letters, beside = stretch.replace(" ", SPACE), self.pieces.beside
        if beside.issuperset(map(add, letters, letters[1:])):
            made = self.part(letters)
        else:
            cuts = [i for i, two in enumerate(map(add, letters, letters[1:]), 1) if two not in beside]
            parts = [letters[i:j] for i, j in zip([0, *cuts], [*cuts, None])]
            made = b"".join([self.parts.get(p) or self.part(p, True) for p in parts])
        if len(stretch) <= KEEP_LETTERS:
            if len(self.known) >= KEEP_STRETCHES:
                self.known.clear()
            self.known[stretch] = made
        if self.library is not None:
            self.new[stretch] = made
        return made

    def part(self, letters: str, keep: bool = False) -> bytes:
        v, symbols = self.pieces, merge(letters, self.pieces.rank)
        out = list(map(v.id.get, symbols))
        if None in out:
            spelt = [[i] if i is not None else [v.bytes[b] for b in s.encode()] if v.bytes else [v.unknown] for s, i in zip(symbols, out)]
            out = [i for ids in spelt for i in ids]
        made = array("I", out).tobytes()
        if keep and len(letters) <= KEEP_LETTERS:
            if len(self.parts) >= KEEP_PARTS:
                self.parts.clear()
            self.parts[letters] = made
        return made

    def encode(self, text: str) -> bytes:
        text = text.replace(SPACE, " ")
        if not text:
            return b""
        if self.pieces.prefix:
            text = " " + text
        if not self.pieces.at_blanks:
            return self.ids(text)
        known = self.known.get
        return b"".join([known(s) or self.ids(s) for s in self.stretch.findall(text)])

    def check(self) -> None:
        """Hold stretches that are new since the last call against the library. It puts a blank
        before a text, so those that do not begin with one are checked behind a line feed."""
        if not self.new:
            return
        skip = len(self.library.encode("\n")) if self.pieces.prefix else 0
        texts, cut = [], []
        for s in self.new:
            plain = self.pieces.prefix and s[0] != " "
            texts.append("\n" + s if plain else s[self.pieces.prefix :])
            cut.append(skip if plain else 0)
        for s, n, want in zip(self.new, cut, self.library.encode(texts, num_threads=1)):
            # a lone blank is the prefix itself, which the library does not give an empty text
            if s != " " and np.frombuffer(self.new[s], "<u4").tolist() != want[n:]:
                raise Disagreement(f"the library encodes {s[:60]!r} differently")
        self.new.clear()


def _lists(rows: list[bytes]) -> pa.Array:
    """Packed ids as an Arrow list column."""
    ends = np.cumsum([0] + [len(x) // 4 for x in rows], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """Add ``ids`` (array of int) and ``n_tokens`` (long), as the sentencepiece library encodes
    without begin and end ids.

    Columns of these names are replaced. Null and empty texts have no ids. Texts of any length
    are encoded whole, repeated rows each for itself; an empty table gives an empty one. The
    vocabulary is bounded by its file and broadcast. With ``check`` each stretch that a worker
    merges is held against the library, and a difference ends the job.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))
    text = private(docs, "text")
    schema = with_columns(docs, ids="array<int>", n_tokens="long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(pieces.value, check)
        for batch in batches:
            for start, n in slices(batch, text):
                part = batch.slice(start, n)
                rows = [encoder.encode(t) for t in part.column(text).to_pylist()]
                encoder.check()
                made = {"ids": _lists(rows), "n_tokens": pa.array([len(x) // 4 for x in rows], pa.int64())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in schema.names], names=schema.names)

    return docs.withColumn(text, text_column(text_col)).mapInArrow(encode, schema)


class Decoder:
    """Ids to text: blanks for SPACE, the first one dropped if the vocabulary puts it there;
    byte pieces side by side are UTF-8, a byte that is none becomes U+FFFD."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def decode(self, ids: list[int]) -> str:
        v = self.pieces
        if not ids:
            return ""
        parts = list(map(v.surface.__getitem__, ids))
        if v.prefix:
            # control pieces read as nothing and leave the blank to the piece after them
            first = next((k for k, p in enumerate(parts) if p), None)
            if first is not None and ids[first] not in v.spelt and ids[first] != v.unknown and parts[first][:1] == b" ":
                parts[first] = parts[first][1:]
        if v.control.isdisjoint(ids):  # one between byte pieces would part them
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids, parts)

    def _mended(self, ids: list[int], parts: list[bytes]) -> str:
        out: list[str] = []
        run = b""
        for i, part in zip([*ids, None], [*parts, b""]):
            if i in self.pieces.spelt:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                run = run[size:]
            out.append(part.decode())
        return "".join(out)


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text of the list of ids as column ``to``, as the library's ``decode`` gives it.

    Null and empty lists give the empty text. Ids outside the vocabulary are an error.
    """
    pieces = rows.sparkSession.sparkContext.broadcast(Pieces(model_path))
    schema = with_columns(rows, **{to: "string"})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces.value)
        for batch in batches:
            texts = [decoder.decode(x) for x in _id_lists(batch.column(ids_col))]
            made = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([made if c == to else batch.column(c) for c in schema.names], names=schema.names)

    return rows.mapInArrow(decode, schema)


def _id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """One list at a time, so that a batch of long texts is never unfolded as a whole."""
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []
