"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import FOLDER

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from veilspark.llm import bpe, packing, queries  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_on_odd_strings(library):
    encoder = bpe.Encoder(bpe.Vocabulary(queries.VOCABULARY))
    fast = bpe.Encoder(encoder.vocabulary, packing._word_encoder(encoder.vocabulary))
    random.seed(3)
    letters = list("ab '\n\t  .19sé² _-\x1cт\x85")
    texts = ["", " ", "  ", "a\n \nb", "x<|endoftext|>y <|endoftext|> ", "don't I'll 's", "日本語 テキスト", "a　b", "x" * 3000, "ab" * 999]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        want = ids_of(library, t)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want, repr(t)
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == want, repr(t)


@pytest.mark.parametrize("block", [1, 40, bpe.BLOCK_BYTES])
def test_columns_of_odd_strings(library, monkeypatch, block):
    """Texts side by side, cut at blanks and into blocks, keep the library's ids."""
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    vocabulary = bpe.Vocabulary(queries.VOCABULARY)
    random.seed(5)
    letters = list("ab '\n\t  .19sé² _-\x1cт\x85\u3000\xa0“日\U0001f600")
    texts = [None, "", " ", "  ", "a", " a", "a ", None, "<|endoftext|>", "x <|endoftext|> y x", "don't I'll 's", " 日 “a” ", "x" * 3000, "\n b", "", ""]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(800)]
    texts += ["".join(random.choice(["<|endoftext|>", "a", " ", "\n"]) for _ in range(9)) for _ in range(20)]
    random.shuffle(texts)
    want = [ids_of(library, t) for t in texts]
    for plain in (None, packing._word_encoder(vocabulary)):
        encoder = bpe.Encoder(vocabulary, plain)
        for column in (pa.array(texts), pa.array(["x y", *texts, "z"], pa.large_string()).slice(1, len(texts))):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(column)] == want
        assert encoder.encode_all(pa.array([], pa.string())) == []
        assert encoder.encode_all(pa.array([None, ""], pa.string())) == [b"", b""]


def test_a_column_is_encoded_by_distinct_pieces(library):
    """More distinct words than a worker remembers: each is still encoded once, in one call."""
    random.seed(7)
    words = ["".join(random.choice("abehinort") for _ in range(9)) for _ in range(500)]
    texts = ["the " + " ".join(random.sample(words, len(words))) for _ in range(20)]
    vocabulary, calls = bpe.Vocabulary(queries.VOCABULARY), []
    plain = packing._word_encoder(vocabulary)
    encoder = bpe.Encoder(vocabulary, lambda text: calls.append(text) or plain(text), keep=100)
    got = encoder.encode_all(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t) for t in texts]
    assert len(calls) == 2 and sum(map(len, calls)) == len("the") + 10 * len(set(words))


def test_merges_agree():
    rank = bpe.Vocabulary(queries.VOCABULARY).rank
    random.seed(4)
    for _ in range(300):
        word = "".join(random.choice("abetinoz é") for _ in range(random.randint(1, 60))).encode()
        assert bpe.scan_merge(word, rank) == bpe.heap_merge(word, rank)


def test_bpe_query(spark, library, texts):
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = ids_of(library, t)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_odd(odd, none):
    rows = bpe.decode_ids(bpe.encode_texts(odd, queries.VOCABULARY), queries.VOCABULARY).collect()
    assert len(rows) == odd.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe.encode_texts(none, queries.VOCABULARY).count() == 0


def check_pieces(rows, want):
    """``want``: ids of each row with the end id, by document."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(docs) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r["length"]
        assert at == len(ids)
    lengths = {}
    for s, pieces in sequences.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        lengths[s] = at
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())  # nothing is padded
    return lengths


def test_packing_query(spark, library, texts):
    check_pieces(queries.op1_packing(spark, FOLDER).collect(), {i: ids_of(library, t) + [1] for i, t in texts.items()})


def test_packing_odd(odd, none, library):
    rows = [r for r in packing.pack(odd, queries.VOCABULARY).collect()]
    assert sum(r["length"] for r in rows) == sum(len(ids_of(library, r["text"])) + 1 for r in odd.collect())
    some = [r for r in rows if r["doc_id"] not in (None, 2)]
    want = {r["doc_id"]: ids_of(library, r["text"]) + [1] for r in odd.collect() if r["doc_id"] not in (None, 2)}
    for r in some:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert packing.pack(none, queries.VOCABULARY).count() == 0


def test_curve_is_a_curve():
    cube = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(cube, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cube[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike(spark):
    """Texts of one vocabulary lie closer on the curve than texts of different ones."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{rng.randint(0, 20)}" for _ in range(200))) for i in range(90)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.VOCABULARY).collect()
    order = [r["doc_id"] % 3 for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    same = sum(a == b for a, b in zip(order, order[1:]))
    assert same > 60 and len(Counter(order)) == 3
