"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from conftest_llm import FOLDER

from veilspark.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(queries.PIECES)


def test_odd_strings(library, vocabulary):
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    random.seed(1)
    letters = list("ab '\n\t  .,19sé² _-\x1cт\x85▁ 日😀\x00<>/")
    texts = ["", " ", "  ", "\n", "\n\n a", " \n", "a\n \nb", "<s>x</s>", "<0x41>", "<unk>", "x" * 3000, "ab" * 999, " " * 100]
    texts += ["▁", "▁▁a", "日本語 テキスト", "�", "é", "x².y, z#"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) for _ in range(2000)]
    for t in texts:
        want = library.encode(t)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == want, repr(t)
        assert decoder.decode(want) == library.decode(want), repr(t)
    encoder.check()


def test_any_ids_decode_alike(library, vocabulary):
    """Bytes that are no UTF-8, control and unknown pieces included."""
    decoder = pieces.Decoder(vocabulary)
    random.seed(2)
    for _ in range(3000):
        kinds = (random.randrange(32000), random.randrange(260), random.randrange(3), random.randrange(255, 262))
        ids = [random.choice(kinds) for _ in range(random.randint(1, 8))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_texts_cut_or_whole(vocabulary):
    """Cutting where no piece has the letters side by side changes nothing."""
    encoder = pieces.Encoder(vocabulary)
    for t in ("the end, of (all) things.", "a1b2 c3-d4", "x  yy   zzz", "one\ntwo\n\n three"):
        cut = np.frombuffer(encoder.encode(t), "<u4").tolist()
        whole = pieces.merge((" " + t).replace(" ", pieces.SPACE), vocabulary.rank)
        assert [vocabulary.id[s] if s in vocabulary.id else vocabulary.bytes[ord(s)] for s in whole] == cut


def test_a_difference_ends_the_job(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    encoder.encode("some words")
    encoder.new[" words"] = b"\1\0\0\0"
    with pytest.raises(pieces.Disagreement):
        encoder.check()


def test_remembering_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KEEP_STRETCHES", 10)
    monkeypatch.setattr(pieces, "KEEP_PARTS", 10)
    encoder = pieces.Encoder(vocabulary)
    text = " ".join(f"w{i}x{i * 7}" for i in range(200))
    want = np.frombuffer(pieces.Encoder(vocabulary, check=False).encode(text), "<u4")
    assert (np.frombuffer(encoder.encode(text), "<u4") == want).all() and len(encoder.known) <= 10 and len(encoder.parts) <= 10


def test_query(spark, library, texts):
    rows = queries.op11_pieces(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd(odd, none, library):
    rows = pieces.decode_ids(pieces.encode_texts(odd, queries.PIECES), queries.PIECES).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == library.decode(r["ids"])
    assert pieces.encode_texts(none, queries.PIECES).count() == 0
    clash = odd.select("doc_id", "text", odd["shard"].alias("ids"), odd["n_words"].alias("n_tokens"))
    assert pieces.encode_texts(clash, queries.PIECES).columns == ["doc_id", "text", "ids", "n_tokens"]


def test_other_vocabularies_are_refused(tmp_path, vocabulary):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(vocabulary.file)
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "m"))
