"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import FOLDER, WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import queries
from veilspark.llm.runs import diagonals, periodic_runs
from veilspark.llm.words import split


def by_hand(w):
    """All lags, one after the other; of lags with the same stretch the least."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def runs_of(texts):
    words = split(pa.array(texts))
    out = [[] for _ in texts]
    for s, e, q in diagonals(words).tolist():
        d = int(words.doc[s])
        out[d].append((s - int(words.first[d]), e - s, q))
    return out


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_random_texts():
    random.seed(5)
    texts = []
    for _ in range(1500):
        t = []
        for _ in range(random.randint(0, 5)):
            if random.random() < 0.5:
                unit = [random.choice("abc") for _ in range(random.randint(1, 9))]
                t += (unit * random.randint(1, 9))[: random.randint(1, 60)]
            else:
                t += [random.choice("abcdefgh"[: random.choice((2, 8))]) for _ in range(random.randint(0, 20))]
        texts.append(" ".join(t))
    assert runs_of(texts) == [by_hand(t.split()) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=40).map(" ".join), min_size=1, max_size=4))
def test_two_letters(texts):
    assert runs_of(texts) == [by_hand(t.split()) for t in texts]


def test_runs_within_runs():
    inner = ["x"] * 6 + ["y"]
    assert runs_of([" ".join(inner * 5)])[0] == by_hand(inner * 5)
    assert len(by_hand(inner * 5)) == 6


def test_one_word_many_times_stays_cheap():
    """A word 300,000 times over, and a period of 50,000 words, are no pairs of occurrences."""
    unit = [f"w{i}" for i in range(50_000)]
    texts = ["a " * 300_000, " ".join(unit * 4 + unit[:10]), " ".join(unit * 3)]
    assert runs_of(texts) == [[(0, 300_000, 1)], [(0, 200_010, 50_000)], []]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def test_query(spark, texts):
    rows = queries.op12_periodic_runs(spark, FOLDER).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] for r in rows) > 5
    for r in rows:
        w = planted(r["doc_id"], WORD.findall(texts[r["doc_id"]] or ""))
        runs = by_hand(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(w, runs).encode()).hexdigest()


def test_odd(spark, odd, none):
    rows = periodic_runs(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {"doc_id", "text", "n_words", "shard", "runs", "collapsed"}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == by_hand(w)
        assert r["collapsed"] == kept(w, by_hand(w))
    assert periodic_runs(none).count() == 0
    nulls = queries.planted_period(odd.select("doc_id", "text")).collect()
    assert sorted(map(repr, ([r["doc_id"], WORD.findall(r["text"] or "")] for r in nulls))) == sorted(
        map(repr, ([r["doc_id"], planted(r["doc_id"], WORD.findall(r["text"] or "")) if r["doc_id"] is not None else WORD.findall(r["text"] or "")] for r in odd.collect()))
    )
    with pytest.raises(ValueError):
        diagonals(split(pa.array(["a"])), times=3)
    assert np.array_equal(diagonals(split(pa.array([], pa.string()))), np.zeros((0, 3)))
