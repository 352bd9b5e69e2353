"""Toxicity by compression distance.

Two zstandard dictionaries: the ordinary one is trained by the library (cover algorithm) on
running text of the ordinary class; the toxic one is the same ground with running text of the
toxic class on top, so that what the classes share costs the same with both and does not blur
the difference. The toxic segments are chosen by a cover too, with weights: a string of
STRING bytes weighs by how much more texts of the toxic class hold it than others (count
times logarithm of the lift), the segment that adds most weight per length is taken, and its
strings weigh nothing from then on.

A text is lower-cased and reduced to words of letters, and cut into overlapping windows of
several words. A window's distance is the bytes that the toxic dictionary saves on it against
the ordinary one. A text is judged by all of its windows: mean and shares of their distances
go into a logistic regression that is fitted on texts which the dictionaries did not see
(left-out folds); how much toxic text a dictionary takes is chosen there as well.

Windows end in a fixed frame that both dictionaries hold, since zstandard neither searches the
last bytes of an input nor compresses one that it cannot shorten as a whole.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import private, slices, staged, text_column, with_columns

FRAME = b"\n|=~:{[(<0123456789>)]}:~=|\n+-_;"
GAP = b"\x01\x02"  # between the parts of a dictionary, so that no match runs across
LETTERS = re.compile(r"[^\W\d_]+")
WINDOW, STEP = 96, 48  # bytes of a window and between the starts of two, up to whole words

STRING = 6  # bytes of the strings that are weighed
OFTEN = 3  # times that a text counts for a string at most
LIFT, WEIGHT = 4.0, 12.0  # least lift and weight of a string
SEGMENT = 12  # least bytes of a segment, up to whole words
GROUND = 40_960  # bytes of the ordinary dictionary
GROUND_TEXT = 3 << 20  # bytes of the texts that it is trained on
TAKES = (1024, 2048)  # bytes of toxic segments, the best is chosen
LEVEL = 3  # of compression
FOLDS = 4
LOW, HIGH = -2, 8  # a window's distance counts within these
HIT = 5  # distance from which a window is reported
RIDGE = (0.3, 0.3, 20.0, 20.0)  # of the features: shares of windows count once there are texts enough

# Bounds of the sample that is fitted on: texts of each class, bytes of a text, of a class;
# and of the texts among them that are left out in turn to choose and calibrate.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES, SAMPLE_TOTAL = 1000, 2000, 262_144, 8_388_608
TRIAL_TOXIC, TRIAL_ORDINARY = 400, 800


def words_only(text: str) -> bytes:
    """Lower-cased runs of letters with a blank around each; empty without any."""
    words = LETTERS.findall(text.lower())
    return f" {' '.join(words)} ".encode() if words else b""


def windows(body: bytes) -> list[bytes]:
    """Overlapping windows of whole words; a word longer than a window is one by itself."""
    if not body:
        return []
    blanks = [m.start() for m in re.finditer(b" ", body)]
    out, at, last = [], 0, len(blanks) - 1
    while True:
        stop = max(bisect_right(blanks, blanks[at] + WINDOW) - 1, at + 1)
        out.append(body[blanks[at] : blanks[stop] + 1])
        if stop == last:
            return out
        at = min(max(bisect_left(blanks, blanks[at] + STEP), at + 1), stop)


# -- dictionaries ----------------------------------------------------------------------------


def _codes(body: bytes) -> np.ndarray:
    """The strings of STRING bytes at each place, as integers."""
    raw = np.frombuffer(body, np.uint8).astype(np.int64)
    n = len(raw) - STRING + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for j in range(STRING):
        out = (out << 8) | raw[j : j + n]
    return out


def _shared(texts: list[bytes]) -> np.ndarray:
    """Strings that two texts or more hold, in order."""
    once, twice = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(texts), 64):  # a few texts at a time keep little in memory
        own, n = np.unique(np.concatenate([np.unique(_codes(t)) for t in texts[i : i + 64]]), return_counts=True)
        again = own[(n > 1) | np.isin(own, once, assume_unique=True)]
        twice = np.union1d(twice, again)
        once = np.union1d(once, own)
    return twice


def _held(texts: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts hold each string of ``code``, and how often, OFTEN times a text at most."""
    held, often = np.zeros(len(code)), np.zeros(len(code))
    for t in texts:
        own, n = np.unique(_codes(t), return_counts=True)
        place = np.searchsorted(code, own)
        hit = place < len(code)
        hit[hit] = code[place[hit]] == own[hit]
        held[place[hit]] += 1
        often[place[hit]] += np.minimum(n[hit], OFTEN)
    return held, often


def _weights(code: np.ndarray, own: list[tuple], n_own: int, others: list[tuple], n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``code`` the strings that texts of one class hold more than those of the other, and
    their weights; ``own`` and ``others`` are counts of ``_held``."""
    texts, often = sum(t for t, _ in own), sum(o for _, o in own)
    lift = (texts / max(1, n_own)) / ((sum(t for t, _ in others) + 0.5) / max(1, n_other))
    weight = often * np.log(np.maximum(lift, 1e-9))
    good = (texts >= 2) & (lift >= LIFT) & (weight >= WEIGHT)
    return code[good], weight[good]


def cover(texts: Iterable[bytes], code: np.ndarray, weight: np.ndarray, size: int) -> list[bytes]:
    """Segments of running text, most weight first, of ``size`` bytes together."""
    left = dict(zip(code.tolist(), weight.tolist()))
    offers: dict[bytes, None] = {}
    for t in texts:
        codes = _codes(t)
        place = np.searchsorted(code, codes)
        hit = place < len(code)
        hit[hit] = code[place[hit]] == codes[hit]
        for i in np.flatnonzero(hit).tolist():
            start = max(t.rfind(b" ", 0, i + 1), 0)
            stop = t.find(b" ", start + SEGMENT - 1)
            offers[t[start : stop + 1 if 0 <= stop < start + 3 * SEGMENT else start + 3 * SEGMENT]] = None

    def gain(segment: bytes) -> float:
        return sum(left.get(c, 0.0) for c in set(_codes(segment).tolist())) / math.sqrt(len(segment))

    agenda = [(-gain(s), s) for s in offers]
    heapq.heapify(agenda)
    out, total = [], 0
    while agenda and total < size:
        _, segment = heapq.heappop(agenda)
        now = gain(segment)
        if now <= 0:
            continue
        if agenda and now < -agenda[0][0] - 1e-9:  # others took some of its strings
            heapq.heappush(agenda, (-now, segment))
            continue
        out.append(segment)
        total += len(segment)
        for c in _codes(segment).tolist():
            left[c] = 0.0
    return out


def ground(ordinary: list[bytes]) -> bytes:
    """Content of a dictionary that the library trains on windows of ordinary text, GROUND_TEXT
    bytes or little more; all of the text where that is too little to train on."""
    samples, total = [], 0
    for t in ordinary:
        samples += [t[i : i + WINDOW] for i in range(0, len(t), WINDOW)]
        total += len(t)
        if total > GROUND_TEXT:
            break
    try:
        return zstandard.train_dictionary(GROUND + 1024, samples, k=32, d=8).as_bytes()[-GROUND:]
    except zstandard.ZstdError:
        return b"".join(ordinary)[-GROUND:]


def filled(segments: list[bytes], size: int) -> bytes:
    """The first segments that ``size`` bytes hold, best last: near matches are cheap."""
    out, total = [], 0
    for s in segments:
        total += len(s)
        if total > size:
            break
        out.append(s)
    return b"".join(reversed(out))


class Distance:
    """Bytes that the toxic dictionary saves on a window against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(ordinary + GAP + toxic)

    @staticmethod
    def _compressor(content: bytes):
        made = zstandard.ZstdCompressionDict(content + GAP + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def all(self, body: bytes) -> np.ndarray:
        ordinary, toxic = self.ordinary, self.toxic
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in (w + FRAME for w in windows(body))], np.int64)


# -- from distances to a score ---------------------------------------------------------------

def features(distances: np.ndarray) -> list[float]:
    """Mean distance, the same against the noise of a mean, shares of windows far apart."""
    n = len(distances)
    if not n:
        return [0.0] * 4
    mean = float(np.clip(distances, LOW, HIGH).mean())
    return [mean, mean * math.sqrt(n), float((distances >= 3).mean()), float((distances >= HIT).mean())]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    prior: float  # share of toxic texts
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    slope: tuple[float, ...] = ()  # none: every score is the prior
    offset: float = 0.0

    def of(self, distances: np.ndarray) -> float:
        if not self.slope:
            return self.prior
        x = self.offset + sum(b * (v - c) / s for b, v, c, s in zip(self.slope, features(distances), self.centre, self.scale))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def _regression(rows: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Ridge logistic regression by Newton's method: centre, scale, coefficients, loss."""
    centre, scale = rows.mean(0), rows.std(0) + 1e-6
    z = np.column_stack([np.ones(len(rows)), (rows - centre) / scale])
    ridge = np.array([1e-6, *RIDGE])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b = b + np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (label - p)) - ridge * b)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -float((weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum())
    return centre, scale, b, loss


def apart(texts: Iterable[str]) -> list[str]:
    """Texts without near copies of earlier ones, whose chance strings would look typical of
    their class: two of the four least hashes of word triples in common make a near copy."""
    seen: set[int] = set()
    out = []
    for text in sorted(set(texts), key=lambda t: (zlib.crc32(t.encode()), t)):
        words = text.encode().split()
        triples = {zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
        least = heapq.nsmallest(4, triples)
        if sum(h in seen for h in least) < min(2, len(least)):
            out.append(text)
        seen.update(least)
    return out


def train(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int) -> Model:
    """Dictionaries from all texts given; size and regression from texts left out in
    turn. ``n_toxic`` and ``n_ordinary`` are the class sizes that the texts were sampled from.
    Without texts of both classes every score is the share of toxic texts (0 if none)."""
    prior = n_toxic / (n_toxic + n_ordinary) if n_toxic + n_ordinary else 0.0
    bodies = [[b for b in map(words_only, apart(side)) if b] for side in (toxic, ordinary)]
    if min(map(len, bodies)) < 2:
        return Model(b"", b"", prior)
    folds = [[side[i::FOLDS] for i in range(FOLDS)] for side in bodies]
    code = _shared(bodies[0])
    held = [[_held(f, code) for f in side] for side in folds]
    base = ground(bodies[1])

    def segments(own: list[int]) -> list[bytes]:
        sizes = [sum(len(side[i]) for i in own) for side in folds]
        found = _weights(code, [held[0][i] for i in own], sizes[0], [held[1][i] for i in own], sizes[1])
        return cover((t for i in own for t in folds[0][i]), *found, TAKES[-1])

    without = [segments([j for j in range(FOLDS) if j != i]) for i in range(FOLDS)]
    trial = [[f[: bound // FOLDS] for f in side] for side, bound in zip(folds, (TRIAL_TOXIC, TRIAL_ORDINARY))]
    label = np.array([1.0 - side for side in (0, 1) for i in range(FOLDS) for _ in trial[side][i]])
    weight = np.where(label == 1, n_toxic / max(1, label.sum()), n_ordinary / max(1, (1 - label).sum()))
    weight *= len(label) / weight.sum()
    best = None
    for take in TAKES:
        by_fold = [Distance(base, filled(s, take)) for s in without]
        rows = np.array([features(by_fold[i].all(t)) for side in (0, 1) for i in range(FOLDS) for t in trial[side][i]])
        *fitted, loss = _regression(rows, label, weight)
        if best is None or loss < best[0]:
            best = loss, take, fitted
    _, take, (centre, scale, b) = best
    return Model(
        base, filled(segments(list(range(FOLDS))), take), prior,
        tuple(centre.tolist()), tuple(scale.tolist()), tuple(b[1:].tolist()), float(b[0]),
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows: at most SAMPLE_TOXIC and SAMPLE_ORDINARY ids, taken in the order
    of a hash, of which texts of at most SAMPLE_BYTES bytes are read, one an id, up to
    SAMPLE_TOTAL bytes a class. The list of ids is bounded by that, so it is broadcast and no
    text is shuffled but the sample's.
    Class sizes are counted over all labelled rows. Null labels and ids are left out."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = [
        known.where(F.col("label") == F.lit(yes)).orderBy(F.xxhash64("id"), "id").limit(n)
        for yes, n in ((True, SAMPLE_TOXIC), (False, SAMPLE_ORDINARY))
    ]
    texts = docs.select(F.col(id_col).alias("id"), text_column(text_col).alias("text"))
    found = staged(
        texts.where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(ids[0].unionByName(ids[1])), "id")
        .groupBy("id", "label").agg(F.min("text").alias("text")),
        "toxicity-sample",
    )
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    sizes_of = found.select("id", "label", F.octet_length("text").alias("n"))
    few = sizes_of.withColumn("n", F.sum("n").over(so_far)).where(F.col("n") <= SAMPLE_TOTAL).select("id")
    found = found.join(F.broadcast(few), "id")
    sample: dict[bool, list[str]] = {True: [], False: []}
    for r in found.select("label", "text").collect():
        sample[r["label"]].append(r["text"])
    return train(sample[True], sample[False], sizes.get(True, 0), sizes.get(False, 0))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", hits_col: str = "hits") -> DataFrame:
    """Add ``hits`` (windows on which the toxic dictionary saves HIT bytes or more) and
    ``score`` (0 to 1) to every row; columns of these names are replaced. Null and empty texts
    and those without letters have no windows and no hits. Whole texts are read; repeated rows
    score alike; an empty table gives an empty one.
    """
    text = private(docs, "text")
    schema = with_columns(docs, **{hits_col: "long", score_col: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        for batch in batches:
            for start, n in slices(batch, text):
                part = batch.slice(start, n)
                distances = [distance.all(words_only(t)) if model.slope else np.zeros(0, np.int64) for t in part.column(text).to_pylist()]
                hits = [int((d >= HIT).sum()) for d in distances]
                made = {hits_col: pa.array(hits, pa.int64()), score_col: pa.array([model.of(d) for d in distances], pa.float64())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in schema.names], names=schema.names)

    return docs.withColumn(text, text_column(text_col)).mapInArrow(run, schema)
