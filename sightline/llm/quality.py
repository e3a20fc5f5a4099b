"""Operator 3: quality by votes of labelled neighbours in a latent-semantic space.

Features of a text are hashed: the shapes of its words and of neighbouring shapes, words
that repeat the one before, and lower-case words. They are weighted by TF-IDF, with
document frequencies over all documents. Latent-semantic directions come from a bounded
sample of labelled rows. The sample's vectors go out to every task, which computes the
cosines of all its documents with all of them, in blocks, and lets the nearest vote with
their similarity as weight.

Scale: two passes over the texts and no shuffle of them. Broadcast are ``FEATURES``
document frequencies, as many rows of directions, and at most ``TRAIN_ROWS`` vectors.

Defined cases: a null or empty text has a zero vector and gets the prior, the share of
label 1 in the training rows; repeated rows each get the same score; labels without
their document and null labels are left out; without any label the score is 0.5; extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.batches import lean
from sightline.llm.textbytes import NOT_SPACE, Words, buffers, mixed, pieces

#: Labelled rows, half of each label where there are enough, that the classifier is fitted on at most.
TRAIN_ROWS = 3000
SHAPES = WORDS = 2048
FEATURES = SHAPES + WORDS
DIRECTIONS, NEIGHBOURS, SHARPNESS = 64, 25, 4.0
#: Weight of the block of plain words beside that of shapes.
WORD_WEIGHT = 0.4

_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Classes of bytes in a word's shape: other marks stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:] = 0x30, 0x41, 0x61, 0x61


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed features, a row per text."""
    n = len(offsets) - 1
    words = Words(raw, offsets, NOT_SPACE)
    counts = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(words.start):
        return counts
    # shapes: each byte's class, runs of a class as one; upper case of two bytes counts as a letter
    classes = _SHAPE[raw]
    fresh = np.ones(len(raw), dtype=bool)
    fresh[1:] = classes[1:] != classes[:-1]
    fresh[words.start] = True
    inside = NOT_SPACE[raw] & fresh
    at = np.flatnonzero(inside)
    place = np.searchsorted(words.start, at, side="right") - 1
    nth = np.arange(len(at)) - np.searchsorted(at, words.start)[place]
    value = mixed(classes[at].astype(np.uint64) * _ODD + np.minimum(nth, 12).astype(np.uint64))
    total = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    shape = mixed(total[np.searchsorted(at, words.end)] - total[np.searchsorted(at, words.start)])
    before = np.zeros_like(shape)
    before[1:] = shape[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = 0
    repeated = np.zeros(len(shape), dtype=bool)
    repeated[1:] = words.hash[1:] == words.hash[:-1]
    doc = np.repeat(np.arange(n), np.diff(words.first))
    half = np.uint64(SHAPES // 2)
    for column in (shape % half, half + mixed(before * _ODD + shape) % (half - np.uint64(1)), np.uint64(SHAPES) + words.hash % np.uint64(WORDS)):
        counts += np.bincount(doc * FEATURES + column.astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES)
    counts[:, SHAPES - 1] = np.bincount(doc[repeated], minlength=n)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (or 0): shapes and words each to their share."""
    out = np.log1p(counts) * idf
    for part, weight in ((slice(0, SHAPES), 1.0), (slice(SHAPES, FEATURES), WORD_WEIGHT)):
        out[:, part] *= weight / np.maximum(np.linalg.norm(out[:, part], axis=1, keepdims=True), 1e-9)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def directions(x: np.ndarray, rank: int = DIRECTIONS) -> np.ndarray:
    """The leading right singular directions, by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(1).standard_normal((len(x), rank)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q.astype(np.float32)


class Voters:
    """Labelled latent vectors and what makes a text comparable with them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, prior: float):
        x = weighted(counts, idf).astype(np.float32)
        self.idf, self.prior = idf, prior
        self.axes = directions(x) if len(x) else np.zeros((FEATURES, 1), np.float32)
        self.vectors, self.labels = self._unit(x @ self.axes), labels.astype(np.float32)
        drawn = labels.mean() if len(labels) else 0.5
        #: the sample is drawn half and half: votes count as the labels' true shares would have it
        self.for_one = prior / drawn if 0 < drawn < 1 else 1.0
        self.for_zero = (1 - prior) / (1 - drawn) if 0 < drawn < 1 else 1.0

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        v = weighted(counts, self.idf).astype(np.float32) @ self.axes
        cosine = self._unit(v) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.tile(np.arange(k), (len(v), 1))
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        one = (weight * self.labels[near]).sum(axis=1) * self.for_one
        zero = (weight * (1 - self.labels[near])).sum(axis=1) * self.for_zero
        return np.where(one + zero > 0, one / np.maximum(one + zero, 1e-300), self.prior)


#: Texts' bytes for which a matrix of features is held at a time.
_BLOCK = 1 << 19


def _rows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for row, end, part, at in pieces(raw, offsets, _BLOCK):
        for low in range(row, end, 512):
            high = min(end, low + 512)
            a, b = at[low - row], at[high - row]
            yield low, high, features(part[a:b], at[low - row : high - row + 1] - a)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for _, _, counts in _rows(*buffers(batch.column(0))):
            total += (counts > 0).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"feature": pa.array([*range(FEATURES), -1], pa.int32()), "n": pa.array([*total.tolist(), n], pa.int64())})


def _score(batches: Iterator[pa.RecordBatch], voters: Voters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for low, high, counts in _rows(*buffers(batch.column("text"))):
            score[low:high] = voters.score(counts)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score})


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """At most ``rows`` training documents with their label as ``y``, half of each where there are enough; the share of label 1.

    Chosen by a hash of the id, so the choice is the same at every run.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & train).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    few = min(counts.values()) if len(counts) == 2 else 0
    parts = []
    for y in sorted(counts):
        most = max(rows // 2, rows - few) if counts[y] > few or len(counts) < 2 else rows // 2
        parts.append(known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    chosen = known.limit(0)
    for part in parts:
        chosen = chosen.unionByName(part)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id"), share  # at most ``rows`` ids


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", train: Column, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Voters:
    frequency = docs.select(F.col(text).alias("text")).mapInArrow(lean(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = {r["feature"]: r["n"] for r in frequency}
    idf = np.log((1 + n.get(-1, 0)) / (1 + np.array([n.get(i, 0) for i in range(FEATURES)]))).astype(np.float32) + 1
    sample, share = labelled_sample(docs, labels, label, train, rows, doc_id=doc_id, text=text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, counts in _rows(*buffers(batch.column("text"))):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "counts": pa.array([x.astype(np.float32).tobytes() for x in counts], pa.binary())})

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(lean(counted), f"doc_id {kind}, y int, counts binary").orderBy("doc_id").collect()
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in got), np.float32).reshape(len(got), FEATURES)
    return Voters(counts, np.array([r["y"] for r in got], dtype=np.float32), idf, share)


def score_quality(docs: DataFrame, voters: Voters, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each document."""
    held = docs.sparkSession.sparkContext.broadcast(voters)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(lambda batches: _score(batches, held.value)), f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: quality of all documents; a third is held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc32_of_id() % 3 == 1
    voters = fit(docs, labels, train=~held_out)
    return score_quality(docs, voters).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
