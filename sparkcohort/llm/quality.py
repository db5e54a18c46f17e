"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

A bounded sample of labelled rows is turned into hashed byte-trigram counts and three shares of style (words that repeat
the word before, capital letters, symbols); their weighted matrix is factored on the
driver (at most ``SAMPLE`` rows by ``FEATURES`` columns).  The projection and the labelled vectors have a fixed size and
travel to the tasks, where every document is projected and its cosine with every labelled vector computed as one blocked
matrix product.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Shipped, byte_slices, q, text_of, word_hashes, words_of

SAMPLE = 3000       # labelled rows that the classifier is fitted on, taken in the order of a hash of their id
FEATURES = 4096     # hashed byte trigrams
STYLE = 3           # shares beside the trigrams
STYLE_WEIGHT = 2.0  # length of a share of 1 beside trigram vectors of length 1
SMOOTHING = 32      # bytes added to a text's length in its shares, so that one full stop does not mark a short text
RANK = 64           # latent dimensions
NEIGHBOURS = 15
SHARPNESS = 4.0     # a neighbour votes with cosine ** SHARPNESS
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed byte-trigram counts, then the shares of style; nothing crosses rows and the whole text counts.

    Digits count as one class, so that numbers do not spread over many features.
    """
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES + STYLE), np.float32)
    if len(data) < 3:
        return out
    x = np.where((data >= 48) & (data <= 57), np.uint8(48), data).astype(np.uint32)
    code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    inside = row[:-2] == row[2:]
    out[:, :FEATURES] = np.bincount(row[:-2][inside] * FEATURES + code[inside], minlength=n * FEATURES).reshape(n, FEATURES)
    start, end, word_row = words_of(data, offsets)
    hashes = word_hashes(data, start, end)
    again = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    length = np.diff(offsets) + SMOOTHING
    capital = (data >= 65) & (data <= 90)
    symbol = ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))
    out[:, FEATURES] = np.bincount(word_row[1:][again], minlength=n) / (np.bincount(word_row, minlength=n) + 1)
    out[:, FEATURES + 1] = np.bincount(row[capital], minlength=n) / length
    out[:, FEATURES + 2] = np.bincount(row[symbol], minlength=n) / length
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in byte_slices(batch, "text", 1 << 20):
            for a in range(0, last - first, 256):
                b = min(a + 256, last - first)
                rows = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first + a, b - a),
                                                  pa.array([r.tobytes() for r in rows.astype(np.float32)], pa.binary())],
                                                 names=["label", "counts"])


class Model:
    """Weights, projection and labelled vectors; all of a size fixed by the parameters above."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (counts[:, :FEATURES] > 0).sum(0)
        self.idf = np.log((1.0 + len(counts)) / (1.0 + seen)).astype(np.float32) + np.float32(1)
        x = self.weighted(counts)
        rank = min(RANK, *x.shape) if len(x) else 0
        if rank:
            # randomised range finder with two power steps, then a small exact factorisation
            rng = np.random.default_rng(7)
            basis = x.T @ (x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32))
            for _ in range(2):
                basis = x.T @ (x @ np.linalg.qr(basis)[0])
            basis = np.linalg.qr(basis)[0]
            _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
            self.projection = np.ascontiguousarray(basis @ v[:rank].T).astype(np.float32)
        else:
            self.projection = np.zeros((FEATURES + STYLE, 1), np.float32)
        self.vectors = unit(x @ self.projection).astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return np.hstack([unit(np.log1p(counts[:, :FEATURES]) * self.idf), counts[:, FEATURES:] * np.float32(STYLE_WEIGHT)])

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = np.clip(unit(self.weighted(counts) @ self.projection) @ self.vectors.T, 0.0, 1.0)
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        vote = np.take_along_axis(cosine, near, axis=1).astype(np.float64) ** SHARPNESS
        total = vote.sum(1)
        return np.where(total > 1e-9, (vote * self.labels[near]).sum(1) / np.maximum(total, 1e-9), self.prior)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold (crc32 of the id as text modulo 5 is 0).

    Rows with null id or label are no examples; of contradicting labels of one id the mean, rounded half up, counts; of several
    texts of one id the one with the smallest hash is the example.
    Without any example every score is one half.
    """
    labelled = (labels.where(q(id).isNotNull() & q(label).isNotNull() & (F.crc32(q(id).cast("string")) % 5 != 0))
                .groupBy(q(id).alias("__id")).agg((F.avg(q(label).cast("double")) >= 0.5).cast("float").alias("label")))
    # the bound holds for labelled documents at hand, so labels of others (in a shard, or behind an earlier stage) take no place
    texts = docs.select(q(id).alias("__id"), text_of(text).alias("text"))
    chosen = labelled.join(texts.select("__id").distinct(), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # ``sample`` bounds the broadcast side, and one row for each chosen id bounds what comes to the driver
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.first("label").alias("label")).select("text", "label")
    got = rows.mapInArrow(counted, "label float, counts binary").toArrow()
    # every row has the same number of bytes: the column's values are the matrix, without a copy for each row
    parts = []
    for chunk in got.column("counts").chunks:
        if len(chunk):
            at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.float32))
    counts = np.concatenate(parts).reshape(-1, FEATURES + STYLE) if parts else np.zeros((0, FEATURES + STYLE), np.float32)
    labels = got.column("label").to_numpy()
    del got, parts
    # tasks end in any order: a fixed order makes refits agree
    order = np.lexsort((labels, *counts[:, :8].T, counts.sum(1)))
    return Model(counts[order], labels[order])


def batch_scores(model: Model, batch: pa.RecordBatch, text: str) -> np.ndarray:
    parts = []
    for _, _, data, offsets in byte_slices(batch, text, 1 << 20):
        for a in range(0, len(offsets) - 1, 256):
            part = offsets[a:min(a + 257, len(offsets))]
            parts.append(model.scores(features(data[part[0]:part[-1]], part - part[0])))
    return np.concatenate(parts) if parts else np.zeros(0)


def scored(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``held_out``, ``score`` in [0, 1], ``predicted``: one row per input row, from the whole text alone.

    A text without trigrams (null, empty, one or two bytes) has no neighbours and gets the share of label 1.
    """
    id_type = docs.schema[id].dataType.simpleString()
    handle = Shipped(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch_scores(handle.value, batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(value, 0.0, 1.0), pa.float64())], names=["id", "score"])

    rows = docs.select(q(id).alias("id"), text_of(text).alias("text")).mapInArrow(score, f"id {id_type}, score double")
    return rows.select(F.col("id").alias(id), F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns whose score reaches the threshold; rows stay where they lie.

    Every row is judged by its own text: repeated rows stay or go together, and null and empty texts get the share of label 1.
    """
    handle, at = Shipped(docs.sparkSession, model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(handle.value, batch, batch.schema.names[at]) >= threshold))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])      # any column names will do
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
