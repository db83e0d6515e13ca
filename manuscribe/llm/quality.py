"""Quality classifier: supervised subword embeddings, averaged per document.

Words, pairs of neighbouring words and character n-grams (UTF-8 bytes within
word marks) are hashed into buckets, each with a learned vector. A document is
the mean vector of all its features; a softmax layer scores it. Numpy trains
both by stochastic gradient descent on a bounded sample of labelled rows, with
whole texts. A pair of equal words has one bucket of its own, so that
repetition shows whatever the word.

The score of a document is linear in its mean vector before the softmax, so
scoring looks up one number per feature. Each different word of a batch is
looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, trimmed
from .textarrays import EXACT, chunks, hashes, mix, running, spans

BUCKETS, DIM = 1 << 17, 10
GRAMS = (2, 3, 4)
REPEAT = 0
_M = np.uint64(BUCKETS - 1)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the words, marked at both ends."""
    size = ends - starts + 2
    at = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint8)
    inside = np.ones(len(flat), bool)
    inside[at] = inside[at + size - 1] = False
    flat[at], flat[at + size - 1] = 2, 3
    n = ends - starts
    flat[inside] = data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    word = np.repeat(np.arange(len(starts)), size)
    sums = running(flat, EXACT)
    buckets, owners = [], []
    for g in GRAMS:
        if len(flat) >= g:
            p = np.flatnonzero(word[: len(flat) - g + 1] == word[g - 1 :])
            buckets.append((hashes(sums, p, p + g) + np.uint64(g)) & _M)
            owners.append(word[p])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: row bounds in words; word number of every word; bigram bucket of every word but a row's first; grams as (bucket, word number)."""
    for _, _, data, offs in chunks(column):
        starts, ends, bounds = spans(data, offs)
        h = hashes(running(data), starts, ends)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        pair = np.full(len(h), -1, np.int64)
        if len(h) > 1:
            pair[1:] = (mix(h[:-1] * np.uint64(3) + h[1:]) & _M).astype(np.int64)
            pair[1:][h[1:] == h[:-1]] = REPEAT
            pair[bounds[:-1][bounds[:-1] < len(h)]] = -1
        if len(uniq):
            bucket, owner = _grams(data, starts[first], ends[first])
            bucket = np.concatenate([(mix(uniq) & _M).astype(np.int64), bucket])
            owner = np.concatenate([np.arange(len(uniq)), owner])
        else:
            bucket = owner = np.zeros(0, np.int64)
        yield bounds, inv, pair, bucket, owner


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, label, buckets, counts) of labelled texts (at, label, text)."""
    for batch in batches:
        rows, buckets, counts = 0, [], []
        for bounds, inv, pair, bucket, owner in _features(batch.column(2)):
            order = np.argsort(owner, kind="stable")
            bucket = bucket[order]
            n = np.bincount(owner, minlength=int(inv.max()) + 1 if len(inv) else 0)
            lo = np.cumsum(n) - n
            for r in range(len(bounds) - 1):
                w = inv[bounds[r] : bounds[r + 1]]
                p = pair[bounds[r] : bounds[r + 1]]
                size = n[w]
                at = np.repeat(lo[w] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                b, c = np.unique(np.concatenate([bucket[at], p[p >= 0]]), return_counts=True)
                buckets.append(b.astype(np.int32))
                counts.append(c.astype(np.float32))
                rows += 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["at", "label", "buckets", "counts"])


def train(labels: np.ndarray, buckets: list[np.ndarray], counts: list[np.ndarray], prior: float, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the log odds of label 1 are the mean bucket score plus the bias."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = labels.mean() if len(labels) else 0.5
    if 0 < share < 1:
        class_weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
        fs = [c / c.sum() if len(c) else c for c in counts]
        for epoch in range(epochs):
            lr = np.float32(rate * (1 - epoch / epochs))
            for i in rng.permutation(len(labels)):
                idx, f, y = buckets[i], fs[i], int(labels[i])
                h = f @ e[idx] if len(idx) else np.zeros(DIM, np.float32)
                z = h @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= class_weight[y] * lr
                if len(idx):
                    # a mean over many features has small gradients for each: scaled by its inverse norm
                    e[idx] -= np.outer(f / np.sqrt(f @ f), w @ p)
                w -= np.outer(h, p)
                b -= p
        bias = float(b[1] - b[0])
    else:
        bias = 0.0
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), bias + float(np.log(prior / (1 - prior)))


def _trained(prior: float):
    """The model of the histograms, trained by a worker in the order of `at`: the sample is bounded, but it would stay in the driver's memory."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        col = lambda name: [x.values.to_numpy() for x in table[name].combine_chunks()]
        weights, bias = train(table["label"].to_numpy().astype(np.int64), col("buckets"), col("counts"), prior)
        out = pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})
        del table
        hand_back()
        return out

    return run


def held_out(id_col: str):
    """Rows that no label is learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[np.ndarray, float]:
    """The weights and bias learned from at most `per_class` labelled, not held out rows of each class."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").filter(~held_out("id"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = share.get(1, 0), share.get(0, 0)
    prior = ones / (ones + zeros) if ones + zeros else 0.5
    some = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    taught = F.broadcast(some[0].unionByName(some[1]).withColumnRenamed("id", "taught"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = text.join(taught, text.id == taught.taught).select("label", "text", "id").orderBy("id", "label", "text").select(F.monotonically_increasing_id().alias("at"), "label", "text")
    got = got.mapInArrow(trimmed(_histograms), "at long, label int, buckets array<int>, counts array<float>").withColumn("g", F.lit(0))
    model = got.groupBy("g").applyInArrow(_trained(prior), "weights binary, bias double").first()
    return (np.frombuffer(model["weights"], np.float32), model["bias"]) if model else train(np.zeros(0, np.int64), [], [], prior)


def scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of every text of a string column."""
    out = [np.zeros(0)]
    for bounds, inv, pair, bucket, owner in _features(column):
        m = int(inv.max()) + 1 if len(inv) else 0
        own, n = np.bincount(owner, weights[bucket], m), np.bincount(owner, minlength=m)
        two = pair >= 0
        total = np.concatenate([[0.0], np.cumsum(own[inv] + np.where(two, weights[pair], 0))])
        many = np.concatenate([[0], np.cumsum(n[inv] + two)])
        s, c = total[bounds[1:]] - total[bounds[:-1]], many[bounds[1:]] - many[bounds[:-1]]
        out.append(1 / (1 + np.exp(-(s / np.maximum(c, 1) + bias))))
    return np.concatenate(out)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, per_class: int = 1500
) -> DataFrame:
    """id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold, else 0).

    Learns from at most `per_class` labelled, not held out rows of each class,
    chosen by a hash of the id; the classes' shares come from all of them. Null
    labels and labels other than 0 and 1 teach nothing; an id labelled both
    ways counts in both; rows that repeat an id teach once each. Null and empty
    texts get the score of no features, very long ones are scored whole, and
    repeated rows alike; null ids are scored and not held out. Without labels of
    both classes every score is their share of ones (0.5 without any). An empty
    table gives an empty result. Only the text enters a score; further columns
    are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), *model.value))], ["id", "score"])

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = text.mapInArrow(trimmed(run), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, per_class: int = 1500) -> DataFrame:
    """docs without the rows predicted 0; all columns kept, whatever their names.

    Each row is decided by its own text, whatever its id, so null ids are
    filtered like others and repeated rows go or stay together. Null, empty and
    very long texts and missing labels as in score(); an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, per_class))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), *model.value) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
