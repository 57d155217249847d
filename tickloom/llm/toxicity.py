"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents_of, giving_back, records, stored

ORDERS = (3, 4, 5)
#: n-grams are hashed into this many buckets; the model keeps those whose log-count ratio is most certain.
BUCKET_BITS, FEATURES = 18, 4096
#: Labelled documents that the classifier is fitted on, at most: those whose ids have the smallest hashes.
MAX_FIT_ROWS = 20_000
SMOOTHING, RIDGE, STEPS = 0.5, 1e-3, 150
#: Rows of a batch whose texts are Python objects at a time; bounds the working memory of a task.
SLICE_ROWS = 256


def ngram_buckets(text: str | None, chunk: int = 1 << 18):
    """Buckets of all n-grams of the lower-cased text with a space at either end, with repetitions, by chunks."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), chunk):
        p = np.maximum(points[at : at + chunk + max(ORDERS) - 1], np.uint32(32)).astype(np.uint64)
        for n in ORDERS:
            if len(p) < n or at and len(p) - n + 1 <= 0:
                continue
            h = np.full(len(p) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + p[k : len(p) - n + 1 + k]
            h *= np.uint64(0x9E3779B97F4A7C15)
            yield (h[:chunk] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def distinct_buckets(text: str | None) -> np.ndarray:
    seen = np.zeros(1 << BUCKET_BITS, bool)
    for buckets in ngram_buckets(text):
        seen[buckets] = True
    return np.flatnonzero(seen)


def slices(batches):
    for batch in batches:
        yield from (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_ids(labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> list[tuple[int, int]]:
    """(doc_id, y) of at most so many labelled ids outside the held-out fold, those with the smallest hashes.

    The ids are thinned out by a threshold on the hash first, so that few more than asked for are ever sorted.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")
    y = y.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = y.count()
    below = int(min(1.0, (1.2 * max_fit_rows + 1000) / max(total, 1)) * (1 << 40))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    return [(r.doc_id, r.y) for r in y.where(order < below).orderBy(order, "doc_id").limit(max_fit_rows).collect()]


def training_rows(docs: DataFrame, ids: list[tuple[int, int]]) -> DataFrame:
    """doc_id, y, text of the documents with these ids, as a stored table.

    The ids are broadcast: there are MAX_FIT_ROWS of them at most, whatever the input, and only these documents'
    texts move. Of several texts with the same id, the smallest counts.
    """
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, y int"))
    rows = documents_of(docs).where("text is not null").join(few, "doc_id")
    return stored(rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")))


def class_counts(rows: DataFrame) -> DataFrame:
    """bucket, c0, c1: documents of either class that hold an n-gram of the bucket; bucket -1: all documents.

    A task adds up its own documents, so that a row for each bucket leaves it and not one for each n-gram.
    """
    schema = pa.schema([("bucket", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64())])

    def count(batches):
        c = np.zeros((2, (1 << BUCKET_BITS) + 1), np.int64)  # bucket -1 is the last
        for part in slices(batches):
            for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist()):
                c[y, distinct_buckets(text)] += 1
                c[y, -1] += 1
        found = np.flatnonzero(c.any(axis=0))
        yield records(schema, {"bucket": np.where(found == 1 << BUCKET_BITS, -1, found), "c0": c[0, found], "c1": c[1, found]})

    counts = rows.select("y", "text").mapInArrow(giving_back(count), "bucket int, c0 long, c1 long")
    return counts.groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


class Model:
    """Feature of each bucket (-1: none), weight of each feature (ratio times coefficient), and the bias."""

    def __init__(self, feature: np.ndarray, ratio: np.ndarray):
        self.feature, self.ratio = feature, ratio
        self.weight, self.bias = np.zeros(len(ratio)), 0.0

    def present(self, text: str | None) -> np.ndarray:
        seen = np.zeros(len(self.ratio), bool)
        for buckets in ngram_buckets(text):
            hit = self.feature[buckets]
            seen[hit[hit >= 0]] = True
        return np.flatnonzero(seen)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[self.present(text)].sum(), -500, 500))))


def _ratios(counts: DataFrame) -> Model:
    c = counts.toArrow()  # at most one row for each bucket
    bucket, c0, c1 = (c[k].to_numpy() for k in ("bucket", "c0", "c1"))
    n0, n1 = (int(x[bucket < 0].sum()) for x in (c0, c1))
    keep = bucket >= 0
    bucket, c0, c1 = bucket[keep], c0[keep] + SMOOTHING, c1[keep] + SMOOTHING
    r = np.log(c1 / (n1 + 2 * SMOOTHING)) - np.log(c0 / (n0 + 2 * SMOOTHING))
    certain = np.abs(r) / np.sqrt(1 / c0 + 1 / c1)
    best = np.lexsort((bucket, -certain))[:FEATURES]
    feature = np.full(1 << BUCKET_BITS, -1, np.int32)
    feature[bucket[best]] = np.arange(len(best))
    model = Model(feature, r[best])
    model.bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Log-count ratios, and then a ridge logistic regression on the features scaled by them, from a bounded hash sample
    of labelled documents outside the held-out fold. The rows are sorted, so that the model is the same for any
    partitioning. Without labelled rows of both classes the score is the smoothed base rate."""
    rows = training_rows(docs, training_ids(labels, max_fit_rows))
    model = _ratios(class_counts(rows))
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("f", pa.list_(pa.int32()))])

    def features(batches):
        for part in slices(batches):
            found = [model.present(t).astype(np.int32) for t in part.column("text").to_pylist()]
            yield records(schema, {"doc_id": part.column("doc_id"), "y": part.column("y"), "f": found})

    t = rows.mapInArrow(giving_back(features), "doc_id long, y int, f array<int>").toArrow().sort_by("doc_id")  # max_fit_rows at most
    y = t["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return model
    lists = t["f"].combine_chunks()
    column = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    value = model.ratio[column]
    w, b = np.ones(len(model.ratio)) * 0.1, model.bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        margin = b + np.bincount(row, (model.ratio * w)[column], len(y))
        off = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
        g = np.append(np.bincount(column, value * off[row], len(w)) / len(y) + RIDGE * w, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weight, model.bias = w * model.ratio, float(b)
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier) and predicted (score >= 0.5) for each row of docs.

    Null and empty texts get the score of a text without n-grams of the model. Null doc_id: not held out. Repeated
    rows each get their score; other columns are dropped; empty table: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches):
        for part in slices(batches):
            ids = part.column("doc_id").to_pylist()
            found = [model.score(t) for t in part.column("text").to_pylist()]
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield records(schema, {"doc_id": ids, "held_out": held, "score": found, "predicted": [int(s >= 0.5) for s in found]})

    return documents_of(docs).mapInArrow(giving_back(score), "doc_id long, held_out boolean, score double, predicted int")
