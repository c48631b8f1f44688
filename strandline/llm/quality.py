"""Quality classifier: naive Bayes support vectors by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import mixed, pieces, settle, to_batch

#: Hashed features: 2 ** BITS.
BITS = 18
#: Lengths of the byte n-grams, and a salt for each.
GRAMS = (3, 5)


def features(text: str) -> np.ndarray:
    """Which hashed n-grams a text has, sorted. N-grams are of UTF-8 bytes, so case, signs and scripts all show; runs of words
    are caught by the longer ones. Worked off in stretches, so long texts need bounded memory."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    seen = np.zeros(1 << BITS, dtype=bool)
    step = 1 << 18
    for n in GRAMS:
        for at in range(0, len(data) - n + 1, step):
            part = data[at : at + step + n - 1].astype(np.uint64)
            code = np.full(len(part) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | part[k : len(part) - n + 1 + k]
            seen[(mixed(code) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss over indicators scaled by r, by dual coordinate descent.

    Each step solves one document's dual variable exactly within [0, C]; C is larger for the rarer class.
    """
    w, bias = np.zeros(len(r)), 0.0
    scaled = [r[x] / max(1e-9, np.sqrt((r[x] ** 2).sum())) for x in rows]
    n_good = max(1, int((y > 0).sum()))
    n_bad = max(1, len(y) - n_good)
    limit = np.where(y > 0, c * len(y) / (2 * n_good), c * len(y) / (2 * n_bad))
    alpha = np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            x, v = rows[i], scaled[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), limit[i])
            change = (new - alpha[i]) * y[i]
            if change:
                w[x] += change * v
                bias += change
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return w, bias


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins (Newton steps, targets drawn in from 0 and 1, slope kept positive)."""
    good, bad = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, float(np.log(good / bad))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = float(np.clip(a - np.clip(d[0], -2, 2), 0.1, 60.0)), float(np.clip(b - np.clip(d[1], -2, 2), -30, 30))
        if np.abs(d).max() < 1e-6:
            break
    return a, b


class Model:
    """Log-count ratios, weights and calibration; everything that scoring needs, of fixed size."""

    def __init__(self, r: np.ndarray, w: np.ndarray, bias: float, a: float, b: float) -> None:
        self.r, self.w, self.bias, self.a, self.b = r.astype(np.float32), w, bias, a, b

    def score(self, text: str) -> float:
        x = features(text)
        v = self.r[x].astype(np.float64)
        size = np.sqrt((v**2).sum())
        margin = (float(self.w[x] @ v) / size if size > 1e-9 else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


def held_out(id_col: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id's text leaves 2 modulo 4. A null id is not held out, but has no labels either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """(text, y) of documents with a label of 0 or 1. Labels are broadcast while they are at most most_broadcast rows, else joined by a shuffle."""
    small = labels.count() <= most_broadcast
    return docs.join(F.broadcast(labels) if small else labels, docs["id"] == labels["_id"])


def log_count_ratios(train: DataFrame, smooth: float) -> np.ndarray:
    """Of each feature over all training rows: log of its share in good documents over its share in bad ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    n[y, features(t or "")] += 1
                    n[y, -1] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield to_batch({"f": some, "bad": n[0, some], "good": n[1, some]}, pa.schema([("f", pa.int32()), ("bad", pa.int64()), ("good", pa.int64())]))

    sums = train.select("text", "y").mapInArrow(count, "f int, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    n = np.zeros((2, (1 << BITS) + 1))
    at = sums.column("f").to_numpy()
    n[0, at], n[1, at] = sums.column("bad").to_numpy(), sums.column("good").to_numpy()
    share = (n[:, :-1] + smooth) / (n[:, -1:] + 2 * smooth)
    return np.log(share[1]) - np.log(share[0])


def fit(docs: DataFrame, labels: DataFrame, most_train_rows: int = 6000, c: float = 1.0, epochs: int = 20, smooth: float = 1.0, seed: int = 1) -> Model:
    """Fit on documents (id, text) and labels (id, y), without held-out ids.

    Log-count ratios are counted over all labelled rows. The margin is fitted on a bounded sample: the
    most_train_rows labels of the smallest hashed ids, half for each class as far as there are so many.
    """
    labels = labels.where(labels["y"].isin(0, 1) & ~held_out(labels["id"])).select(F.col("id").alias("_id"), F.col("y").cast("int").alias("y"))
    labels = settle(labels, "quality-labels")
    r = log_count_ratios(labelled(docs, labels), smooth)
    half = most_train_rows // 2
    chosen = [labels.where(labels["y"] == y).orderBy(F.xxhash64("_id"), "_id").limit(half) for y in (0, 1)]
    sample = docs.join(F.broadcast(chosen[0].union(chosen[1])), docs["id"] == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                xs = [features(t or "") for t in part.column("text").to_pylist()]
                yield to_batch({"id": part.column("id").cast(pa.string()), "y": part.column("y"), "x": pa.array(xs, type=pa.list_(pa.int32()))}, pa.schema([("id", pa.string()), ("y", pa.int32()), ("x", pa.list_(pa.int32()))]))

    # Gathered in one task of bounded input; repeated ids could make it longer, so the limit is set again.
    gathered = sample.select("id", "text", "y").mapInArrow(extract, "id string, y int, x array<int>").orderBy(F.xxhash64("id"), "id", "y").limit(most_train_rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for batch in batches:
            xs = batch.column("x")
            rows += [xs[i].values.to_numpy() for i in range(len(xs))]
            ys += batch.column("y").to_pylist()
        y = np.where(np.array(ys, dtype=np.int64) == 1, 1.0, -1.0)
        w, bias = descend(rows, y, r, c, epochs, seed)
        margin = np.array([float(w[x] @ r[x]) / max(1e-9, float(np.sqrt((r[x] ** 2).sum()))) + bias for x in rows])
        a, b = calibrated(margin, y) if len(rows) else (1.0, 0.0)
        yield to_batch({"w": [w.tolist()], "bias": [float(bias)], "a": [a], "b": [b]}, pa.schema([("w", pa.list_(pa.float64())), ("bias", pa.float64()), ("a", pa.float64()), ("b", pa.float64())]))

    found = gathered.coalesce(1).mapInArrow(train, "w array<double>, bias double, a double, b double").toArrow()
    if not found.num_rows:
        return Model(r, np.zeros(len(r)), 0.0, 1.0, 0.0)
    return Model(r, found.column("w")[0].values.to_numpy(), *(found.column(x)[0].as_py() for x in ("bias", "a", "b")))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    labels: (id, label), joined on the same id_col; labels other than 0 and 1 are left out, repeated ones count
    repeatedly. Null and empty texts have no features and get the score of the bias. Without labels every score is
    0.5. Only text enters a score. Whole texts are read. Ids may be null or repeat.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    model = fit(rows, labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")), **how)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                out = pa.schema([part.schema.field("id"), ("score", pa.float64())])
                yield to_batch({"id": part.column("id"), "score": [held.value.score(t or "") for t in part.column("text").to_pylist()]}, out)

    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
