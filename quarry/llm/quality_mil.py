"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each). Every passage is described by
character and word statistics and encoded by a small layer; gated attention

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )

weighs the passages, learned from document labels alone, and the weighted passage
representation is scored by a logistic output. The model is fitted by numpy on a
bounded sample of labelled documents (TRAINING_DOCUMENTS, least hash of the key first;
texts of up to TRAINING_CHARS characters); every passage of every document is scored
in Arrow tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A

PASSAGE_WORDS = 64
TRAINING_DOCUMENTS = 4000
TRAINING_CHARS = 200_000
HIDDEN, GATE = 24, 12
EPOCHS, LEARNING_RATE, DECAY = 60, 0.01, 1e-4
_U = A.U64

# fixed values: the byte classes that are counted
_CLASSES = [
    np.isin(np.arange(256), list(range(65, 91))),
    np.isin(np.arange(256), list(range(97, 123))),
    np.isin(np.arange(256), list(range(48, 58))),
    np.isin(np.arange(256), list(b".,;:?'\"-")),
    np.isin(np.arange(256), list(b"!#$%&*+/<=>@\\^_`{|}~()[]")),
    np.arange(256) >= 128,
]
FEATURES = len(_CLASSES) + 7


def passages(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, row limits); a text without words is one empty passage."""
    words = A.split_words(chunk)
    counts = np.diff(words.row_first)
    per_row = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    limits = np.concatenate([[0], np.cumsum(per_row)])
    n = int(limits[-1])
    out = np.zeros((n, FEATURES))
    if not len(words):
        return out, limits
    hashes = A.span_hashes(chunk.data, words.start, words.end)
    rows = words.rows_of
    passage = limits[rows] + (np.arange(len(words)) - words.row_first[rows]) // PASSAGE_WORDS
    size = np.bincount(passage, minlength=n)
    length = words.end - words.start
    chars = np.maximum(np.bincount(passage, length, n), 1)
    for k, member in enumerate(_CLASSES):
        running = np.concatenate([[0], np.cumsum(member[chunk.data])])
        of_word = running[words.end] - running[words.start]
        out[:, k] = np.bincount(passage, of_word, n) / chars
        if k == 4:
            marked = of_word > 0
    k = len(_CLASSES)
    some = np.maximum(size, 1)
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    # distinct words of a passage, and words that the previous passage of the row has too
    order = np.lexsort((passage, hashes))
    h, p, r = hashes[order], passage[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    seen = np.zeros(len(h), bool)
    seen[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1]) & (p[1:] != p[:-1])
    out[:, k] = np.log1p(size) / 5
    out[:, k + 1] = np.minimum(chars / some, 40) / 10
    out[:, k + 2] = np.bincount(passage, same, n) / some
    out[:, k + 3] = np.bincount(p, fresh, n) / some
    out[:, k + 4] = np.bincount(p, seen, n) / some
    out[:, k + 5] = np.bincount(passage, marked, n) / some
    out[:, k + 6] = np.sqrt(np.maximum(np.bincount(passage, length ** 2.0, n) / some - (chars / some) ** 2, 0)) / 10
    return out, limits


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict

    def forward(self, x: np.ndarray, limits: np.ndarray):
        w, at = self.weights, limits[:-1]
        rows = A.row_ids(limits)
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ w["We"] + w["be"], 0)
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw = (t * g) @ w["w"]
        e = np.exp(raw - np.maximum.reduceat(raw, at)[rows])
        a = e / np.add.reduceat(e, at)[rows]
        z = np.add.reduceat(a[:, None] * h, at)
        return x, rows, h, t, g, a, z, _sigmoid(z @ w["wo"] + w["bo"])

    def score(self, x: np.ndarray, limits: np.ndarray) -> np.ndarray:
        return self.forward(x, limits)[-1]

    def gradients(self, x, limits, y, weight) -> dict:
        w, at = self.weights, limits[:-1]
        x, rows, h, t, g, a, z, p = self.forward(x, limits)
        out = weight * (p - y) / weight.sum()
        dz = out[:, None] * w["wo"]
        inner = (dz[rows] * h).sum(axis=1)
        draw = a * (inner - np.add.reduceat(a * inner, at)[rows])
        dgate = draw[:, None] * w["w"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = (a[:, None] * dz[rows] + dt @ w["V"].T + dg @ w["U"].T) * (h > 0)
        return {"We": x.T @ dh, "be": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
                "w": (t * g).T @ draw, "wo": z.T @ out, "bo": out.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on mini-batches of documents; both labels weigh alike."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    scale = every.std(axis=0)
    shapes = {"We": (FEATURES, HIDDEN), "be": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE),
              "w": (GATE,), "wo": (HIDDEN,), "bo": ()}
    model = Model(every.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), {
        k: np.zeros(s) if k in ("be", "bo") else rng.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()})
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the one label, or an even chance
        model.weights["wo"][:] = 0
        model.weights["bo"] = np.array(0.0 if not len(labels) else (4.0 if labels[0] else -4.0))
        return model
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first, second, step = {k: 0.0 for k in shapes}, {k: 0.0 for k in shapes}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            chosen = order[i:i + 64]
            limits = np.concatenate([[0], np.cumsum([len(bags[j]) for j in chosen])])
            grads = model.gradients(np.concatenate([bags[j] for j in chosen]), limits,
                                    labels[chosen], weight[chosen])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - LEARNING_RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(key):
    return F.crc32(key.cast("string")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(body, y) of at most TRAINING_DOCUMENTS labelled documents that are not held out."""
    known = labels.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("int").alias("y"))
    # a bounded query set, so it may be broadcast
    chosen = (known.filter(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key")))
              .groupBy("key").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("key"), "key").limit(TRAINING_DOCUMENTS))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    return (rows.filter(F.char_length("body") <= TRAINING_CHARS).join(F.broadcast(chosen), "key")
            .select("key", "body", "y"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model:
    """A model of ``label`` from the training sample. Labels other than 0 and 1 are not
    used; a document labelled twice counts as good if one label says so; without both
    labels the model gives the one there is, or 0.5."""
    def describe(batches):
        for batch in batches:
            for chunk in A.chunks(A.string_column(batch, "body")):
                x, limits = passages(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first_row, chunk.rows),
                     batch.column(2).slice(chunk.first_row, chunk.rows),
                     pa.array([x[a:b].ravel() for a, b in zip(limits[:-1], limits[1:])], pa.list_(pa.float64()))],
                    names=["key", "y", "x"])

    sample = training_sample(docs, labels, key, text, label)
    rows = sample.mapInArrow(A.tidy(describe), "key bigint, y int, x array<double>").toPandas()
    rows = rows.sort_values("key", kind="stable")  # the fit does not depend on the order of tasks
    return fit([np.asarray(x).reshape(-1, FEATURES) for x in rows.x], rows.y.to_numpy())


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    parts = [model.score(*passages(chunk)) for chunk in A.chunks(column, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros(0)


def quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher is better), predicted (1 from
    0.5 up). Null and empty texts are one empty passage; very long texts are scored
    whole; repeated rows are scored each; an empty table gives no row; other columns
    are not read."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("body"))

    def run(batches):
        for batch in batches:
            score = _scores(model.value, A.string_column(batch, "body"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(A.tidy(run), "doc_id bigint, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that the model rejects."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, A.string_column(batch, text)) >= 0.5))

    return docs.mapInArrow(A.tidy(run), docs.schema)
