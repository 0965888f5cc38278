"""Quality classifier on random-indexing word vectors.

Words (runs of letters and digits, runs of other signs) hash to ``SLOTS`` rows.
Every slot has a fixed sparse ternary index vector; a word's vector is the sum
of the index vectors of its neighbours (``WINDOW`` on each side) over the whole
corpus: each task adds up its own rows, one grouped sum merges them. Vectors
are centred and normalised, and pooled over each whole text (mean, deviation
and mean step between neighbours). A two-layer numpy network on the pooled
vectors gives logits; a temperature fitted on rows kept apart calibrates them.

Only the network's fit is bounded: at most ``SAMPLE`` labelled rows, by hash.

Defined cases: null and empty texts pool to zeros and are scored like any other
row; conflicting labels of a doc_id count by their mean (0.5 and more is 1);
null labels and labels without a document are ignored; without labels of both
kinds the score is 0.5 everywhere; repeated rows get equal scores; an empty
table gives an empty result; lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, held_out, mix64, row_id, span_hashes, text_buffer

SLOTS = 1 << 14
DIM = 32
NONZERO = 2     # entries +1 / -1 of an index vector
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _CLASS[list(_r)] = 1


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every word and the first word index of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    c = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[0] = cut[-1] = True
    cut[1:-1] |= c[1:] != c[:-1]
    edge = np.flatnonzero(cut)
    s, e = edge[:-1], edge[1:]
    word = c[s] > 0
    s, e = s[word], e[word]
    slots = (span_hashes(data, s, e, seed=3) >> np.uint64(50)).astype(np.int64)
    return slots, np.searchsorted(s, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the nonzero entries of every slot's index vector."""
    h = mix64(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED2701)).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def context_sums(slots: np.ndarray, first: np.ndarray, dims: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """SLOTS x DIM sums of the neighbours' index vectors; texts do not mix."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat, val = [], []
    for d in range(1, WINDOW + 1):
        if len(slots) <= d:
            continue
        same = row[d:] == row[:-d]
        left, right = slots[:-d][same], slots[d:][same]
        for k in range(NONZERO):
            flat += [left * DIM + dims[right, k], right * DIM + dims[left, k]]
            val += [signs[right, k], signs[left, k]]
    if not flat:
        return np.zeros(SLOTS * DIM)
    return np.bincount(np.concatenate(flat), weights=np.concatenate(val), minlength=SLOTS * DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """SLOTS x DIM unit vectors from the co-occurrence of all rows."""
    def run(batches):
        dims, signs = index_vectors()
        acc = np.zeros(SLOTS * DIM)
        for rb in batches:
            data, off = text_buffer(rb.column(0))
            for i, j in doc_chunks(off):
                acc += context_sums(*word_slots(data[off[i]:off[j]], off[i:j + 1] - off[i]), dims, signs)
        acc = acc.reshape(SLOTS, DIM)
        live = np.flatnonzero(np.abs(acc).sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32))] + [pa.array(acc[live, k]) for k in range(DIM)],
                                         names=["slot"] + [f"v{k}" for k in range(DIM)])

    cols = [f"v{k}" for k in range(DIM)]
    parts = docs.select(F.col(text_col)).mapInArrow(run, "slot int, " + ", ".join(f"{c} double" for c in cols))
    got = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()  # at most SLOTS rows
    out = np.zeros((SLOTS, DIM))
    if got.num_rows:
        out[np.asarray(got["slot"])] = np.stack([np.asarray(got[c]) for c in cols], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    live = norm[:, 0] > 0
    out[live] /= norm[live]
    out[live] -= out[live].mean(axis=0) if live.any() else 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


FEATURES = 3 * DIM + 2


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FEATURES: mean, deviation, mean absolute step, norm of the mean, length."""
    slots, first = word_slots(data, offsets)
    n = len(first) - 1
    out = np.zeros((n, FEATURES), np.float32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    v = vectors[slots]
    at, count = first[full], np.diff(first)[full].astype(np.float32)[:, None]
    mean = np.add.reduceat(v, at, axis=0) / count
    square = np.add.reduceat(v * v, at, axis=0) / count
    step = np.zeros_like(v)
    step[:-1] = np.abs(v[1:] - v[:-1])
    step[first[full + 1] - 1] = 0  # the last word of a text has no next one
    out[full, :DIM] = mean
    out[full, DIM:2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[full, 2 * DIM:3 * DIM] = np.add.reduceat(step, at, axis=0) / np.maximum(count - 1, 1)
    out[full, -2] = np.linalg.norm(mean, axis=1)
    out[full, -1] = np.log1p(count[:, 0]) / 10
    return out


def _pool_column(vectors: np.ndarray, column) -> np.ndarray:
    data, off = text_buffer(column)
    parts = [pool(vectors, data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in doc_chunks(off)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


# ------------------------------------------------------------------- network

def logits(net: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(((x - net["mean"]) / net["scale"]) @ net["W1"] + net["b1"], 0)
    return h @ net["W2"] + net["b2"]


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict | None:
    """Two layers by Adam on four fifths of the rows, temperature on the rest."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    order = rng.permutation(len(y))
    apart, use = order[:len(y) // 5], order[len(y) // 5:]
    p = {"W1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
         "W2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(1)}
    net = {"mean": x[use].mean(axis=0), "scale": x[use].std(axis=0) + 1e-6, **p}
    m, v, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    xs = (x - net["mean"]) / net["scale"]
    size = max(16, min(256, len(use) // 8))
    for _ in range(EPOCHS):
        for s in np.array_split(rng.permutation(use), max(1, len(use) // size)):
            pre = xs[s] @ net["W1"] + net["b1"]
            h = np.maximum(pre, 0)
            z = h @ net["W2"] + net["b2"]
            g = (1 / (1 + np.exp(-z)) - y[s]) / len(s)
            back = np.outer(g, net["W2"]) * (pre > 0)
            grads = {"W1": xs[s].T @ back + 1e-4 * net["W1"], "b1": back.sum(axis=0),
                     "W2": h.T @ g + 1e-4 * net["W2"], "b2": np.array([g.sum()])}
            t += 1
            for k, d in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                net[k] = net[k] - 3e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    net["T"] = temperature(logits(net, x[apart]), y[apart]) if len(apart) else 1.0
    return net


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The T on a fixed grid with the least log loss of sigmoid(z / T)."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0.5, z, -z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, vectors, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> dict | None:
    marks = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid"))
             .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("_y")))
    base = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    pick = (base.select("_rid", "_id").where(~held_out("_id")).join(marks, F.col("_id") == F.col("_lid"))
            .orderBy(F.xxhash64("_id"), "_rid").limit(SAMPLE).select("_rid", "_y"))
    rows = base.select("_rid", "_text").join(F.broadcast(pick), "_rid").select("_y", "_text")  # at most SAMPLE rows

    def run(batches):
        for rb in batches:
            x = _pool_column(vectors.value, rb.column(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<float>").toArrow()
    if not got.num_rows:
        return None
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, FEATURES)
    y = np.asarray(got["y"]).astype(np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)  # the fit must not depend on the order rows arrive in
    return train(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, text_col))  # SLOTS x DIM floats
    net = sc.broadcast(fit(docs, labels, vectors, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for rb in batches:
            n = net.value
            x = _pool_column(vectors.value, rb.column(1))
            p = np.full(len(x), 0.5) if n is None else 1 / (1 + np.exp(-np.clip(logits(n, x.astype(np.float64)) / n["T"], -40, 40)))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
