"""Language identification with string kernels.

Texts are compared by a blended-spectrum presence kernel: the set of character
n-grams (n = 1..3 over lower-cased UTF-8 bytes, non-letters of ASCII as blanks)
of the whole text, k(x, z) = |x & z| / sqrt(|x| |z|). n-grams of length 3 are
hashed to ``2**16`` slots. Nystrom landmarks turn the kernel into features and
one-versus-rest kernel ridge regression is solved on them; scoring is two
batched matrix products, K = X L and F = K A.

Only the fit is bounded: at most ``SAMPLE`` labelled rows in all, chosen per
language by hash, ``LANDMARKS`` of them as landmarks. Every text is scored whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any labelled row every text is ``und``; repeated rows get equal
results; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_chunks, held_out, materialise, row_id, text_buffer

SAMPLE = 1200      # labelled rows used for the fit, all languages together
LANDMARKS = 128    # of these, landmarks
RIDGE = 1e-3
SHARPNESS = 4.0    # of the soft maximum that makes scores of ridge outputs
DIM = 256 + 65536 + 65536
ROWS = 64          # texts in one matrix product

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _b in (*range(0, 65), *range(91, 97), *range(123, 128)):
    _LOWER[_b] = 32


def _letters(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    if len(out) > 1:  # capital letters of Latin-1 in UTF-8
        at = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[at] += 32
    return out


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boolean matrix rows x DIM of the n-grams that each text holds."""
    n = len(offsets) - 1
    seen = np.zeros((n, DIM), bool)
    b = _letters(data)
    for r in range(n):
        x, row = b[offsets[r]:offsets[r + 1]], seen[r]
        if not len(x):
            continue
        row[x] = True
        if len(x) > 1:
            two = x[:-1].astype(np.int32) * 256 + x[1:]
            row[256 + two] = True
            if len(x) > 2:
                three = (two[:-1].astype(np.uint32) * np.uint32(256) + x[2:]) * np.uint32(0x9E3779B1)
                row[256 + 65536 + (three >> np.uint32(16)).astype(np.int32)] = True
    return seen


def _sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """(lang, slots) of a bounded sample of the labelled rows that are not held out."""
    base = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"),
                       F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    ok = base.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (F.length("_text") > 0) & ~held_out("_id"))
    sizes = materialise(ok.groupBy(F.col("_lang").alias("_l")).agg(F.count(F.lit(1)).alias("_size")), "lang-sizes")
    langs = sizes.count()
    if not langs:
        return None
    per = max(2, SAMPLE // langs)
    # a language's rows are thinned by hash to about 8 * per before they are ranked
    drawn = ok.select("_lang", "_rid", F.xxhash64("_id", "_rid").alias("_draw")).join(sizes, F.col("_lang") == F.col("_l"))
    drawn = drawn.where(F.pmod("_draw", F.lit(1 << 30)) * F.col("_size") <= float(8 * per) * (1 << 30))
    w = Window.partitionBy("_lang").orderBy(F.pmod("_draw", F.lit(1 << 30)), "_rid")
    pick = drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per).select("_rid", "_n")
    rows = ok.join(F.broadcast(pick), "_rid")  # at most max(SAMPLE, 2 * languages) rows

    def grams(batches):
        for rb in batches:
            data, off = text_buffer(rb.column(2))
            slots = []
            for i in range(rb.num_rows):
                x = data[off[i]:off[i + 1]]
                slots.append(np.flatnonzero(presence(x, np.array([0, len(x)]))[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(slots, pa.list_(pa.int32()))],
                                             names=["lang", "n", "slots"])

    return rows.select("_lang", "_n", "_text").mapInArrow(grams, "lang string, n int, slots array<int>")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Landmarks and ridge weights; None when no row is labelled."""
    sample = _sample(docs, text_col, lang_col, id_col)
    rows = sample.toArrow().to_pydict() if sample is not None else {"lang": []}
    if not rows["lang"]:
        return None
    order = sorted(range(len(rows["lang"])), key=lambda i: (rows["n"][i], rows["lang"][i]))
    sets = [np.asarray(rows["slots"][i], np.int64) for i in order]
    lang = [rows["lang"][i] for i in order]
    names = sorted(set(lang))
    marks = min(len(sets), max(LANDMARKS, len(names)))  # round robin over the languages, by the order
    active = np.unique(np.concatenate(sets[:marks]))
    place = np.full(DIM, -1)
    place[active] = np.arange(len(active))
    L = np.zeros((len(active), marks), np.float32)
    for j, s in enumerate(sets[:marks]):
        L[place[s], j] = 1 / np.sqrt(len(s))
    K = np.zeros((len(sets), marks))
    for i, s in enumerate(sets):
        p = place[s]
        K[i] = L[p[p >= 0]].sum(axis=0, dtype=np.float64) / np.sqrt(len(s))
    val, vec = np.linalg.eigh(K[:marks] + K[:marks].T)
    keep = val > 1e-6 * val.max()
    half = vec[:, keep] / np.sqrt(val[keep] / 2)
    Z = K @ half
    Y = np.where(np.array(lang)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    A = half @ np.linalg.solve(Z.T @ Z + RIDGE * len(sets) * np.eye(Z.shape[1]), Z.T @ Y)
    return {"langs": names, "active": active, "L": L, "A": A.astype(np.float32)}


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = _LOWER[data]
    total = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace")))
    return out


def score_batch(model: dict | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = len(offsets) - 1
    if model is None:
        return ["und"] * n, np.zeros(n)
    seen = presence(data, offsets)
    size = np.maximum(seen.sum(axis=1), 1)
    f = (seen[:, model["active"]].astype(np.float32) @ model["L"] / np.sqrt(size)[:, None].astype(np.float32)) @ model["A"]
    f = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
    best, letter = f.argmax(axis=1), _has_letter(data, offsets)
    score = np.where(letter, f[np.arange(n), best] / f.sum(axis=1), 0.0)
    return [model["langs"][b] if ok else "und" for b, ok in zip(best, letter)], score


def _score_column(model: dict | None, column) -> tuple[list[str], np.ndarray]:
    data, off = text_buffer(column)
    pred, score = [], []
    for i, j in doc_chunks(off):
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            p, s = score_batch(model, data[off[a]:off[b]], off[a:b + 1] - off[a])
            pred += p
            score.append(s)
    return pred, np.concatenate(score) if score else np.zeros(0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    # the model is bounded: n-grams of LANDMARKS texts x LANDMARKS floats
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for rb in batches:
            pred, score = _score_column(shared.value, rb.column(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(pred, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language (not ``und``), with the input's columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for rb in batches:
            pred, _ = _score_column(shared.value, rb.column(at))
            yield rb.filter(pa.array([p != "und" for p in pred], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
