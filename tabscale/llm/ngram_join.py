"""Near-duplicate join: Jaccard similarity of word shingles by MinHash banding.

Texts are sets of five-word shingles of their whole word sequence (white-space
words). Texts with the same word sequence are one representative with a count,
so copies are never paired. ``choose_bands`` takes the most selective banding
whose recall at the threshold reaches the target within ``MAX_HASHES`` hashes.
Representatives meet on band hashes: each bucket links its members to its least
member (one row per member, never pairs), and the linked representatives form
candidate clusters. A cluster is verified on the full shingle sets: all its
pairs, by products of presence matrices; a cluster above ``BLOCK`` texts is cut
into hash blocks and every pair of blocks is one unit of work, so no task holds
a hot cluster. A unit gives one row per text: its number of verified links and
the least text it hangs together with. Verified links close to classes.

Defined cases: a text of 1 to 4 words has one shingle, the whole text; texts
without a word (null, empty, blank) have no links and are classes of their own;
repeated rows and copies link to each other; the least doc_id (null last, then
scan order) names and keeps a class; an empty table gives an empty result;
extra columns play no part and come back unchanged from ``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (complete_groups, connected_components, doc_chunks, materialise, mix64, row_id, shingles, text_buffer,
                     word_hashes)

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 160
BLOCK = 1024        # texts in a block of a large cluster
BLOCK_SHINGLES = 1 << 19


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band such that pairs at the threshold meet with the target recall."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def signature(sh: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands of band hashes (0 for a text without a shingle)."""
    n = len(first) - 1
    out = np.zeros((n, bands), np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    x = (sh >> np.uint64(32)).astype(np.uint32)
    seeds = mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    mul = (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (seeds[1::2] >> np.uint64(32)).astype(np.uint32)
    at = first[full]
    for b in range(bands):
        h = np.full(len(full), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat(x * mul[r] + add[r], at)
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        out[full, b] = h.view(np.int64)
    return out


def _sequence_hash(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    n = len(first) - 1
    out = np.zeros(n, np.uint64)
    count = np.diff(first)
    full = np.flatnonzero(count > 0)
    if len(full):
        place = np.arange(len(words)) - np.repeat(first[:-1], count)
        v = mix64(words ^ mix64(place.astype(np.uint64) + np.uint64(seed)))
        out[full] = mix64(np.add.reduceat(v, first[full]) + count[full].astype(np.uint64))
    return out.view(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, k: int) -> DataFrame:
    base = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        for rb in batches:
            data, off = text_buffer(rb.column(2))
            one, two, size, sig = [], [], [], []
            for i, j in doc_chunks(off):
                w, first = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                sh, at = shingles(w, first, k)
                one.append(_sequence_hash(w, first, 11))
                two.append(_sequence_hash(w, first, 12))
                size.append(np.diff(at))
                sig.append(signature(sh, at, bands, rows))
            flat = np.concatenate(sig).ravel() if sig else np.zeros(0, np.int64)
            n = rb.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(flat))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), cat(one), cat(two), cat(size), lists],
                                             names=["_rid", "_id", "_h1", "_h2", "_size", "_bands"])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_rid long, _id {kind}, _h1 long, _h2 long, _size long, _bands array<long>")


def _presence(shingle: np.ndarray, doc: np.ndarray, n: int):
    """Column chunks of the texts x shingles matrix, shingles of one text left out."""
    order = np.argsort(shingle, kind="stable")
    s, d = shingle[order], doc[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1
    col, d = col[often], d[often]
    if not len(col):
        return
    col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)]))
    width = max(256, (1 << 22) // max(n, 1))
    for lo in range(0, int(col[-1]) + 1, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((n, min(width, int(col[-1]) + 1 - lo)), np.float32)
        x[d[a:b], col[a:b] - lo] = 1
        yield x


def verify(data: np.ndarray, offsets: np.ndarray, side: np.ndarray, k: int, threshold: float, across: bool) -> np.ndarray:
    """Boolean link matrix of the texts of a unit: all pairs of one block, or only those across two."""
    n = len(offsets) - 1
    sh, at = shingles(*word_hashes(data, offsets), k)
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    keep = np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])]) if len(sh) else np.zeros(0, bool)
    sh, doc = sh[keep], doc[keep]
    size = np.bincount(doc, minlength=n).astype(np.float64)
    both = np.zeros((n, n))
    for x in _presence(sh, doc, n):
        both += x @ x.T
    link = np.zeros((n, n), bool)
    for lo in range(0, n, 128):  # a few rows at a time: no second matrix of all pairs
        part = both[lo:lo + 128]
        link[lo:lo + 128] = (part >= threshold * (size[lo:lo + 128, None] + size[None, :] - part) - 1e-9) & (part > 0)
        if across:
            link[lo:lo + 128] &= side[lo:lo + 128, None] != side[None, :]
    np.fill_diagonal(link, False)
    return link


def roots(link: np.ndarray) -> np.ndarray:
    """For each text the first text of its component in the link matrix."""
    n = len(link)
    lab = np.arange(n)
    while True:
        near = np.concatenate([np.where(link[i:i + 128], lab[None, :], n).min(axis=1) for i in range(0, n, 128)])
        new = np.minimum(lab, near)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                       threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: _rid, _id, class_id, n_links (rows linked to it), kept."""
    bands, rows = choose_bands(threshold, recall)
    sig = materialise(_signatures(docs, id_col, text_col, bands, rows, k), "join-signatures")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_rid").alias("r"))
    texts = (sig.where("_size > 0").groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("copies"), F.min("_rid").alias("v")))
    texts = materialise(texts, "join-texts")

    reps = sig.select(F.col("_rid").alias("v"), "_size", "_bands").join(texts.select("v", "copies"), "v")
    met = reps.select("v", F.posexplode("_bands").alias("band", "hash"))
    buckets = met.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("m")).where("c > 1")
    buckets = materialise(buckets, "join-buckets")  # a plain shuffle on both sides lets AQE split a hot bucket
    edges = met.join(buckets, ["band", "hash"]).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    clusters = connected_components(edges, "join-candidates")

    # units of work: a cluster, or a pair of blocks of a large one
    members = materialise(clusters.join(reps.select("v", "_size", "copies"), "v"), "join-members")
    extent = members.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK),
                                                     F.ceil(F.sum("_size") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    dealt = members.join(extent, "label").withColumn("blk", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
    texts_of = docs.select(row_id(docs).alias("v"), F.col(text_col).alias("_text"))
    dealt = dealt.join(texts_of.hint("merge"), "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = dealt.select("label", F.least("blk", "other").cast("long").alias("i"), F.greatest("blk", "other").cast("long").alias("j"),
                         "v", "copies", F.col("blk").cast("long").alias("blk"), "_text")
    units = units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")

    def run(batches):
        for t, starts in complete_groups(batches, 3):
            i, j, v, copies, blk = (np.asarray(t.column(c)) for c in (1, 2, 3, 4, 5))
            data, off = text_buffer(t.column(6))
            out = [[], [], []]
            for a, b in zip(starts, [*starts[1:], t.num_rows]):
                across = bool(i[a] != j[a])
                # with one block empty the pairs of the other are left to its own unit
                if b - a < 2 or across and blk[a:b].min() == blk[a:b].max():
                    continue
                link = verify(data[off[a]:off[b]], off[a:b + 1] - off[a], blk[a:b], k, threshold, across)
                some = np.flatnonzero(link.any(axis=1))
                if len(some):
                    out[0].append(v[a:b][some])
                    out[1].append((link[some] @ copies[a:b]).astype(np.int64))
                    out[2].append(v[a:b][roots(link)[some]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["v", "links", "root"])

    links = materialise(units.mapInArrow(run, "v long, links long, root long"), "join-links")
    closed = connected_components(links.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")), "join-classes")
    found = (links.groupBy("v").agg(F.sum("links").alias("links")).join(closed, "v", "left"))

    of_text = texts.join(found, "v", "left").select(
        "_h1", "_h2", F.coalesce("label", "v").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows_ = materialise(sig.select("_rid", "_id", "_h1", "_h2", "_size").where("_size > 0").join(of_text, ["_h1", "_h2"])
                        .select("_rid", "_id", "_class", "n_links"), "join-rows")
    heads = materialise(rows_.groupBy("_class").agg(F.min(order).alias("_head")), "join-heads")
    some = rows_.join(heads, "_class").select("_rid", "_id", F.col("_head.i").alias("class_id"), F.col("n_links").cast("long"),
                                              (F.col("_rid") == F.col("_head.r")).alias("kept"))
    none = sig.where("_size = 0").select("_rid", "_id", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                         F.lit(True).alias("kept"))
    return some.unionByName(none)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class, with the input's columns."""
    dropped = similarity_classes(docs, id_col, text_col, **how).where("not kept").select(F.col("_rid").alias("__llm_rid"))
    return (docs.withColumn("__llm_rid", row_id(docs))
            .join(dropped, "__llm_rid", "left_anti").drop("__llm_rid"))
