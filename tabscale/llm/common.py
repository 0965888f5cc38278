"""Helpers shared by the corpus operators: shared scratch tables, Arrow text
buffers as numpy bytes, vectorised word hashing and shingling."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscale.session import scratch_path

CHUNK_BYTES = 1 << 20  # bytes of text handled by one round of numpy calls


def materialise(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet, a folder for each value of ``folders``, and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs
    a re-read and never a recomputation of earlier stages.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_id(df: DataFrame):
    """Column that numbers the rows of ``df``, alike in every scan of the same files.

    Spark cuts files into tasks by the cores it has at that moment, so an executor lost or won
    between two scans would renumber the rows. The number it cuts by is therefore fixed for the
    session at first use, where the cluster has not set ``spark.sql.files.minPartitionNum`` itself."""
    conf, sc = df.sparkSession.conf, df.sparkSession.sparkContext
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(sc.defaultParallelism))
    return F.monotonically_increasing_id()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str):
    """True where crc32(doc_id as text) mod 4 is 2 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- text buffers

def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1] if off is not None \
        else np.zeros(len(arr) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return raw[base:int(offsets[-1]) if len(offsets) else 0], offsets - base


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) of about ``limit`` bytes each (a longer row comes alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


# ------------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for key, b in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit content hash of each byte span, in one pass over the bytes."""
    p, q = powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(seed)[data] * p[:-1], out=acc[1:])
    h = (acc[ends] - acc[starts]) * q[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# UTF-8 forms of the wide white space that str.split() also cuts at
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def space_mask(data: np.ndarray) -> np.ndarray:
    """True at every byte of white space, the set that ``str.split`` uses."""
    ws = _SPACE[data]
    if data.size and data.max() >= 0xC2:
        lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        for w in _WIDE if lead.size else ():
            at = lead[data[lead] == w[0]]
            at = at[at + len(w) <= len(data)]
            for k in range(1, len(w)):
                at = at[data[at + k] == w[k]]
            for k in range(len(w)):
                ws[at + k] = True
    return ws


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of white-space separated words, and for each row the
    index of its first word (one more entry than rows). Words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~space_mask(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word index of each row."""
    s, e, first = word_spans(data, offsets)
    return span_hashes(data, s, e), first


_MULT = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, row after row, and the first index of each
    row. A row with 1 to k-1 words has one shingle (all its words); a row with
    no word has none."""
    n, counts = len(words), np.diff(first)
    acc = np.zeros(max(n, 1), np.uint64)
    for j in range(k):
        if n > j:
            acc[:n - j] = acc[:n - j] * _MULT + words[j:]
    per = np.maximum(counts - (k - 1), (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(counts)), per)
    idx = np.arange(int(out_first[-1])) - out_first[row] + first[row]
    out = acc[idx] if len(idx) else np.zeros(0, np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        h = 0
        for w in words[first[r]:first[r + 1]].tolist():
            h = (h * int(_MULT) + w) % (1 << 64)
        out[out_first[r]] = h ^ int(counts[r])
    return mix64(out), out_first


# ---------------------------------------------------------- groups and graphs

def complete_groups(batches, n_keys: int):
    """Tables of whole groups from batches sorted by their first ``n_keys``
    integer columns, with the row index at which each group starts. A group that
    continues in the next batch is carried over; nothing else is held."""
    carry: list[pa.RecordBatch] = []

    def keys_of(t):
        return np.column_stack([np.asarray(t.column(k)) for k in range(n_keys)])

    def starts_of(keys):
        return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])

    for rb in batches:
        if not rb.num_rows:
            continue
        keys = keys_of(rb)
        s = starts_of(keys)
        if carry and (keys_of(carry[-1].slice(carry[-1].num_rows - 1))[0] == keys[0]).all():
            if len(s) == 1:
                carry.append(rb)
                continue
            cut = int(s[-1])
        else:
            if carry:
                t = pa.Table.from_batches(carry)
                yield t.combine_chunks(), starts_of(keys_of(t))
                carry = []
            cut = int(s[-1])
        if cut:
            t = pa.Table.from_batches([*carry, rb.slice(0, cut)])
            yield t.combine_chunks(), starts_of(keys_of(t))
            carry = []
        carry.append(rb.slice(cut))
    if carry:
        t = pa.Table.from_batches(carry)
        yield t.combine_chunks(), starts_of(keys_of(t))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(v, label) of every vertex of the edges (a, b): label is the component's least vertex.

    First every vertex keeps the edge to its least smaller neighbour and hands its other smaller
    neighbours to that one, which leaves about one edge a vertex (a vertex may have many greater
    neighbours; its smaller ones pass one window group, which spills). Then least-label propagation
    with pointer jumping; each round is written to the shared folder, the round before is deleted,
    and only whether a label changed reaches the driver."""
    up = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    up = materialise(up.withColumn("m", F.min("b").over(Window.partitionBy("a"))), f"{name}-edges")
    thin = (up.where("b = m").select("a", "b").unionByName(up.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct())
    both = materialise(thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-thin")
    discard(up)
    lab = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                      .select("v", F.least("v", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (both.join(lab.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v"))
                .agg(F.min("label").alias("m")))
        got = lab.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = lab.select(F.col("v").alias("l"), F.col("label").alias("j"))
        new = materialise(got.join(jump, "l").select("v", "old", F.least("l", "j").alias("label")), f"{name}-{step}")
        discard(lab)
        if new.where("label <> old").limit(1).count() == 0:
            discard(both)
            return new.select("v", "label")
        lab, lab._scratch = new.select("v", "label"), new._scratch
