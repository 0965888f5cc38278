"""Removal of repeated byte strings by column-wise multi-string BWT construction.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
anywhere else in the collection (another place of the same text included).

A global construction that inserts one symbol of every document a round would
need as many passes over all data as the longest text has bytes. The rounds are
bounded here by cutting the collection into short strings that are aligned
where they can agree at all:

1. Every window of ``LENGTH`` bytes has an anchor, the least hash (leftmost on
   ties) of its ``ANCHOR``-byte strings. Consecutive windows with one anchor are
   a segment. Equal windows have equal anchors at equal places, so only segments
   of one anchor string (a bucket) can share windows.
2. Segments equal byte for byte (a 128-bit content hash) are counted, not
   compared: with two copies all their windows are repeated. Buckets of one
   segment are unique. Both need no text.
3. The distinct segments of the other buckets are fetched, aligned at the
   anchor and inserted column by column from the right: each round inserts one
   symbol per segment, which updates the order of all suffixes at this column
   (the symbols in that order are the column of the Burrows-Wheeler transform)
   and the common prefixes of neighbours. A window is repeated when the common
   prefix with a neighbour reaches ``LENGTH``. Buckets stream sequentially from
   the sorted shuffle files; at most one unfinished bucket is held.
4. A bucket above ``BUCKET`` distinct segments is dealt on by the bytes that a
   range of windows has in common (64 windows, then single ones), so a passage
   in a third of all documents never meets in one task.

The same construction over words (64-bit hashes of white-space separated words as
symbols) finds passages: runs of ``WORDS`` words that also start anywhere else.
They are shorter than ``LENGTH`` bytes as a rule, so they are reported beside the
removed bytes and not removed. Both kinds of segments are fetched in one join.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep every
byte; repeated rows repeat each other; an empty table gives an empty result;
extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (CHUNK_BYTES, byte_table, complete_groups, discard, doc_chunks, materialise, mix64, powers, row_id,
                     span_hashes, text_buffer, word_hashes, word_spans)

LENGTH = 400
ANCHOR = 64
BUCKET = 4096
SPANS = (64, 1)
WORDS = 51  # over 50
WORDS_ANCHOR = 8
WORDS_SPANS = (8, 1)
_POS_BITS = np.uint64(22)  # places in a piece: pieces are shorter than 4 MB


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` entries."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have:width - have + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Arrays (row, first window, windows - 1, anchor place after the first window,
    anchor hash, two content hashes) of the segments of the rows' windows. ``data``
    are bytes or the hashes of words."""
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    if len(data) < length:
        return empty
    p, q = powers(len(data) + 1)
    sums = []
    for seed in (21, 22):
        s = np.zeros(len(data) + 1, np.uint64)
        symbols = byte_table(seed)[data] if data.dtype == np.uint8 else mix64(data + np.uint64(seed))
        np.cumsum(symbols * p[:-1], out=s[1:])
        sums.append(s)
    n = len(data) - anchor + 1
    h = mix64((sums[0][anchor:] - sums[0][:n]) * q[:n])
    mask = np.uint64((1 << int(_POS_BITS)) - 1)
    low = _sliding_min((h & ~mask) | np.arange(n, dtype=np.uint64), length - anchor + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(len(low))
    inside = row[start] == row[start + length - 1]
    start = start[inside]
    if not len(start):
        return empty
    place = (low[inside] & mask).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    s0, s1, at = start[first], start[last], place[first]
    size = (s1 - s0).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + (at - s0).astype(np.uint64)
    content = [mix64((s[s1 + length] - s[s0]) * q[s0] + size) for s in sums]
    return row[s0], s0, s1 - s0, at - s0, h[at], content[0], content[1]


def _pieces(offsets: np.ndarray, length: int):
    """(row range, byte range, bytes before it in its row) of pieces of the buffer. A row longer
    than a piece is cut into pieces that overlap so that each window lies in exactly one."""
    for i, j in doc_chunks(offsets):
        if j - i > 1 or offsets[j] - offsets[i] <= 2 * CHUNK_BYTES:
            yield i, j, int(offsets[i]), int(offsets[j]), 0
        else:
            for a in range(int(offsets[i]), int(offsets[j]), CHUNK_BYTES):
                b = min(int(offsets[j]), a + CHUNK_BYTES + length - 1)
                if b - a >= length:
                    yield i, j, a, b, a - int(offsets[i])


def _all_segments(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches):
        for rb in batches:
            data, off = text_buffer(rb.column(1))
            rid = np.asarray(rb.column(0))
            for i, j, a, b, skip in _pieces(off, length):
                local = off[i:j + 1] - off[i] if j - i > 1 or not skip and b == off[j] else np.array([0, b - a])
                row, s0, n, at, h, c1, c2 = segments(data[a:b], local, length, anchor)
                if len(row):
                    s0 = s0 - local[row] + skip
                    yield _segment_batch(rid[i + row], s0, n, at, h, c1, c2, s0, n + length)

    return texts.mapInArrow(run, _SEGMENT)


def _all_word_segments(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Segments of the texts' words; ``b0`` and ``nb`` are places of bytes."""
    def run(batches):
        for rb in batches:
            data, off = text_buffer(rb.column(1))
            rid = np.asarray(rb.column(0))
            for x, y in doc_chunks(off):
                text, ends = data[off[x]:off[y]], off[x:y + 1] - off[x]
                words, first = word_hashes(text, ends)
                w0, w1, _ = word_spans(text, ends)
                for i, j, a, b, skip in _pieces(first, length):
                    local = first[i:j + 1] - first[i] if j - i > 1 or not skip and b == first[j] else np.array([0, b - a])
                    row, s0, n, at, h, c1, c2 = segments(words[a:b], local, length, anchor)
                    if len(row):
                        begin = w0[a + s0]
                        yield _segment_batch(rid[x + i + row], s0 - local[row] + skip, n, at, h, c1, c2,
                                             begin - ends[i + row], w1[a + s0 + n + length - 1] - begin)

    return texts.mapInArrow(run, _SEGMENT)


_SEGMENT = "_rid long, s0 long, n int, at int, h long, c1 long, c2 long, b0 long, nb int"


def _segment_batch(rid, s0, n, at, h, c1, c2, b0, nb):
    return pa.RecordBatch.from_arrays(
        [pa.array(rid), pa.array(s0.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)),
         pa.array(h.view(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
         pa.array(b0.astype(np.int64)), pa.array(nb.astype(np.int32))],
        names=["_rid", "s0", "n", "at", "h", "c1", "c2", "b0", "nb"])


def repeated_windows(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, n: np.ndarray, group: np.ndarray,
                     length: int = LENGTH) -> np.ndarray:
    """rows x windows booleans: the window is repeated in another row of its group.

    Rows are strings of bytes or small numbers, aligned at place ``at`` and sorted by group (below
    65,536 groups). Columns are inserted from the right, one symbol per row and round."""
    rows = len(at)
    none = 256 if data.dtype == np.uint8 else int(data.max()) + 1
    size = np.diff(offsets)
    shift = int(at.max())
    begin = shift - at                      # column of a row's first byte
    end = begin + size
    out = np.zeros((rows, int(n.max()) + 1), bool)
    group = group.astype(np.uint16)
    order = np.arange(rows)                 # order of the suffixes at the last inserted column
    common = np.zeros(rows + 1, np.int32)   # common prefix with the suffix before, 0 at a group's first
    for c in range(int(end.max()) - 1, int(begin.min()) - 1, -1):
        there = (c >= begin[order]) & (c < end[order])
        symbol = np.full(rows, none, np.uint16 if none < 1 << 16 else np.uint32)
        live = order[there]
        symbol[there] = data[offsets[live] + c - begin[live]]
        by_symbol = np.argsort(symbol, kind="stable")
        perm = by_symbol[np.argsort(group[order[by_symbol]], kind="stable")]
        sym, grp = symbol[perm], group[order[perm]]
        new = np.zeros(rows + 1, np.int32)
        same = np.flatnonzero((sym[1:] == sym[:-1]) & (grp[1:] == grp[:-1]) & (sym[1:] < none)) + 1
        if len(same):
            lo, hi = perm[same - 1] + 1, perm[same] + 1
            near = hi - lo == 1
            new[same[near]] = common[lo[near]] + 1
            far = ~near
            if far.any():
                pairs = np.column_stack([lo[far], hi[far]]).ravel()
                new[same[far]] = np.minimum.reduceat(common, pairs)[::2] + 1
        order, common = order[perm], new
        window = c - begin[order]
        hit = ((common[:-1] >= length) | (common[1:] >= length)) & (window >= 0) & (window <= n[order])
        if hit.any():
            out[order[hit], window[hit]] = True
    return out


def _ranges(hit: np.ndarray):
    """Row, first and last column of each run of True."""
    pad = np.zeros((len(hit), 1), np.int8)
    edge = np.diff(np.concatenate([pad, hit.astype(np.int8), pad], axis=1), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return row, lo, hi - 1


def _construct(buckets: DataFrame, length: int, words: bool = False) -> DataFrame:
    """Repeated window ranges (c1, c2, lo, hi) of the segments of buckets (key, c1, c2, sub, n, at, bytes)."""
    def run(batches):
        for t, starts in complete_groups(batches, 1):
            bounds = np.concatenate([starts, [t.num_rows]])
            c1, c2, sub, n, at = (np.asarray(t.column(k)) for k in range(1, 6))
            data, off = _binary(t.column(6))
            group = np.repeat(np.arange(len(starts)), np.diff(bounds))
            i = 0
            while i < len(starts):  # whole groups, about BUCKET rows a round
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BUCKET, side="right")) - 1)
                j = min(j, i + 60_000)
                a, b = int(bounds[i]), int(bounds[j])
                i = j
                if b - a < 2:
                    continue
                part, ends = data[off[a]:off[b]], off[a:b + 1] - off[a]
                if words:
                    part, ends = word_hashes(part, ends)
                    part = np.unique(part, return_inverse=True)[1]
                hit = repeated_windows(part, ends, at[a:b].astype(np.int64), n[a:b].astype(np.int64), group[a:b] - group[a], length)
                row, lo, hi = _ranges(hit)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c1[a + row]), pa.array(c2[a + row]), pa.array((sub[a + row] + lo).astype(np.int32)),
                         pa.array((sub[a + row] + hi).astype(np.int32))], names=["c1", "c2", "lo", "hi"])

    cols = ["key", "c1", "c2", "sub", "n", "at", "bytes"]
    rows = buckets.select(*cols).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "c1 long, c2 long, lo int, hi int")


def _binary(col):
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return text_buffer(pa.Array.from_buffers(pa.large_string() if pa.types.is_large_binary(col.type) else pa.string(),
                                             len(col), col.buffers(), col.null_count, col.offset))


def _deal_on(buckets: DataFrame, span: int, length: int, anchor: int, words: bool = False) -> DataFrame:
    """Cut segments into ranges of ``span`` anchor offsets; the new key is the old one
    with the bytes (words) that all windows of the range hold."""
    def run(batches):
        for rb in batches:
            data, off = _binary(rb.column(6))
            key, c1, c2, sub, n, at = (np.asarray(rb.column(k)).astype(np.int64) for k in range(6))
            for k in range(rb.num_rows):
                text = data[off[k]:off[k + 1]]
                lo, hi = at[k] - n[k], at[k]  # places of the anchor in the segment's windows
                b = np.arange(lo // span, hi // span + 1)
                first, last = np.maximum(lo, b * span), np.minimum(hi, b * span + span - 1)
                core0, core1 = at[k] - b * span, at[k] + length - np.minimum(b * span + span - 1, length - anchor)
                s = at[k] - last  # first window of the range, from the segment's start
                if words:
                    ends = np.array([0, len(text)])
                    h = span_hashes(word_hashes(text, ends)[0].view(np.uint8), core0 * 8, core1 * 8, seed=31)
                    w0, w1, _ = word_spans(text, ends)
                    x, y = w0[s], w1[s + last - first + length - 1]
                else:
                    h = span_hashes(text, core0, core1, seed=31)
                    x, y = s, s + last - first + length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix64(h ^ mix64(b.astype(np.uint64) + key.view(np.uint64)[k])).view(np.int64)),
                     pa.array(np.full(len(b), c1[k])), pa.array(np.full(len(b), c2[k])), pa.array((sub[k] + s).astype(np.int32)),
                     pa.array((last - first).astype(np.int32)), pa.array(last.astype(np.int32)),
                     pa.array([text[i:j].tobytes() for i, j in zip(x, y)], pa.binary())],
                    names=["key", "c1", "c2", "sub", "n", "at", "bytes"])

    cols = ["key", "c1", "c2", "sub", "n", "at", "bytes"]
    return buckets.select(*cols).mapInArrow(run, "key long, c1 long, c2 long, sub int, n int, at int, bytes binary")


def _kinds(segs: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments that share their anchor, their distinct contents, and the buckets of several contents."""
    segs = materialise(segs, f"suffix-segments{name}")
    # written first: a plain shuffle on both sides lets AQE split a hot anchor
    common = materialise(segs.groupBy("h").count().where("count > 1").select("h"), f"suffix-common{name}")
    shared = materialise(segs.join(common, "h"), f"suffix-shared{name}")
    discard(segs)
    discard(common)

    kinds = shared.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"),
                                                F.min(F.struct("_rid", "s0", "n", "at", "b0", "nb")).alias("r"))
    kinds = materialise(kinds.select("h", "c1", "c2", "copies", "r.*"), f"suffix-kinds{name}")
    mixed = materialise(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), f"suffix-mixed{name}")
    return shared, kinds, mixed


def _ranges_of(segs: DataFrame, kinds: DataFrame, fetched: DataFrame, length: int, anchor: int, bucket: int, spans, words: bool,
               name: str) -> DataFrame:
    """(_rid, start, end) ranges covered by repeated strings, from the fetched segments of mixed buckets."""
    whole = kinds.where("copies > 1").select("c1", "c2", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    found = whole.unionByName(_construct(fetched.where(F.col("kinds") <= bucket), length, words))

    hot = fetched.where(F.col("kinds") > bucket)
    for span in spans:
        dealt = _deal_on(hot, span, length, anchor, words)
        dealt = materialise(dealt, f"suffix-dealt{name}-{span}")
        sizes = materialise(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), f"suffix-sizes{name}-{span}")
        dealt = dealt.join(sizes, "key")
        if span == 1:  # the common bytes are the whole window
            found = found.unionByName(dealt.select("c1", "c2", F.col("sub").alias("lo"), F.col("sub").alias("hi")))
        else:
            found = found.unionByName(_construct(dealt.where(F.col("kinds") <= bucket), length, words))
            hot = dealt.where(F.col("kinds") > bucket)
    got = segs.join(materialise(found, f"suffix-found{name}"), ["c1", "c2"])
    return got.select("_rid", (F.col("s0") + F.col("lo")).alias("start"), (F.col("s0") + F.col("hi") + length).alias("end"))


def repeated_ranges(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET,
                    words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(_rid, start, end) byte ranges of ``texts`` (_rid, _text) covered by repeated strings of ``length`` bytes (may
    overlap), and word ranges covered by repeated passages of ``words`` words."""
    near = min(WORDS_ANCHOR, words)
    parts = [_kinds(_all_segments(texts, length, anchor), ""), _kinds(_all_word_segments(texts, words, near), "-words")]
    wanted = [kinds.join(mixed, "h").withColumn("words", F.lit(i == 1)) for i, (_, kinds, mixed) in enumerate(parts)]

    # a segment's bytes are cut out of its text right after the join
    cut = F.substring(F.col("_text").cast("binary"), (F.col("b0") + 1).cast("int"), F.col("nb"))
    fetched = (texts.hint("merge").join(wanted[0].unionByName(wanted[1]), "_rid")
               .select(F.col("h").alias("key"), "c1", "c2", F.lit(0).alias("sub"), "n", "at", cut.alias("bytes"), "kinds", "words"))
    fetched = materialise(fetched, "suffix-fetched")
    return (_ranges_of(*parts[0][:2], fetched.where("not words"), length, anchor, bucket, SPANS, False, ""),
            _ranges_of(*parts[1][:2], fetched.where("words"), words, near, bucket, WORDS_SPANS, True, "-words"))


def merge(ranges) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR, bucket: int = BUCKET, words: int = WORDS) -> DataFrame:
    """One row per input row: _id, n_bytes, n_removed, n_spans, spans (merged byte ranges), kept (remaining bytes),
    n_passage_words and passages (merged ranges of words in repeated runs of ``words`` words, which stay)."""
    base = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = base.select("_rid", "_text")
    strings, passages = repeated_ranges(texts, length, anchor, bucket, words)
    both = strings.withColumn("words", F.lit(False)).unionByName(passages.withColumn("words", F.lit(True)))
    span = F.struct("start", "end")
    per_row = both.groupBy("_rid").agg(F.collect_set(F.when(~F.col("words"), span)).alias("_ranges"),  # one text's own
                                       F.collect_set(F.when(F.col("words"), span)).alias("_passages"))
    rows = base.join(per_row, "_rid", "left").select("_id", "_text", "_ranges", "_passages")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def merged(col):
        return [[{"start": a, "end": b} for a, b in merge((x["start"], x["end"]) for x in r or ())] for r in col.to_pylist()]

    def total(spans):
        return pa.array([sum(x["end"] - x["start"] for x in s) for s in spans], pa.int64())

    def run(batches):
        for rb in batches:
            data, off = text_buffer(rb.column(1))
            spans, runs, kept = merged(rb.column(2)), merged(rb.column(3)), []
            for i, s in enumerate(spans):
                text = data[off[i]:off[i + 1]]
                at, parts = 0, []
                for x in s:
                    parts.append(text[at:x["start"]])
                    at = x["end"]
                kept.append(b"".join(x.tobytes() for x in (*parts, text[at:])))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(np.diff(off)), total(spans), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, spans_type), pa.array(kept, pa.binary()), total(runs), pa.array(runs, spans_type)],
                names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_passage_words", "passages"])

    kind = rows.schema["_id"].dataType.simpleString()
    ranges = "array<struct<start: long, end: long>>"
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_removed long, n_spans long, spans {ranges}, kept binary, "
                                f"n_passage_words long, passages {ranges}")
