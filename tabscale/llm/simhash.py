"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingles' 64-bit
hashes have it. Fingerprints at most ``distance`` bits apart are linked, and
links close to components.

With ``distance // 2 + 1`` segments, two linked fingerprints differ by at most
one bit in some segment (else they would differ by two in each). Every distinct
fingerprint is therefore indexed under the one-wildcard variants of its
segments, 64 in all: the segment with one bit left out, and the place of that
bit. Linked fingerprints are equal in a variant, so an equality join finds all
candidates, and each is verified by the full bit difference:

1. every bucket of equal variants has a head, its least fingerprint, found by a
   partial aggregate; members within the distance of their head are linked to
   it (one row per member, never pairs), and the links close to components;
2. only a bucket whose members are still in different components has more to
   tell. Its pairs across components are compared in blocks: members outside
   the bucket's largest component against all members, ``BLOCK`` by ``BLOCK``,
   so no task holds a hot bucket; one link per pair of components leaves a task.

Defined cases: equal fingerprints are one vertex, so copies are never paired;
a text with fewer words than a shingle has one shingle, all its words; a text
without a word (null, empty, blank) has fingerprint zero and is linked like any
other; repeated rows each come back; a null id never names a component unless
all its ids are null; an empty table gives an empty result; extra columns play
no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import complete_groups, connected_components, discard, materialise, row_id, text_buffer

WORDS = 4
DISTANCE = 4
SEED = 42
BITS = 64
BLOCK = 1024             # fingerprints on each side of a comparison
_PART = 1 << 20          # bytes of a text split into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(raw: bytes, k: int = WORDS, seed: int = SEED):
    """XXH64 arrays of the k-word shingles of one text, part by part (the last k-1 words carry over)."""
    carry, at, any_yet = [], 0, False
    while at < len(raw):
        end = at + _PART
        cut = _SPACE.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        words = carry + raw[at:end].lower().split()
        at = end
        if len(words) < k:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - k + 1]
        hashed = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())]
        yield np.array(hashed, np.uint64)
        any_yet, carry = True, words[len(words) - k + 1:]
    if not any_yet and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64)


def fingerprint(raw: bytes, k: int = WORDS, seed: int = SEED) -> int:
    """The text's fingerprint as a signed 64-bit integer."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(raw, k, seed):
        for i in range(0, len(h), 1 << 14):
            part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: _rid, _id, _fp."""
    base = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        for rb in batches:
            data, off = text_buffer(rb.column(2))
            fp = [fingerprint(data[a:b].tobytes(), k, seed) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(fp, pa.int64())], names=["_rid", "_id", "_fp"])

    return base.mapInArrow(run, f"_rid long, _id {base.schema['_id'].dataType.simpleString()}, _fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit."""
    edges = np.linspace(0, BITS, distance // 2 + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _variant_rows(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, place, rest): for every bit its segment without that bit."""
    found = []
    for low, width in segments(distance):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))
        for bit in range(width):
            mask = ~(1 << bit)
            found.append(part.bitwiseAND(F.lit(mask if bit < BITS - 1 else (1 << (BITS - 1)) - 1)))
    return fps.select("fp", F.posexplode(F.array(*found)).alias("place", "rest"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a, b), by union-find."""
    parent: dict[int, int] = {}
    keep = np.zeros(len(a), bool)

    def root(x):
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep[i] = True
    return a[keep], b[keep]


def _across(met: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between components, from the members (place, rest, fp, label) of buckets."""
    per = met.groupBy("place", "rest", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = (per.groupBy("place", "rest").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("c"),
                                              F.count(F.lit(1)).alias("labels")).where("labels > 1")
             .select("place", "rest", F.col("top.label").alias("top"), F.ceil(F.col("c") / BLOCK).cast("int").alias("na"),
                     F.ceil((F.col("c") - F.col("top.n")) / BLOCK).cast("int").alias("nr")))
    mixed = materialise(mixed, "simhash-mixed")
    dealt = met.join(mixed, ["place", "rest"])
    blk = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = dealt.where("label <> top").select("place", "rest", blk("nr", 1).alias("i"), blocks("na").alias("j"),
                                              F.lit(0).alias("side"), "fp", "label")
    full = dealt.select("place", "rest", blocks("nr").alias("i"), blk("na", 2).alias("j"), F.lit(1).alias("side"), "fp", "label")
    keys = ["place", "rest", "i", "j"]
    units = rest.unionByName(full).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for t, starts in complete_groups(batches, 4):
            side, fp, label = (np.asarray(t.column(c)) for c in (4, 5, 6))
            fp = fp.view(np.uint64)
            got = [[], []]
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                one, two = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                for lo in range(0, len(one), BLOCK):
                    r = one[lo:lo + BLOCK]
                    near = np.bitwise_count(fp[r][:, None] ^ fp[two][None, :]) <= distance
                    near &= label[r][:, None] != label[two][None, :]
                    x, y = np.nonzero(near)
                    if len(x):
                        a, b = forest(label[r][x], label[two][y])
                        got[0].append(a)
                        got[1].append(b)
            if got[0]:
                a, b = forest(np.concatenate(got[0]), np.concatenate(got[1]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, label) of every distinct fingerprint of ``_fp``: label is alike within a component."""
    fps = materialise(prints.select(F.col("_fp").alias("fp")).distinct(), "simhash-vertices")
    # the few bytes of fingerprints would be read by a task or two, each of which makes 64 rows of one
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    heads = (_variant_rows(fps, distance).groupBy("place", "rest").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("head"))
             .where("c > 1"))
    heads = materialise(heads, "simhash-heads")  # a plain shuffle on both sides lets Spark split a hot bucket
    near_head = (F.col("fp") != F.col("head")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= distance)
    # the head itself and strangers that meet in a bucket of two leave no row of the join
    on = (F.col("v.place") == F.col("h.place")) & (F.col("v.rest") == F.col("h.rest")) & (near_head | (F.col("c") > 2))
    # Spark takes the 64 rows of a fingerprint for one and would broadcast them: a merge join, which it can also split
    variants = _variant_rows(fps, distance).hint("merge")
    met = variants.alias("v").join(heads.alias("h"), on).select("v.place", "v.rest", "fp", "c", "head")
    met = materialise(met, "simhash-members")
    linked = met.where(near_head)
    near = connected_components(linked.select(F.col("fp").alias("a"), F.col("head").alias("b")), "simhash-near")
    near = near.select(F.col("v").alias("fp"), "label")

    # the head is compared with all: a bucket of two has nothing more to tell
    open_ = met.where("c > 2").select("place", "rest", "fp").join(near, "fp", "left")
    open_ = materialise(open_.withColumn("label", F.coalesce("label", "fp")), "simhash-open")
    discard(met)
    far = connected_components(_across(open_, distance), "simhash-far").select(F.col("v").alias("label"), F.col("label").alias("whole"))
    return (fps.join(near, "fp", "left").withColumn("label", F.coalesce("label", "fp")).join(far, "label", "left")
            .select("fp", F.coalesce("whole", "label").alias("label")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                    distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """One row per input row: _rid, _id, fingerprint (16 hex digits), component_id (the component's least id), _label."""
    prints = materialise(fingerprints(docs, id_col, text_col, k, seed), "simhash-prints")
    least = prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("least"))
    labelled = materialise(components(prints, distance).join(least, "fp"), "simhash-labels")
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = materialise(labelled.join(names, "label").select(F.col("fp").alias("_fp"), F.col("label").alias("_label"), "component_id"),
                        "simhash-components")
    return prints.join(of_fp, "_fp").select("_rid", "_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                                            "component_id", "_label")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component (least id, null last, then scan order), with the input's columns."""
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_rid").alias("r"))
    found = near_duplicates(docs, id_col, text_col, **how).select("_rid", "_label", order.alias("o"))
    found = materialise(found, "simhash-rows")
    heads = materialise(found.groupBy("_label").agg(F.min("o").alias("first")), "simhash-first")
    drop = found.join(heads, "_label").where("_rid <> first.r").select(F.col("_rid").alias("__llm_rid"))
    return docs.withColumn("__llm_rid", row_id(docs)).join(drop, "__llm_rid", "left_anti").drop("__llm_rid")
