"""Prefix trie of conversations by a splitter skeleton.

A conversation is the sequence of its turns; a trie node is a distinct sequence
of first turns. Each turn becomes a 16-byte key of role and text, a conversation
the concatenation of its keys, so byte order is the order of sequences and a
node is a byte prefix. Texts are read once and only their lengths travel on.

1. Splitters are quantiles of a bounded sample of paths, cut to ``SPLIT_TURNS``
   turns: at most ``MAX_SHARDS`` x ``SPLIT_TURNS`` keys are broadcast. They deal
   the paths into shards that are contiguous in the order of paths.
2. A node with members in two shards is a prefix of a splitter between them (else
   all its members are on the same side of it), so every other node is finished
   by the one shard that holds it: a pass over the sorted shard with a stack of
   the open nodes, each closed when a path leaves it.
3. Nodes on the splitters' paths, the skeleton, give one partial aggregate a
   shard. Partials are summed by node, and each skeleton node adds its own share
   to all its prefixes, which are skeleton nodes too.

``ends_sha256`` of a node is a running hash over the sorted rows, so a path that
a third of all conversations share needs no list of them.

Defined cases: turns go by turn (null first), ties by key; null role or text is empty; rows without conv_id take no part; a conversation without turns
belongs to the root; an empty table gives no node; extra columns play no part.
A conversation's keys (20 bytes a turn, not its texts) must fit one row.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEY = 16                 # bytes of a turn's key
SHARD_ROWS = 256         # conversations a shard, while shards are fewer than MAX_SHARDS
MAX_SHARDS = 8_192
SPLIT_TURNS = 32         # turns of a splitter
SAMPLE = 8               # sampled paths per shard
_BLANK = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id long, depth long, parent_conv_id long, parent binary, own binary, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, bytes long, ends_sha256 string")


def paths(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """One row per conversation: _c, _path (keys of its turns), _bytes (UTF-8 bytes of each turn's text)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # the role's length keeps (role, text) apart from other splits of the same letters
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = convs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_c"),
        F.struct(F.col(turn_col).isNotNull().alias("s"), F.col(turn_col).alias("t"), key.alias("k"),
                 F.octet_length(text).alias("b")).alias("_t"))
    one = turns.groupBy("_c").agg(F.array_sort(F.collect_list("_t")).alias("_l"))
    hexed = F.array_join(F.transform("_l", lambda t: F.hex(t["k"])), "")
    return one.select("_c", F.unhex(hexed).alias("_path"), F.transform("_l", lambda t: t["b"].cast("int")).alias("_bytes"))


def branched(own: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations rebuilt on a shared start: the first h turns of conversation c - c % every, then the own
    turns after the first h, with h = crc32(c as text) % (most + 1)."""
    h = F.pmod(F.crc32(F.col("_c").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    own = own.select("_c", (F.col("_c") - F.col("_c") % every).alias("_on"), h.alias("_h"), "_path", "_bytes")
    starts = own.where("_c = _on").select("_on", F.expr(f"substring(_path, 1, {most * KEY})").alias("_p"),
                                          F.slice("_bytes", 1, most).alias("_b"))
    x = own.join(starts, "_on", "left")
    start = F.coalesce(F.expr(f"substring(_p, 1, _h * {KEY})"), F.expr("X''"))
    bytes_ = F.coalesce(F.expr("slice(_b, 1, _h)"), F.expr("cast(array() as array<int>)"))
    return x.select("_c", F.concat(start, F.expr(f"substring(_path, _h * {KEY} + 1)")).alias("_path"),
                    F.concat(bytes_, F.expr("slice(_bytes, _h + 1, size(_bytes))")).alias("_bytes"))


def _splitters(x: DataFrame, shard_rows: int) -> list[bytes]:
    """Quantiles of a sample of paths cut to SPLIT_TURNS turns; the sample is at most SAMPLE * MAX_SHARDS rows."""
    shards = min(MAX_SHARDS, -(-x.count() // shard_rows))
    if shards < 2:
        return []
    drawn = x.select(F.expr(f"substring(_path, 1, {SPLIT_TURNS * KEY})").alias("p"), F.xxhash64("_c").alias("h"))
    got = sorted(bytes(r["p"]) for r in drawn.orderBy("h", "p").limit(SAMPLE * shards).collect())
    return sorted({got[len(got) * i // shards] for i in range(1, shards)} - {b""})


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    n = min(len(a), len(b)) // KEY
    if a[:n * KEY] == b[:n * KEY]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid * KEY] == b[:mid * KEY] else (lo, mid)
    return lo


class _Open:
    """An open node of the pass over a sorted shard."""
    __slots__ = ("depth", "own", "first", "n", "children", "leaves", "saved", "bytes", "ends", "waiting", "skeleton")

    def __init__(self, depth, own, size, skeleton):
        self.depth, self.own, self.bytes, self.skeleton = depth, own, size, skeleton
        self.first, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = None, []


def _close(node: _Open, above: _Open | None, out: list) -> None:
    """Add a finished node to its parent. Rows wait at the parent until its least member is known."""
    for row in node.waiting:
        out.append((*row[:2], node.first, *row[3:]))
    digest = node.ends.hexdigest() if node.ends else None
    if node.skeleton:
        out.append((node.first, node.depth, None, None, node.own, node.n, node.children, node.leaves, node.saved, node.bytes, digest))
        if above is not None:
            above.n += node.n
            above.first = node.first if above.first is None else min(above.first, node.first)
        return
    leaves = node.leaves if node.children else 1
    saved = node.saved + (node.n - 1) * node.bytes
    row = (node.first, node.depth, None, None, None, node.n, node.children, leaves, saved, node.bytes, digest or _BLANK)
    if above.skeleton:
        out.append((*row[:3], above.own, *row[4:]))
    else:
        above.waiting.append(row)
    above.n += node.n
    above.first = node.first if above.first is None else min(above.first, node.first)
    above.children += 1
    above.leaves += leaves
    above.saved += saved


def _walk(batches, splitters: list[bytes]):
    """Rows of finished nodes and partial rows of skeleton nodes, from rows sorted by (_shard, _path, _c)."""
    cols = [c.split()[0] for c in _NODE.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _NODE.split(", ")])
    stack: list[_Open] = []
    out: list = []
    last, shard, sides = b"", None, ()

    def shrink(depth):
        while len(stack) > depth:
            node = stack.pop()
            _close(node, stack[-1] if stack else None, out)

    def table():
        got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.types[i]) for i in range(len(cols))], schema=schema)
        out.clear()
        return got

    for rb in batches:
        ids, owner, sizes = rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(3)
        for i, (c, s) in enumerate(zip(ids, owner)):
            path = rb.column(2)[i].as_py()
            if s != shard:
                shrink(0)
                shard, last = s, None
                sides = splitters[max(s - 1, 0):s + 1]
            if not stack:
                stack.append(_Open(0, b"", 0, True))
            if path != last:
                shrink(1 + (_shared(path, last) if last is not None else 0))
                if len(path) > KEY * (len(stack) - 1):
                    both = max((_shared(path, x) for x in sides), default=0)
                    size = sizes[i].as_py()
                    for d in range(len(stack), len(path) // KEY + 1):
                        on = d <= both
                        stack.append(_Open(d, path[:d * KEY] if on else None, size[d - 1], on))
                last = path
            top = stack[-1]
            top.ends = top.ends or hashlib.sha256()
            top.ends.update(b",%d" % c if top.n else b"%d" % c)
            top.n += 1
            top.first = c if top.first is None else min(top.first, c)
            if len(out) >= 10_000:
                yield table()
    shrink(0)
    if out:
        yield table()


def trie(x: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of conversations (_c, _path, _bytes): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    x = materialise(x.select("_c", "_path", "_bytes"), "trie-paths")
    splitters = _splitters(x, shard_rows)

    def deal(batches):
        for rb in batches:
            got = [bisect.bisect_right(splitters, p.as_py()) for p in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(got, pa.int32()), rb.column(1), rb.column(2)],
                                             names=["_c", "_shard", "_path", "_bytes"])

    dealt = x.mapInArrow(deal, "_c long, _shard int, _path binary, _bytes array<int>")
    dealt = dealt.repartition("_shard").sortWithinPartitions("_shard", "_path", "_c")
    rows = materialise(dealt.mapInArrow(lambda b: _walk(b, splitters), _NODE), "trie-nodes")

    # the skeleton: at most a partial row a shard and node
    part = rows.where("own is not null").groupBy("own").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.max("bytes").alias("bytes"),
        F.max("ends_sha256").alias("ends"))
    part = materialise(part.withColumn("parent", F.when(F.col("depth") > 0, F.expr(f"substring(own, 1, length(own) - {KEY})"))),
                       "trie-skeleton")
    below = part.where("parent is not null").groupBy(F.col("parent").alias("own")).agg(F.count(F.lit(1)).alias("k"))
    part = part.join(below, "own", "left").withColumn("n_children", F.col("c") + F.coalesce("k", F.lit(0)))
    part = materialise(part, "trie-skeleton-children")
    share = part.select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("depth")), lambda d: d.cast("int"))).alias("d"), "own",
        (F.col("l") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("l"),
        (F.col("s") + (F.col("n_convs") - 1) * F.col("bytes")).alias("s"))
    total = (share.groupBy(F.expr(f"substring(own, 1, d * {KEY})").alias("own"))
             .agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens")))
    above = part.select(F.col("own").alias("parent"), F.col("conv_id").alias("p"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skeleton = (part.join(total, "own").join(above, "parent", "left").withColumn("parent_conv_id", F.col("p"))
                .withColumn("ends_sha256", F.coalesce("ends", F.lit(_BLANK))))
    done = rows.where("own is null")
    inner = done.where("parent is null")
    tops = done.where("parent is not null").drop("parent_conv_id").join(above, "parent").withColumn("parent_conv_id", F.col("p"))
    return inner.select(*names).unionByName(tops.select(*names)).unionByName(skeleton.select(*names))
