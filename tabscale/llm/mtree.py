"""Exact top-k search by inner product with an M-tree of paged metric nodes.

Components become floor(256 x). With one more component that lifts every vector
to the same norm, the largest inner product is the smallest Euclidean distance,
so the triangle inequality holds. Routing objects are ``PIVOTS`` vectors chosen
by hash; every distinct vector goes to its nearest one and keeps its parent
distance. A routing object's subtree is cut into pages of about ``PAGE``
entries, dealt by hash. The search has two rounds of blocks and is not best-first: a
query first visits one page of its nearest routing object, which bounds its
k-th distance; then only the pages whose lower bound d(q, p) - radius is within
that bound, in no order and without lowering the bound on the way. There is one
level of routing objects and all pages of one share its radius, so they are
visited or left out together. In a page only entries whose stored parent distance passes |d(q, p) - d(x, p)| <= bound are computed.
Results are exact: bounds only skip entries that cannot enter the top k. Distances are float64 and the
bounds give way by their rounding error, which grows with the longest vector (``_slack``); scores are exact
integers, in float64 while the largest squared norm is below 2^53 and in int64 beyond. That norm must be
below 2^63 (an overflow is an error). A page is copied only to the blocks of queries that visit it.

Equal vectors are one entry with their k + 1 smallest ids, which no result of
k can exceed, and equal queries are searched once, so a vector that a third of
all rows share costs as much as any other.

Defined cases: null vectors, vectors with null or non-finite components and
null ids take no part; shorter vectors count as padded with zeros; ties go to
the smaller id; a repeated row is a candidate of its own (only one occurrence
of the query itself is excluded); fewer candidates than k give all of them; an
empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PIVOTS = 64
PAGE = 2048
QUERY_BLOCK = 4096


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id and the integer vector _v of the rows that take part."""
    v = F.col(vec_col)
    big = F.lit(float("inf"))

    def finite(x):
        d = x.cast("double")
        return F.coalesce(~F.isnan(d) & (F.abs(d) < big), F.lit(False))

    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("_v"))


def _matrix(values, offsets, dim: int) -> np.ndarray:
    n = len(offsets) - 1
    width = np.diff(offsets)
    if n and (width == dim).all():
        return values[offsets[0]:offsets[-1]].reshape(n, dim).astype(np.float64)
    out = np.zeros((n, dim))
    for i in range(n):
        out[i, :width[i]] = values[offsets[i]:offsets[i + 1]]
    return out


def _from_arrow(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return _matrix(np.asarray(col.values, np.int64) if len(col.values) else np.zeros(0, np.int64), np.asarray(col.offsets), dim)


def _from_pandas(col, dim: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((len(col), dim), kind)
    for i, x in enumerate(col):
        out[i, :len(x)] = x
    return out


def _lift(x: np.ndarray, top: float, query: bool = False) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
    return np.column_stack([x, last])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _slack(dim: int, top: float) -> float:
    """Largest rounding error that three distances between vectors of squared norm ``top`` can add up to."""
    return 3 * np.sqrt(8 * np.finfo(float).eps * (dim + 4) * top) + 1e-6


def _best(ids, dups, same, score, k):
    order = np.lexsort((dups, ids, -score))[:k]
    return ids[order], dups[order], same[order], score[order]


def search_page(x, parent, members, q, own_norm, dq, bound, top, k):
    """Best k (id, dup, same, score) of one query in a page sorted by parent distance."""
    lo = np.searchsorted(parent, dq - bound, side="left")
    hi = np.searchsorted(parent, dq + bound, side="right")
    if lo >= hi:
        return None
    score = x[lo:hi] @ q
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        use = np.flatnonzero(score >= floor)
    else:
        use = np.arange(len(score))
    near = use[score[use] == own_norm]
    same_entry = {int(u) for u in near if np.array_equal(x[lo + u], q)}
    ids, dups, same, vals = [], [], [], []
    for u in use:
        seen: dict[int, int] = {}
        for i in members[lo + u]:
            d = seen.get(i, 0)
            seen[i] = d + 1
            ids.append(i)
            dups.append(d)
            same.append(int(u) in same_entry)
            vals.append(score[u])
    return _best(np.array(ids, np.int64), np.array(dups, np.int64), np.array(same), np.array(vals), k)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col)
    need = k + 1  # the query itself may be among the best
    w = Window.partitionBy("_v").orderBy("_id")
    entries = (rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= need)
               .groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")))
    entries = materialise(entries, "mtree-entries")
    norm = F.aggregate("_v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    stats = entries.agg(F.max(F.size("_v")).alias("d"), F.max(norm).alias("m")).first()
    dim, top = max(stats["d"] or 0, 1), float(stats["m"] or 0)
    # |x y| and all its partial sums are at most the largest squared norm
    kind, slack = np.float64 if top < 2 ** 53 else np.int64, _slack(dim, top)
    # PIVOTS rows at most reach the driver
    seeds = entries.orderBy(F.xxhash64("_v"), "_v").limit(PIVOTS).select("_v").collect()
    pivots = _lift(_from_pandas([r["_v"] for r in seeds], dim), top) if seeds else np.zeros((1, dim + 1))

    def place(batches):
        for rb in batches:
            d = _distances(_lift(_from_arrow(rb.column(0), dim), top), pivots)
            near = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(near.astype(np.int32)),
                                              pa.array(d[np.arange(len(d)), near])], names=["_v", "_ids", "_p", "_d"])

    leaves = materialise(entries.mapInArrow(place, "_v array<long>, _ids array<long>, _p int, _d double"), "mtree-leaves")
    nodes = {r["_p"]: (r["r"], max(1, -(-r["n"] // PAGE)))
             for r in leaves.groupBy("_p").agg(F.max("_d").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([nodes.get(p, (-1.0, 0))[0] for p in range(len(pivots))])
    splits = np.array([nodes.get(p, (-1.0, 0))[1] for p in range(len(pivots))], np.int64)

    asked = rows.where(F.col("_id") % every == 0)
    queries = materialise(asked.select("_v").distinct().withColumn("_q", F.monotonically_increasing_id())
                          .select("_q", "_v"), "mtree-queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def pages(wanted):
        split_of = spark.createDataFrame([(p, int(s)) for p, s in enumerate(splits)], "_p int, _of long")  # PIVOTS rows
        dealt = leaves.join(F.broadcast(split_of), "_p").withColumn("_s", F.pmod(F.xxhash64("_v"), F.col("_of")))
        return dealt.join(wanted, ["_p", "_s"]).select("_p", "_s", "_b", "_v", "_ids", "_d")

    def visit(key, entry, query):
        if not len(entry) or not len(query):
            return pd.DataFrame(columns=["_q", "vec_id", "dup", "same", "score"])
        entry = entry.sort_values("_d", kind="stable")
        x = _from_pandas(entry["_v"], dim, kind)
        parent, members = entry["_d"].to_numpy(), entry["_ids"].to_list()
        qs = _from_pandas(query["_v"], dim, kind)
        dq = _distances(_lift(qs.astype(np.float64), top, query=True), pivots[[key[0]]])[:, 0]
        found = []
        for i, (qid, bound) in enumerate(zip(query["_q"], query["_bound"])):
            got = search_page(x, parent, members, qs[i], qs[i] @ qs[i], dq[i], bound, top, need)
            if got is not None:
                ids, dups, same, vals = got
                found.append(pd.DataFrame({"_q": qid, "vec_id": ids, "dup": dups, "same": same, "score": vals.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame(columns=["_q", "vec_id", "dup", "same", "score"])

    def search(routed, name):
        keys = ["_p", "_s", "_b"]
        routed = materialise(routed, name)
        return (pages(routed.select(*[F.col(c).alias(c) for c in keys]).distinct()).groupBy(*keys).cogroup(routed.groupBy(*keys))
                .applyInPandas(visit, "_q long, vec_id long, dup long, same boolean, score long"))

    def route(first: bool):
        def run(batches):
            for rb in batches:
                q = _from_arrow(rb.column(1), dim)
                d = _distances(_lift(q, top, query=True), pivots)
                d[:, radius < 0] = np.inf
                home = d.argmin(axis=1) if len(d) else np.zeros(0, int)
                own = np.asarray(rb.column(2), np.int64)
                if first:
                    reach = np.zeros(d.shape, bool)
                    reach[np.arange(len(d)), home] = True
                    bound = np.full(len(d), 1e300)
                else:
                    score = np.array([np.nan if s is None else s for s in rb.column(3).to_pylist()], np.float64)
                    bound = np.sqrt(np.maximum((q * q).sum(axis=1) + top - 2 * score, 0))
                    bound = np.where(np.isnan(score), 1e300, bound * (1 + 1e-9) + slack)
                    reach = d - radius[None, :] <= bound[:, None]
                out = []
                for i, p in zip(*np.nonzero(reach)):
                    mine = own[i] % max(1, splits[p])
                    for s in range(splits[p]):
                        # the second round skips the page that the first has read
                        if (s == mine) if first else not (p == home[i] and s == mine):
                            out.append((i, p, s, bound[i]))
                idx = np.array([o[0] for o in out], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).take(pa.array(idx)), rb.column(1).take(pa.array(idx)),
                     pa.array([int(o[1]) for o in out], pa.int32()), pa.array([int(o[2]) for o in out], pa.int64()),
                     pa.array(np.asarray(rb.column(0).take(pa.array(idx)), np.int64) % n_blocks, pa.int32()),
                     pa.array([float(o[3]) for o in out], pa.float64())], names=["_q", "_v", "_p", "_s", "_b", "_bound"])
        return run

    routed = "_q long, _v array<long>, _p int, _s long, _b int, _bound double"
    hashed = queries.select("_q", "_v", F.xxhash64("_v").alias("_h"))
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id", "dup")

    def best(found):
        return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= need)

    one = materialise(best(search(hashed.mapInArrow(route(True), routed), "mtree-route-first")), "mtree-first")
    bound = one.where(F.col("_n") == need).select("_q", F.col("score").alias("_kth"))
    two = search(hashed.join(bound, "_q", "left").select("_q", "_v", "_h", "_kth").mapInArrow(route(False), routed), "mtree-route-second")
    found = best(one.drop("_n").unionByName(two)).select("_q", "vec_id", "dup", "same", "score")

    ask = asked.select(F.monotonically_increasing_id().alias("_row"), F.col("_id").alias("query_id"), "_v")
    hits = ask.join(queries, "_v").select("_row", "query_id", "_q").join(found, "_q")
    hits = hits.where(~(F.col("same") & (F.col("vec_id") == F.col("query_id")) & (F.col("dup") == 0)))
    rank = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id", "dup")
    return (hits.withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
