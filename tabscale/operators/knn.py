"""KNN imputation (k nearest donors, uniform mean, nan-Euclidean distance).

Exact without an all-pairs join: candidates come from a grid band join on
up to two always-present coordinates. A donor outside the 3x3 neighbourhood
of cell size R differs by more than R in a shared coordinate, and the
nan-Euclidean distance sqrt(p/m * sum of squares over the m shared
coordinates) is at least that difference, so a recipient whose k-th
candidate distance is <= R has its exact answer. Every recipient carries its
own grid level (cell = r0 * 2^level): an unresolved one moves to the level
whose cell covers its own k-th candidate distance (an upper bound on the
true one), so it is resolved in the next round without widening the search
of the others; with too few candidates it moves up. The top level (cell
spanning the data) is exhaustive. Distance ties go to the smaller donor id.

Cells that hold many donors are halved, again and again where needed, from
grouped counts: a recipient in one starts at the level (below 0) at which its
own cell holds at most ``CELL_DONORS`` times k donors, so its candidates stay
near that number wherever the donors crowd. The few recipients are copied to
their nine cells; every donor is placed once per level in use.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q


CELL_DONORS = 16  # a cell with more donors than this times k is halved


def _cells(grid, origin, r0: float, base: float):
    """Cell numbers of the grid coordinates at the row's ``_lvl``."""
    size = F.lit(r0) * F.pow(F.lit(base), F.col("_lvl"))
    return [F.floor((q(g) - F.lit(origin[g])) / size).cast("long").alias(f"_c{i}") for i, g in enumerate(grid)]


def _start_levels(rec: DataFrame, don: DataFrame, grid, origin, r0, base, lowest: int, limit: int) -> DataFrame:
    """``rec`` with its first ``_lvl``: 0, or the level at which its cell holds at most ``limit`` donors.

    Each round counts the donors of the cells that were too full one level higher; a cell whose
    donors share all grid coordinates cannot be halved and stays."""
    keys = [f"_c{i}" for i in range(len(grid))]
    deep = rec.withColumn("_lvl", F.lit(0))
    out, lvl, don = [], 0, don.select(*[q(g) for g in grid])
    while True:
        placed = don.withColumn("_lvl", F.lit(lvl))
        placed = placed.select(*[q(g) for g in grid], *_cells(grid, origin, r0, base))
        wide = F.lit(False)
        for g in grid:
            wide = wide | (F.min(q(g)) < F.max(q(g)))
        full = (placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), wide.alias("_wide"))
                .filter((F.col("_n") > limit) & F.col("_wide")).select(*keys).checkpoint())
        if lvl <= lowest or full.limit(1).count() == 0:
            out.append(deep)
            break
        here = deep.select("*", *_cells(grid, origin, r0, base))
        out.append(here.join(full, keys, "left_anti").drop(*keys))
        deep = here.join(full, keys, "left_semi").drop(*keys).withColumn("_lvl", F.lit(lvl - 1)).checkpoint()
        if deep.limit(1).count() == 0:
            break
        don = placed.join(full, keys, "left_semi").select(*[q(g) for g in grid]).checkpoint()
        lvl -= 1
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.checkpoint()


def _dist(cols, r, d):
    p = len(cols)
    sq = [F.when(F.col(f"{r}.{c}").isNotNull() & F.col(f"{d}.{c}").isNotNull(),
                 F.pow(F.col(f"{r}.{c}") - F.col(f"{d}.{c}"), 2)).otherwise(0.0) for c in cols]
    m = [F.when(F.col(f"{r}.{c}").isNotNull() & F.col(f"{d}.{c}").isNotNull(), 1).otherwise(0) for c in cols]
    s2 = sq[0]
    for e in sq[1:]:
        s2 = s2 + e
    mm = m[0]
    for e in m[1:]:
        mm = mm + e
    return F.when(mm > 0, F.sqrt(F.lit(float(p)) / mm * s2))


def knn_impute(df: DataFrame, cols, id_col: str, k: int = 5, grid=None, start_radius=None,
               all_numeric: bool = False, level_base: float = 2.0) -> DataFrame:
    """Fill nulls of ``cols`` (numeric) from the k nearest donors over all numeric columns.

    ``all_numeric=True`` fills every numeric column with nulls (the reference's side effect).
    Rows are identified by ``id_col`` (must be unique).
    """
    num = numeric_columns(df)
    feats = [c for c in num if c != id_col] + ([id_col] if id_col in num else [])
    targets = [c for c in (num if all_numeric else cols) if c in num]
    if not targets:
        return df
    base = df.select(q(id_col).alias("_id"), *[q(c).cast("double").alias(c) for c in feats])
    # grid coordinates: up to two feature columns with no nulls
    nn = base.agg(*[F.count_if(q(c).isNull()).alias(c) for c in feats],
                  *[F.min(q(c)).alias(f"_mn_{c}") for c in feats],
                  *[F.max(q(c)).alias(f"_mx_{c}") for c in feats],
                  *[F.avg(q(c)).alias(f"_avg_{c}") for c in targets]).collect()[0]
    rng_ = {c: (nn[f"_mx_{c}"] - nn[f"_mn_{c}"]) if nn[f"_mx_{c}"] is not None else 0.0 for c in feats}
    if grid is None:
        # widest null-free coordinates: they give the tightest lower bound on the distance
        grid = sorted([c for c in feats if nn[c] == 0 and rng_[c] > 0], key=lambda c: -rng_[c])[:2]
    if not grid:
        raise ValueError("KNN imputation needs one numeric column without nulls (e.g. a numeric id)")
    span = max([rng_[c] for c in grid] + [1.0])
    origin = {c: nn[f"_mn_{c}"] for c in grid}
    filled = {}
    for t in targets:
        rec = base.filter(q(t).isNull())
        don = base.filter(q(t).isNotNull())
        n_don = don.count()
        if rec.limit(1).count() == 0:
            continue
        if id_col not in feats:
            # donors with the same feature vector are interchangeable (same distance to every
            # recipient, ties to the smaller id): only the k smallest ids of a vector can be
            # chosen, so a heavily repeated vector cannot flood its grid cell. row_number <= k
            # is limited map-side (WindowGroupLimit) before the shuffle.
            wv = Window.partitionBy(*[q(c) for c in feats]).orderBy("_id")
            don = don.withColumn("_vr", F.row_number().over(wv)).filter(F.col("_vr") <= k).drop("_vr").checkpoint()
        if n_don == 0:
            filled[t] = rec.select("_id", F.lit(nn[f"_avg_{t}"]).alias(t))
            continue
        # base radius so that a cell of the widest coordinate holds ~ 4k donors on average
        r0 = start_radius or span * 4.0 * k / n_don
        top_lvl = max(0, math.ceil(math.log(span / r0, level_base))) + 1   # cell >= span: exhaustive
        need = min(k, n_don)
        results = []
        # cell numbers stay below 2^50, where doubles are exact
        lowest = -min(30, max(0, math.floor((50 - math.log2(max(span / r0, 1.0))) / math.log2(level_base))))
        todo = _start_levels(rec.select("_id", *feats), don, grid, origin, r0, level_base, lowest, CELL_DONORS * k)
        while True:
            levels = sorted(r["_lvl"] for r in todo.select("_lvl").distinct().collect())
            # donors are placed on the grid of every level some recipient needs this round
            dd = don.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in levels])))
            dd = dd.select("*", *_cells(grid, origin, r0, level_base)).alias("d")
            # recipients go to the 3x3 cells around them
            rr = todo.select("*", *_cells(grid, origin, r0, level_base))
            for i in range(len(grid)):
                around = F.array(*[F.col(f"_c{i}") + o for o in (-1, 0, 1)])
                rr = rr.withColumn(f"_c{i}", F.explode(around))
            rr = rr.alias("r")
            cond = [F.col("r._lvl") == F.col("d._lvl")] + \
                [F.col(f"r._c{i}") == F.col(f"d._c{i}") for i in range(len(grid))]
            cand = rr.join(dd, cond, "inner").select(
                F.col("r._id").alias("_rid"), F.col("r._lvl").alias("_lvl"), F.col("d._id").alias("_did"),
                F.col(f"d.{t}").alias("_v"), _dist(feats, "r", "d").alias("_dist"))
            cand = cand.filter(F.col("_dist").isNotNull())
            # top-k per recipient; Spark limits each recipient to k rows per map partition
            # (WindowGroupLimit) before the shuffle
            w = Window.partitionBy("_rid").orderBy("_dist", "_did")
            top = cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
            agg = top.groupBy("_rid", "_lvl").agg(F.avg("_v").alias(t), F.max("_dist").alias("_kd"),
                                                  F.count(F.lit(1)).alias("_n")).checkpoint()
            # the k nearest lie within the k-th candidate distance, hence in the 3x3 cells
            # of any level whose cell is at least that distance
            done = agg.filter(((F.col("_kd") <= F.lit(r0) * F.pow(F.lit(level_base), F.col("_lvl"))) &
                               (F.col("_n") >= need)) | (F.col("_lvl") >= top_lvl))
            results.append(done.select(F.col("_rid").alias("_id"), t))
            if top_lvl in levels:
                # exhaustive level: recipients sharing no coordinate with any donor get the mean
                rest = todo.filter(F.col("_lvl") >= top_lvl).join(
                    agg.select(F.col("_rid").alias("_id")), "_id", "left_anti")
                results.append(rest.select("_id", F.lit(nn[f"_avg_{t}"]).alias(t)))
            left = todo.filter(F.col("_lvl") < top_lvl).join(done.select(F.col("_rid").alias("_id")),
                                                              "_id", "left_anti")
            # next level per recipient: enough to cover its own k-th candidate distance
            # (resolves it next round), else wider: by one level where donors crowd, by two elsewhere
            kd = agg.select(F.col("_rid").alias("_id"), "_kd", "_n")
            nxt = F.when((F.col("_n") >= need) & F.col("_kd").isNotNull(),
                         F.greatest(F.col("_lvl") + 1,
                                    F.ceil(F.log(float(level_base), F.col("_kd") / F.lit(r0))).cast("int"))
                         ).otherwise(F.col("_lvl") + F.when(F.col("_lvl") < 0, 1).otherwise(2))
            todo = (left.join(kd, "_id", "left").withColumn("_lvl", F.least(nxt, F.lit(top_lvl)).cast("int"))
                    .drop("_kd", "_n").checkpoint())
            if todo.limit(1).count() == 0:
                break
        out = results[0]
        for r_ in results[1:]:
            out = out.unionByName(r_)
        filled[t] = out
    res = df
    for t, fills in filled.items():
        f2 = fills.withColumnRenamed(t, f"_fill_{t}")
        res = res.join(f2, res[id_col] == f2["_id"], "left").withColumn(
            t, F.coalesce(q(t).cast("double"), F.col(f"_fill_{t}"))).drop("_id", f"_fill_{t}")
    return res
