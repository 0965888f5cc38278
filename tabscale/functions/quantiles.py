"""Exact, linearly interpolated quantiles without gathering a column.

Spark's exact ``percentile`` keeps a value->count map of the whole column in
one final aggregation buffer, which does not survive 100 TB. Here:

1. one wide aggregate computes ``count`` and a ``percentile_approx`` bracket
   [a, b] around every requested rank (rank error <= n/accuracy, so a margin
   of a few 1/accuracy steps contains the true order statistics);
2. one wide aggregate counts the values below every bracket, and a filtered
   scan emits only the values inside one (about 0.1 % of the rows unless values
   repeat), counted by value with map-side combining;
3. a cumulative count over the few bracket values per (group, column, prob)
   picks the exact order statistics ranks floor(p(n-1)) and the next one, and
   interpolates like pandas / DuckDB ``quantile_cont`` / Spark ``percentile``.

If a bracket ever misses (checked), the pass is repeated with a wider margin.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import join_null_safe, q

# distinct bracket values one window task may sort; larger brackets use the
# distributed prefix sum
WINDOW_MAX_BRACKET = 2_000_000


def _pairs(cols, probs):
    return [(i, c, j, p) for i, c in enumerate(cols) for j, p in enumerate(probs)]


def exact_quantiles(df: DataFrame, cols, probs, by=(), accuracy: int = 10000,
                    margin: float = 3.0, approx: bool = False) -> DataFrame:
    """Long result (by..., column, prob, value); value null when the column is all-null."""
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)
    if not cols:
        raise ValueError("no columns")
    if approx:
        aggs = [F.percentile_approx(q(c).cast("double"), F.array(*[F.lit(p) for p in probs]), accuracy)
                .alias(f"_q{i}") for i, c in enumerate(cols)]
        wide = df.groupBy(*by).agg(*aggs)
        rows = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"),
                         F.col(f"_q{i}")[j].alias("value")) for i, c, j, p in _pairs(cols, probs)]
        return wide.select(*by, F.inline(F.array(*rows)))
    while True:
        res, ok = _exact_pass(df, cols, probs, by, accuracy, margin)
        if ok or margin >= accuracy:
            return res
        margin = min(margin * 16, float(accuracy))


def _bracket_rows(src, by, inside, items):
    """(by..., _k, _n, _v): one row per value inside a bracket; a row outside all of them is filtered before the explode."""
    hit = inside[0]
    for c in inside[1:]:
        hit = hit | c
    rows = src.filter(hit).select(*by, F.explode(F.filter(F.array(*items), lambda s: s.isNotNull())).alias("_s"))
    return rows.select(*by, "_s._k", "_s._n", "_s._v")


def _exact_pass(df, cols, probs, by, accuracy, margin, extra=(), local=False):
    pairs = _pairs(cols, probs)
    lo_p = [max(0.0, p - margin / accuracy) for p in probs]
    hi_p = [min(1.0, p + margin / accuracy) for p in probs]
    full = margin >= accuracy
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        aggs.append(F.count(x).alias(f"_n{i}"))
        if not full:
            aggs.append(F.percentile_approx(x, F.array(*[F.lit(p) for p in lo_p + hi_p]), accuracy)
                        .alias(f"_b{i}"))
    bounds = df.groupBy(*by).agg(*aggs, *extra)
    nprob = len(probs)

    def lo_b(i, j):
        return F.lit(None).cast("double") if full or lo_p[j] <= 0.0 else F.col(f"_b{i}")[j]

    def hi_b(i, j):
        return F.lit(None).cast("double") if full or hi_p[j] >= 1.0 else F.col(f"_b{i}")[nprob + j]

    if by:
        # one row per group; written out so a lost executor cannot recompute a
        # different (order-dependent) sketch halfway through the second scan
        bounds = bounds.checkpoint()
        st = bounds.agg(F.count(F.lit(1)).alias("g"),
                        F.greatest(*[F.max(f"_n{i}") for i in range(len(cols))], F.lit(0)).alias("m")).collect()[0]
        n_groups, max_n = int(st["g"]), int(st["m"] or 0)
        # ~ (2*#pairs doubles + keys) per group; broadcast only while provably small
        est = n_groups * (16 * len(pairs) + 64)
        b = F.broadcast(bounds) if est <= 64 << 20 else bounds
        src = join_null_safe(df, b, by)
        lo = {(i, j): lo_b(i, j) for i, _, j, _ in pairs}
        hi = {(i, j): hi_b(i, j) for i, _, j, _ in pairs}
        n = {i: F.col(f"_n{i}") for i in range(len(cols))}
    else:
        row = bounds.collect()[0]

        def lit_or_none(v):
            return F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")
        lo, hi, n = {}, {}, {}
        for i, _, j, _ in pairs:
            bl = None if (full or lo_p[j] <= 0.0) else row[f"_b{i}"][j] if row[f"_b{i}"] else None
            bh = None if (full or hi_p[j] >= 1.0) else row[f"_b{i}"][nprob + j] if row[f"_b{i}"] else None
            lo[(i, j)], hi[(i, j)] = lit_or_none(bl), lit_or_none(bh)
        for i in range(len(cols)):
            n[i] = F.lit(int(row[f"_n{i}"])).cast("long")
        max_n = max(int(row[f"_n{i}"]) for i in range(len(cols)))
        src = df

    inside, items, below = [], [], []
    for k, (i, c, j, p) in enumerate(pairs):
        x = q(c).cast("double")
        under = x < lo[(i, j)]  # null where the bracket is open below
        keep = x.isNotNull() & F.coalesce(x <= hi[(i, j)], F.lit(True)) & ~F.coalesce(under, F.lit(False))
        inside.append(keep)
        items.append(F.when(keep, F.struct(F.lit(k).alias("_k"), n[i].alias("_n"), x.alias("_v"))))
        below.append((F.count_if(under).alias(f"_u{k}"), F.max(n[i]).alias(f"_t{k}")))
    counted = _bracket_rows(src, by, inside, items).groupBy(*by, "_k", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    if not full:
        under = src.groupBy(*by).agg(*[e for pair in below for e in pair])
        under = under.select(*by, F.inline(F.array(*[
            F.struct(F.lit(k).alias("_k"), F.col(f"_t{k}").alias("_n"), F.lit(None).cast("double").alias("_v"),
                     F.col(f"_u{k}").alias("_c")) for k in range(len(pairs))])))
        counted = counted.unionByName(under.filter(F.col("_c") > 0))
    # a bracket spans ~ (2 margin + 2) n / accuracy ranks; while that is small, one
    # window task per (group, column, prob) sorts it; beyond, the running count
    # is a distributed prefix sum over range partitions of (group, prob, value)
    if max_n * (2.0 * margin + 2.0) / accuracy <= WINDOW_MAX_BRACKET:
        w = (Window.partitionBy(*by, "_k").orderBy(F.col("_v").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, 0))
        cum = counted.withColumn("_cum", F.sum("_c").over(w))
    else:
        from ..operators.order import prefix_sum
        cum = prefix_sum(counted, [F.col("_v").asc_nulls_first()], "_c", by=[*by, "_k"], name="_cum")
    kp = F.element_at(F.array(*[F.lit(p) for _, _, _, p in pairs]), F.col("_k") + 1)
    pos = kp * (F.col("_n") - 1)
    r_lo = F.floor(pos)
    r_hi = F.least(r_lo + 1, F.col("_n") - 1)
    res = (cum.withColumn("_pos", pos).groupBy(*by, "_k", "_n", "_pos").agg(
        F.min(F.when(F.col("_cum") > r_lo, F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > r_hi, F.col("_v"))).alias("_hi"),
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"),
    ))
    frac = F.col("_pos") - F.floor(F.col("_pos"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac
    ok_expr = (F.col("_n") == 0) | ((F.col("_below") <= F.floor(F.col("_pos"))) & F.col("_hi").isNotNull())
    names = F.element_at(F.array(*[F.lit(c) for _, c, _, _ in pairs]), F.col("_k") + 1)
    out = res.select(*by, names.alias("column"), kp.alias("prob"),
                     F.when(F.col("_n") > 0, value).alias("value"), ok_expr.alias("_ok"))
    if by:
        out = out.checkpoint()
        ok = out.filter(~F.col("_ok")).limit(1).count() == 0
        return out.drop("_ok"), ok
    rows = out.collect()
    ok = all(r["_ok"] for r in rows)
    # groups with no non-null value emit nothing above; add their null rows
    got = {(r["column"], r["prob"]) for r in rows}
    spark = df.sparkSession
    data = [(r["column"], float(r["prob"]), r["value"]) for r in rows]
    data += [(c, p, None) for _, c, _, p in pairs if (c, p) not in got]
    if local:
        return ({(c, p): v for c, p, v in data}, row), ok
    res_df = spark.createDataFrame(data, "column string, prob double, value double")
    return res_df, ok


def quantile_dict(df: DataFrame, cols, probs, accuracy: int = 10000, margin: float = 3.0,
                  extra=()):
    """Global quantiles as {(column, prob): value} (a few numbers on the driver).

    ``extra``: more aggregate expressions evaluated in the same first scan; when
    given, returns ``(quantiles, row)`` with the row holding their values.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        res = ({}, df.agg(*extra).collect()[0] if extra else None)
        return res if extra else {}
    while True:
        res, ok = _exact_pass(df, cols, probs, [], accuracy, margin, extra=list(extra), local=True)
        if ok or margin >= accuracy:
            return res if extra else res[0]
        margin = min(margin * 16, float(accuracy))
