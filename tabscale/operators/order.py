"""Order-dependent helpers that never run an unpartitioned window.

``Window.orderBy`` without ``partitionBy`` moves every row to one task. The
helpers here range-partition on the order keys instead, work inside each
partition, and stitch partitions together with a small per-(partition,
group) offset table (one row per partition and group, never per input row).
Data is checkpointed into the cluster's ``spark.checkpoint.dir`` between the
counting and the stitching pass, so a lost executor cannot recompute a
different partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import join_null_safe

_LOW33 = (1 << 33) - 1


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _small(df: DataFrame, rows: int, bytes_per_row: int = 64, limit: int = 32 << 20) -> DataFrame:
    """Broadcast a side only when its measured row count proves it small."""
    return F.broadcast(df) if rows * bytes_per_row <= limit else df


def _sorted_runs(df: DataFrame, by, order_by, num_partitions=None, checkpoint=True):
    keys = _cols(list(by) + list(order_by))
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
         .withColumn("_mid", F.monotonically_increasing_id()))
    return s.checkpoint() if checkpoint else s


def row_index(df: DataFrame, order_by, by=(), name: str = "idx", num_partitions=None,
              checkpoint: bool = True) -> DataFrame:
    """Dense 0-based position in ``order_by`` order (within ``by`` groups).

    Order keys should be unique (add an id as last key); ties otherwise get an
    arbitrary but consistent order. All work is JVM-side: range partition,
    ``monotonically_increasing_id`` for the in-partition position, and a
    per-(partition, group) count table for the offsets.
    """
    by = list(by)
    s = _sorted_runs(df, by, order_by, num_partitions, checkpoint)
    s = s.withColumn("_ri_pid", F.shiftright(F.col("_mid"), 33)).withColumn(
        "_ri_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    summ = s.groupBy("_ri_pid", *by).agg(F.count(F.lit(1)).alias("_ri_cnt"), F.min("_ri_pos").alias("_ri_first"))
    w = Window.partitionBy(*by).orderBy("_ri_pid").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_ri_off", F.coalesce(F.sum("_ri_cnt").over(w), F.lit(0))).drop("_ri_cnt")
    if checkpoint:
        summ = summ.checkpoint()
    n = summ.count()
    out = join_null_safe(s, _small(summ, n), ["_ri_pid", *by])
    return out.withColumn(name, F.col("_ri_off") + F.col("_ri_pos") - F.col("_ri_first")).drop(
        "_mid", "_ri_pid", "_ri_pos", "_ri_first", "_ri_off")


def prefix_sum(df: DataFrame, order_by, weight: str, by=(), name: str = "cum",
               num_partitions=None, checkpoint: bool = True, op: str = "sum") -> DataFrame:
    """Inclusive running sum (``op="max"``: running maximum) of ``weight`` in
    ``order_by`` order (within ``by`` groups).

    Local running sums are computed per range partition with pandas (Arrow
    batches); per-(partition, group) totals then give each run its offset.
    Meant for pre-aggregated inputs (distinct values with counts).
    """
    by = list(by)
    keys = [k for k in list(by) + list(order_by)]
    s = _sorted_runs(df, by, order_by, num_partitions, checkpoint=False)
    schema = T.StructType(s.schema.fields + [T.StructField("_pid", T.LongType()),
                                             T.StructField("_loc", T.DoubleType())])

    def local(it):
        carry = (None, None)  # key and last value of the group that the batch before ended in
        for pdf in it:
            if pdf.empty:
                continue
            pid = (pdf["_mid"].to_numpy() >> 33).astype("int64")
            fill = 0.0 if op == "sum" else -np.inf
            w = pdf[weight].astype("float64").fillna(fill).to_numpy()
            if by:
                grp = pd.Series(w, index=pdf.index).groupby([pdf[c] for c in by], sort=False, dropna=False)
                loc = (grp.cumsum() if op == "sum" else grp.cummax()).to_numpy()
                # rows are sorted by group: only the first group can go on from the batch before
                ends = [tuple(None if pd.isna(v) else v for v in pdf[by].iloc[i].tolist()) for i in (0, -1)]
                if carry[0] == ends[0]:
                    same = np.ones(len(pdf), bool)
                    for c, v in zip(by, ends[0]):
                        same &= (pdf[c].isna() if v is None else pdf[c] == v).to_numpy()
                    loc[same] = loc[same] + carry[1] if op == "sum" else np.maximum(loc[same], carry[1])
                carry = (ends[1], loc[-1])
            else:
                before = fill if carry[1] is None else carry[1]
                loc = np.cumsum(w) + before if op == "sum" else np.maximum(np.maximum.accumulate(w), before)
                carry = (None, loc[-1])
            pdf = pdf.assign(_pid=pid, _loc=loc)
            yield pdf

    loc = s.mapInPandas(local, schema)
    if checkpoint:
        loc = loc.checkpoint()
    # the run's last local value is its total (sum) or its maximum (max)
    summ = loc.groupBy("_pid", *by).agg(F.max_by("_loc", "_mid").alias("_tot"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry_expr = F.sum("_tot").over(w) if op == "sum" else F.max("_tot").over(w)
    summ = summ.withColumn("_off", carry_expr).drop("_tot")
    if checkpoint:
        summ = summ.checkpoint()
    n = summ.count()
    out = join_null_safe(loc, _small(summ, n), ["_pid", *by])
    val = (F.coalesce(F.col("_off"), F.lit(0.0)) + F.col("_loc") if op == "sum"
           else F.greatest(F.col("_off"), F.col("_loc")))
    return out.withColumn(name, val).drop("_mid", "_pid", "_loc", "_off")


def midrank(df: DataFrame, value: str, by=(), name: str = "rank") -> DataFrame:
    """Average 1-based rank of ``value`` with ties (nulls excluded), per ``by`` group.

    Distinct values are counted first (map-side combined), ranks come from a
    prefix sum over the distinct values, and are joined back on (by, value).
    Returns the input rows with ``name`` added.
    """
    by = list(by)
    x = df.filter(F.col(value).isNotNull())
    cnt = x.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_t"))
    cum = prefix_sum(cnt, [value], "_t", by=by, name="_cum")
    ranks = cum.select(*by, value, (F.col("_cum") - F.col("_t") + (F.col("_t") + 1) / 2.0).alias(name))
    return join_null_safe(x, ranks, [*by, value])


def value_ranks(df: DataFrame, value: str, by=(), weight_cols=()) -> DataFrame:
    """Distinct values with their tie count ``_t``, rows before ``_before`` and mid-rank.

    ``weight_cols`` are per-row 0/1 indicator columns summed per distinct value
    (e.g. arm membership) so rank sums per arm need no join back to rows.
    """
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("_t")] + [F.sum(F.col(c)).alias(c) for c in weight_cols]
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)
    cum = prefix_sum(cnt, [value], "_t", by=by, name="_cum")
    return cum.withColumn("_before", F.col("_cum") - F.col("_t")).withColumn(
        "_midrank", F.col("_before") + (F.col("_t") + 1) / 2.0)


def nearest_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None,
                 by=(), num_partitions=None) -> DataFrame:
    """For every left row, the right value nearest to ``left[on]`` (with replacement).

    An as-of join both ways: left and right are unioned, range-partitioned on
    (by, value) and streamed in order through Arrow batches; the previous and
    next right value of each left row come from the same partition or, at
    partition edges, from a small per-(partition, group) carry table. One pass
    up the sorted rows carries the value before, one down the value after; no
    row is held back. Distance ties go to the smaller right value. Output: left columns + ``nearest`` + ``distance``.
    """
    right_on = right_on or on
    by = list(by)
    lcols = left.columns
    l = left.select(*[F.col(c) for c in lcols], F.col(on).cast("double").alias("_x"),
                    F.lit(None).cast("double").alias("_r"), F.lit(0).alias("_side"))
    r_sel = [F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols]
    r = right.select(*r_sel, F.col(right_on).cast("double").alias("_x"),
                     F.col(right_on).cast("double").alias("_r"), F.lit(1).alias("_side"))
    u = l.unionByName(r).filter(F.col("_x").isNotNull())
    # right rows sort before left rows at equal values so an exact match is "previous"
    s0 = _sorted_runs(u, by, ["_x", F.col("_side").desc()], num_partitions, checkpoint=True)

    def seen(src, name, rights):
        """Adds the last right value met before each row, in the order of the partition's rows."""
        def run(it):
            last = (None, np.nan)       # the group that the batch before ended in and its last right value
            for pdf in it:
                if pdf.empty:
                    continue
                # null keys are a group of their own
                gk = pd.Series(list(zip(*[pdf[b].astype(object).where(pdf[b].notna(), "\0null") for b in by])) if by else [0] * len(pdf),
                               index=pdf.index)
                got = pdf["_r"].groupby(gk).ffill()
                open_ = got.isna() & (gk == last[0])
                got[open_] = last[1]
                last = (gk.iloc[-1], got.iloc[-1])
                yield pdf.assign(**{name: got}) if rights else pdf.assign(**{name: got})[pdf["_side"] == 0]
        return src.mapInPandas(run, T.StructType(src.schema.fields + [T.StructField(name, T.DoubleType())]))

    # up, then down the same partitions: Spark sorts (and spills), Python holds a batch and one value
    s = seen(s0, "_prev", True).sortWithinPartitions(F.desc("_mid"))
    s = seen(s, "_next", False).withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    src_r = s0.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    summ = src_r.groupBy("_pid", *by).agg(F.min("_r").alias("_mn"), F.max("_r").alias("_mx"))
    w_before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    w_after = Window.partitionBy(*by).orderBy("_pid").rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select("_pid", *by, F.max("_mx").over(w_before).alias("_cprev"),
                        F.min("_mn").over(w_after).alias("_cnext")).checkpoint()
    n = carry.count()
    out = join_null_safe(s, _small(carry, n), ["_pid", *by], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_cprev"))
    nxt = F.coalesce(F.col("_next"), F.col("_cnext"))
    dp, dn = F.col("_x") - prev, nxt - F.col("_x")
    nearest = (F.when(prev.isNull(), nxt).when(nxt.isNull(), prev)
               .when(dp <= dn, prev).otherwise(nxt))
    found = out.select(*[F.col(c) for c in lcols], nearest.alias("nearest"), F.abs(F.col("_x") - nearest).alias("distance"))
    # a left row without a value has no nearest one but stays
    none = F.lit(None).cast("double")
    return found.unionByName(left.filter(F.col(on).cast("double").isNull()).select(
        *[F.col(c) for c in lcols], none.alias("nearest"), none.alias("distance")))


def sample_per_group(df: DataFrame, n: int, by=(), id_col: str = "id", seed: int = 42,
                     name: str = "_h") -> DataFrame:
    """Exactly min(n, group size) rows per group: the n smallest ``xxhash64(id, seed)``.

    A plain ``row_number`` per group sorts a hot group in one task. Instead a
    per-group hash threshold (from the group count) keeps about n + 10*sqrt(n)
    candidates with overwhelming probability; ranks are taken among those, and
    a group that came up short (checked) is redone without the threshold.
    """
    by = list(by)
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    x = df.withColumn(name, h)
    sizes = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    want = float(n) + 10.0 * float(n) ** 0.5 + 20.0
    # hashes are ~uniform on [-2^63, 2^63): keep h < -2^63 + frac * 2^64
    frac = F.least(F.lit(1.0), F.lit(want) / F.col("_size"))
    thr = F.when(frac >= 1.0, F.lit(None).cast("double")).otherwise(
        F.lit(-9.223372036854775808e18) + frac * F.lit(1.8446744073709552e19))
    sizes = sizes.withColumn("_thr", thr).checkpoint()
    ng = sizes.count()
    if by:
        cand = join_null_safe(x, _small(sizes, ng), by)
    else:
        one = sizes.collect()[0]
        cand = x.withColumn("_size", F.lit(one["_size"])).withColumn("_thr", F.lit(one["_thr"]).cast("double"))
    cand = cand.filter(F.col("_thr").isNull() | (F.col(name).cast("double") < F.col("_thr")))
    w = Window.partitionBy(*by).orderBy(name, id_col)
    picked = cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    picked = picked.checkpoint()
    got = picked.groupBy(*by).agg(F.count(F.lit(1)).alias("_got"))
    if by:
        short = join_null_safe(sizes, got, by, "left").filter(
            F.coalesce(F.col("_got"), F.lit(0)) < F.least(F.col("_size"), F.lit(n)))
        redo_needed = short.limit(1).count() > 0
    else:
        g = got.collect()
        redo_needed = (g[0]["_got"] if g else 0) < min(one["_size"], n)
        short = None
    if redo_needed:
        redo_keys = short.select(*by) if by else None
        redo = join_null_safe(x, redo_keys, by, "left_semi") if by else x
        w2 = Window.partitionBy(*by).orderBy(name, id_col)
        redo = redo.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n)
        keep = join_null_safe(picked, redo_keys, by, "left_anti") if by else picked.limit(0)
        picked = keep.drop("_size", "_thr").unionByName(redo)
    return picked.drop("_size", "_thr", "_rn")
