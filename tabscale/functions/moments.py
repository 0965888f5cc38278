"""Sample-moment expressions with the small-sample corrections the analyses
report (pandas-style bias-corrected skew G1 and excess kurtosis G2).

Spark's ``skewness`` / ``kurtosis`` are population moments (g1, g2); the
corrections below only need ``count`` of the same column, so every statistic
stays one partial/final hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_g1(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness G1 = g1 * sqrt(n(n-1)) / (n-2); null if n < 3."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); null if n < 4."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def pairwise_corr(df, cols, means=None) -> dict:
    """Pairwise-complete Pearson r for every pair i < j as {(i, j): r or None}.

    Two scans whatever the number of columns: column means (skipped when given),
    then per partition the masked co-moment matrices of the mean-shifted values
    (counts, sums, sums of squares and cross products: four p x p matrix
    products per Arrow batch, plus per-pair masked min / max for the constant
    test), summed per pair by one aggregate. A constant side gives None, like
    a ``corr`` that is null for constants.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    cols = list(cols)
    p = len(cols)
    if p < 2:
        return {}
    names = [f"_pc{i}" for i in range(p)]
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)])
    if means is None:
        row = x.agg(*[F.avg(n).alias(n) for n in names]).collect()[0]
        means = [row[n] for n in names]
    mu = np.array([0.0 if m is None else float(m) for m in means])
    iu, ju = np.triu_indices(p, k=1)
    schema = T.StructType([T.StructField(f, T.IntegerType()) for f in ("i", "j")] +
                          [T.StructField(f, T.DoubleType()) for f in ("n", "sx", "sy", "sxx", "syy", "sxy",
                                                                      "xmin", "xmax", "ymin", "ymax")])

    def part(it):
        n = np.zeros((p, p)); sx = np.zeros((p, p)); sxx = np.zeros((p, p)); sxy = np.zeros((p, p))
        mn = np.full((p, p), np.inf); mx = np.full((p, p), -np.inf)
        seen = False
        for pdf in it:
            if pdf.empty:
                continue
            seen = True
            v = pdf[names].to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(v)
            mf = m.astype("float64")
            d = np.where(m, v - mu, 0.0)
            n += mf.T @ mf            # n[i, j]   = rows with both present
            sx += d.T @ mf            # sx[i, j]  = sum of x_i over those rows
            sxx += (d * d).T @ mf     # sxx[i, j] = sum of x_i^2 over those rows
            sxy += d.T @ d            # sxy[i, j] = sum of x_i x_j over those rows
            for j in range(p):
                both = m & m[:, [j]]
                mn[:, j] = np.minimum(mn[:, j], np.where(both, v, np.inf).min(axis=0))
                mx[:, j] = np.maximum(mx[:, j], np.where(both, v, -np.inf).max(axis=0))
        if seen:
            # (i, j) holds x = column i, y = column j; column j's sums over the same rows sit at [j, i]
            yield pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "n": n[iu, ju],
                                "sx": sx[iu, ju], "sy": sx[ju, iu], "sxx": sxx[iu, ju], "syy": sxx[ju, iu],
                                "sxy": sxy[iu, ju], "xmin": mn[iu, ju], "xmax": mx[iu, ju],
                                "ymin": mn[ju, iu], "ymax": mx[ju, iu]})

    agg = x.mapInPandas(part, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"),
        F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))
    out = {}
    for r in agg.collect():
        k, val = (int(r["i"]), int(r["j"])), None
        if r["n"] and r["xmax"] > r["xmin"] and r["ymax"] > r["ymin"]:
            nn = r["n"]
            cxy = r["sxy"] - r["sx"] * r["sy"] / nn
            vx = r["sxx"] - r["sx"] * r["sx"] / nn
            vy = r["syy"] - r["sy"] * r["sy"] / nn
            if vx > 0 and vy > 0:
                val = max(-1.0, min(1.0, cxy / (vx * vy) ** 0.5))
        out[k] = val
    for i, j in zip(iu, ju):
        out.setdefault((int(i), int(j)), None)
    return out
