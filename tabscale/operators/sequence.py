"""Lags, rolling frames and neighbour differences over one long ordered series.

A window ordered over a whole table would run in one task. Instead rows get
a dense position (``order.row_index``), are cut into buckets of ``bucket_rows``
positions, and every bucket also receives a copy of the last ``halo`` rows of
the bucket before it. Windows are then partitioned by (series keys, bucket),
exact for the bucket's own rows, and the halo copies are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import row_index


def sequential(df: DataFrame, order_by, exprs, halo: int, by=(), bucket_rows: int = 1_000_000,
               idx: str = "_idx", keep_index: bool = False) -> DataFrame:
    """Add window columns ``exprs`` ({name: fn(window) -> Column}) over row order.

    ``fn`` receives the window spec (partitioned by series + bucket, ordered by
    position) and must only look back at most ``halo`` rows.
    """
    by = list(by)
    x = row_index(df, order_by, by=by, name=idx)
    b = F.floor(F.col(idx) / bucket_rows)
    own = x.withColumn("_bucket", b).withColumn("_halo", F.lit(False))
    if halo > 0:
        tail = (x.filter((F.col(idx) % bucket_rows) >= bucket_rows - halo)
                .withColumn("_bucket", b + 1).withColumn("_halo", F.lit(True)))
        own = own.unionByName(tail)
    w = Window.partitionBy(*by, "_bucket").orderBy(idx)
    own = own.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    out = own.filter(~F.col("_halo")).drop("_bucket", "_halo")
    return out if keep_index else out.drop(idx)
