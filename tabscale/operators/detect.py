"""Type coercion and dataset detection (numeric / datetime strings, task
type, datetime column, monotonic order, frequency, outcome type)."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import categorical_columns, datetime_columns, numeric_columns, q, string_columns
from ..functions.quantiles import quantile_dict
from .sequence import sequential

# What counts as a plain number when a string column is tested
# (pandas ``to_numeric`` rejects forms such as '1d' that a Spark cast accepts).
NUMERIC_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Datetime layouts tried, in order, when parsing strings; a value is parsed
# only by the layouts whose shape it has.
DATETIME_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{1,6}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{1,6}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d\d-\d\d \d\d:\d\d$"),
    ("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$"),
    ("yyyy/MM/dd", r"^\d{4}/\d\d/\d\d$"),
    ("MM/dd/yyyy", r"^\d\d/\d\d/\d{4}$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$"),
    ("MM/dd/yyyy HH:mm:ss", r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d$"),
    ("MM/dd/yyyy HH:mm", r"^\d\d/\d\d/\d{4} \d\d:\d\d$"),
    ("dd-MMM-yyyy", r"^\d\d-[A-Za-z]{3}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
]

NUMERIC_SHARE = 0.8      # coerce a string column when > 80 % of rows parse as numbers
DATETIME_SHARE = 0.6     # share of the non-null values that must parse
CLASS_MAX_DISTINCT = 20  # numeric target with <= 20 distinct values -> classification


def parse_number(c):
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def parse_datetime(c):
    s = c.cast("string")
    parsed = F.coalesce(*[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f))) for f, shape in DATETIME_FORMATS])
    return F.when(s.rlike(r"^\d"), parsed).cast("timestamp_ntz")


def numeric_shares(df: DataFrame, cols=None) -> dict:
    """{column: parsed_non_null / n_rows} for string columns, one aggregate job."""
    cols = string_columns(df) if cols is None else list(cols)
    if not cols:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(parse_number(q(c))).alias(f"_p{i}") for i, c in enumerate(cols)]).collect()[0]
    n = row["_n"]
    return {c: (row[f"_p{i}"] / n if n else 0.0) for i, c in enumerate(cols)}


def coerce_numeric(df: DataFrame, cols=None, share: float = NUMERIC_SHARE) -> tuple[DataFrame, list[str]]:
    """Replace string columns that are numbers in > ``share`` of rows by doubles."""
    shares = numeric_shares(df, cols)
    chosen = [c for c, s in shares.items() if s > share]
    out = df.select(*[parse_number(q(c)).alias(c) if c in chosen else q(c) for c in df.columns])
    return out, chosen


def datetime_shares(df: DataFrame, cols) -> dict:
    """{column: parsed / non-null values} over all rows, one aggregate job for all columns."""
    cols = list(cols)
    if not cols:
        return {}
    row = df.agg(*[a for i, c in enumerate(cols) for a in (F.count(q(c)).alias(f"_n{i}"),
                                                           F.count(parse_datetime(q(c))).alias(f"_p{i}"))]).collect()[0]
    return {c: row[f"_p{i}"] / max(row[f"_n{i}"], 1) for i, c in enumerate(cols)}


def coerce_datetime(df: DataFrame, cols=None, order_by=None, share: float = DATETIME_SHARE):
    """Parse string columns whose values are datetimes in > ``share`` of the non-null rows; failures -> null.

    All rows decide, so neither their order (``order_by`` is not used any more) nor a prefix matters."""
    cols = string_columns(df) if cols is None else list(cols)
    chosen = [c for c, s in datetime_shares(df, cols).items() if s > share]
    out = df.select(*[parse_datetime(q(c)).alias(c) if c in chosen else q(c) for c in df.columns])
    return out, chosen


def coerce_types(df: DataFrame, order_by=None) -> DataFrame:
    """Numeric pass first, then the datetime sniff on what stayed a string."""
    out, num = coerce_numeric(df)
    rest = [c for c in string_columns(out) if c not in num]
    out, _ = coerce_datetime(out, rest, order_by)
    return out


def distinct_counts(df: DataFrame, cols, approx: bool = False) -> dict:
    """{column: distinct non-null count}. Exact path: unpivot to (column, value),
    de-duplicate with a partial/final hash aggregate, then count per column."""
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(q(c)).alias(f"_d{i}") for i, c in enumerate(cols)]).collect()[0]
        return {c: row[f"_d{i}"] for i, c in enumerate(cols)}
    items = [F.struct(F.lit(i).alias("k"), q(c).cast("string").alias("v")) for i, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*items))).filter(F.col("v").isNotNull())
    got = long.distinct().groupBy("k").count().collect()
    m = {r["k"]: r["count"] for r in got}
    return {c: int(m.get(i, 0)) for i, c in enumerate(cols)}


def distinct_up_to(df: DataFrame, cols, limit: int) -> dict:
    """{column: distinct non-null count, or limit + 1 where there are more}.

    Each partition keeps a set per column that stops growing at limit + 1, so at most that many values of a
    column leave it; the cells themselves are never shuffled."""
    cols = list(cols)
    if not cols:
        return {}

    def run(batches):
        seen: list[set] = [set() for _ in cols]
        for rb in batches:
            for s, col in zip(seen, rb.columns):
                if len(s) <= limit:
                    for v in pc.unique(col).drop_null().to_pylist():
                        s.add(v)
                        if len(s) > limit:
                            break
            if all(len(s) > limit for s in seen):
                break
        rows = [(k, v) for k, s in enumerate(seen) for v in s]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())],
                                         names=["k", "v"])
    few = df.select(*[q(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "k int, v string")
    got = {r["k"]: r["count"] for r in few.distinct().groupBy("k").count().collect()}
    return {c: int(min(got.get(i, 0), limit + 1)) for i, c in enumerate(cols)}


def infer_task_type(df: DataFrame, target: str) -> str:
    dt = df.schema[target].dataType
    if isinstance(dt, (T.StringType, T.BooleanType)):
        return "classification"
    n = distinct_up_to(df, [target], CLASS_MAX_DISTINCT)[target]
    return "classification" if n <= CLASS_MAX_DISTINCT else "regression"


def task_types(df: DataFrame) -> DataFrame:
    """(column, n_unique, task_type) for every column as a candidate target."""
    cols = df.columns
    d = distinct_counts(df, cols)
    rows = []
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.StringType, T.BooleanType)):
            t = "classification"
        else:
            t = "classification" if d[c] <= CLASS_MAX_DISTINCT else "regression"
        rows.append((c, int(d[c]), t))
    return df.sparkSession.createDataFrame(rows, "column string, n_unique long, task_type string")


def detect_datetime_col(df: DataFrame, share: float = NUMERIC_SHARE):
    """Most complete datetime column; if none, string columns parseable in > 80 % of rows.

    Returns (column or None, non-null count). Ties -> first in schema order.
    """
    cands = datetime_columns(df)
    if cands:
        exprs = {c: F.count(q(c)) for c in cands}
    else:
        scols = string_columns(df)
        if not scols:
            return None, 0
        row = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count(parse_datetime(q(c))).alias(f"_p{i}") for i, c in enumerate(scols)]).collect()[0]
        cands = [c for i, c in enumerate(scols) if row["_n"] and row[f"_p{i}"] / row["_n"] > share]
        if not cands:
            return None, 0
        exprs = {c: F.count(parse_datetime(q(c))) for c in cands}
    row = df.agg(*[e.alias(f"_c{i}") for i, e in enumerate(exprs.values())]).collect()[0]
    counts = [(c, row[f"_c{i}"]) for i, c in enumerate(exprs)]
    best = max(counts, key=lambda t: t[1])  # max keeps the first on ties
    return best


def monotonic(df: DataFrame, ts: str, order_by, by=()) -> dict:
    """Non-strictly increasing / decreasing in row order; any null -> neither."""
    dtc = parse_datetime(q(ts)) if isinstance(df.schema[ts].dataType, T.StringType) else q(ts)
    keys = [k for k in [*order_by, *by] if isinstance(k, str)]
    x = df.select(*[q(k) for k in dict.fromkeys(keys)], dtc.alias("_t")) if len(keys) == len([*order_by, *by]) \
        else df.withColumn("_t", dtc)  # only the order keys travel with the timestamp
    s = sequential(x, order_by, {"_prev": lambda w: F.lag("_t", 1).over(w)}, halo=1, by=by)
    row = s.agg(
        F.coalesce(F.bool_and(F.col("_prev").isNull() | (F.col("_t") >= F.col("_prev"))), F.lit(True)).alias("inc"),
        F.coalesce(F.bool_and(F.col("_prev").isNull() | (F.col("_t") <= F.col("_prev"))), F.lit(True)).alias("dec"),
        F.count(F.lit(1)).alias("n"), F.count("_t").alias("nn")).collect()[0]
    has_null = row["nn"] < row["n"]
    inc = bool(row["inc"]) and not has_null
    dec = bool(row["dec"]) and not has_null
    return {"increasing": inc, "decreasing": dec, "is_ts": inc or dec}


def _sorted_gaps(df: DataFrame, ts: str) -> DataFrame:
    """Gaps in seconds between consecutive non-null timestamps in time order."""
    x = df.select(q(ts).alias("_t")).filter(F.col("_t").isNotNull())
    s = sequential(x, ["_t"], {"_prev": lambda w: F.lag("_t", 1).over(w)}, halo=1)
    return s.filter(F.col("_prev").isNotNull()).select(
        (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp")))
        .cast("double").__truediv__(1e6).alias("gap"),
        F.col("_t"))


def infer_freq(df: DataFrame, ts: str):
    """Alias of a perfectly regular spacing (min, h, D, W, MS, ME, QS, YS), else None.

    Needs >= 3 timestamps. Only distinct gaps (a few numbers) reach the driver.
    """
    g = _sorted_gaps(df, ts)
    st = g.agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("mn"), F.max("gap").alias("mx"),
               F.bool_and((F.dayofmonth("_t") == 1) & (F.date_trunc("day", "_t") == F.col("_t"))).alias("ms"),
               F.bool_and((F.col("_t") == F.date_trunc("day", "_t")) &
                          (F.dayofmonth(F.date_add(F.col("_t").cast("date"), 1)) == 1)).alias("me"),
               F.min(F.month("_t")).alias("m0"), F.count_distinct(F.month("_t")).alias("nm")).collect()[0]
    if st["n"] is None or st["n"] < 2:
        return None
    return _freq_alias(st["mn"], st["mx"], st["ms"], st["me"])


def _freq_alias(mn, mx, ms, me):
    """Alias from the smallest / largest gap (seconds) and the month-start / month-end flags."""
    if mn == mx and mn > 0:
        sec = int(round(mn))
        for unit, name in ((604800, "W"), (86400, "D"), (3600, "h"), (60, "min"), (1, "s")):
            if sec % unit == 0:
                k = sec // unit
                return name if k == 1 else f"{k}{name}"
    # calendar frequencies: gaps of 28-31 days (month), 89-92 (quarter), 365-366 (year)
    days_lo, days_hi = mn / 86400.0, mx / 86400.0
    if ms or me:
        suffix = "S" if ms else "E"
        if 28 <= days_lo and days_hi <= 31:
            return "M" + suffix
        if 89 <= days_lo and days_hi <= 92:
            return "Q" + suffix
        if 365 <= days_lo and days_hi <= 366:
            return "Y" + suffix
    return None


# Median-gap buckets of the fallback frequency estimate.
FREQ_BUCKETS = [(3600, "T"), (86400, "H"), (86400 * 4, "D"), (86400 * 10, "W"),
                (86400 * 35, "M"), (86400 * 100, "Q")]


def estimate_freq(df: DataFrame, ts: str):
    """Bucket the exact median gap of the sorted timestamps (None if < 2 values)."""
    g = _sorted_gaps(df, ts)
    med = quantile_dict(g, ["gap"], [0.5]).get(("gap", 0.5))
    if med is None:
        return None, None
    for limit, name in FREQ_BUCKETS:
        if med < limit:
            return name, med
    return "A", med


@dataclass(frozen=True)
class TsInfo:
    is_ts: bool
    datetime_col: str | None
    freq: str | None
    n_periods: int
    notes: str


def ts_summary(df: DataFrame, order_by) -> TsInfo:
    col, _ = detect_datetime_col(df)
    if col is None:
        return TsInfo(False, None, None, 0, "no datetime column")
    # One ordered pass answers all three questions: a monotone series (no nulls)
    # has its sorted-time gaps equal to the row-order differences (negated when
    # decreasing), so the series is sorted once, not once per question.
    dtc = parse_datetime(q(col)) if isinstance(df.schema[col].dataType, T.StringType) else q(col)
    okeys = [k for k in order_by if isinstance(k, str)]
    x = df.select(*[q(k) for k in okeys], dtc.alias("_t"))
    s = sequential(x, order_by, {"_prev": lambda w: F.lag("_t", 1).over(w)}, halo=1)
    d = (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))) \
        .cast("double") / 1e6
    s = s.select("_t", d.alias("_d")).checkpoint()
    t = F.col("_t")
    st = s.agg(
        F.coalesce(F.bool_and(F.col("_d").isNull() | (F.col("_d") >= 0)), F.lit(True)).alias("inc"),
        F.coalesce(F.bool_and(F.col("_d").isNull() | (F.col("_d") <= 0)), F.lit(True)).alias("dec"),
        F.count(F.lit(1)).alias("n"), F.count("_t").alias("nn"),
        F.count("_d").alias("ng"), F.min("_d").alias("dmin"), F.max("_d").alias("dmax"),
        F.bool_and((F.dayofmonth(t) == 1) & (F.date_trunc("day", t) == t)).alias("ms"),
        F.bool_and((t == F.date_trunc("day", t)) & (F.dayofmonth(F.date_add(t.cast("date"), 1)) == 1)).alias("me"),
    ).collect()[0]
    has_null = st["nn"] < st["n"]
    inc, dec = bool(st["inc"]) and not has_null, bool(st["dec"]) and not has_null
    if not (inc or dec):
        return TsInfo(False, col, None, 0, f"{col} is not in time order")
    n = int(st["nn"])
    sign = 1.0 if inc else -1.0
    freq = None
    if n >= 3 and st["ng"] >= 2:
        lo, hi = (st["dmin"], st["dmax"]) if inc else (-st["dmax"], -st["dmin"])
        freq = _freq_alias(lo, hi, st["ms"], st["me"])
    if freq is None and st["ng"] >= 1:
        med = quantile_dict(s.select((F.col("_d") * sign).alias("gap")), ["gap"], [0.5]).get(("gap", 0.5))
        freq = next((name for limit, name in FREQ_BUCKETS if med < limit), "A") if med is not None else None
    return TsInfo(True, col, freq, n,
                  f"{n} periods of {freq or 'unknown'} spacing by {col}")


def outcome_type(df: DataFrame, col: str) -> str:
    """The type of one outcome, as ``outcome_types`` has it."""
    n, text = distinct_up_to(df, [col], 5)[col], isinstance(df.schema[col].dataType, T.StringType)
    return "binary" if n == 2 or (text and n <= 5) else "continuous"


def outcome_types(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_unique, outcome_type): 2 distinct -> binary; string with <= 5 -> binary."""
    cols = list(cols or df.columns)
    d = distinct_counts(df, cols)
    rows = []
    for c in cols:
        n = d[c]
        s = isinstance(df.schema[c].dataType, T.StringType)
        rows.append((c, n, "binary" if n == 2 or (s and n <= 5) else "continuous"))
    return df.sparkSession.createDataFrame(rows, "column string, n_unique long, outcome_type string")
