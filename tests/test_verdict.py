"""Null keys, NaN, one-armed tests, CSV quoting and other inputs that the fixtures do not hold."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscale.functions.quantiles import exact_quantiles
from tabscale.operators import abtest as A
from tabscale.operators import causal as K
from tabscale.operators import clean as C
from tabscale.operators import detect as D
from tabscale.operators import features as FE
from tabscale.operators import models as M
from tabscale.operators import order as O
from tabscale.operators import profile as P
from tabscale.sources import readers as R


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", float((i * 37) % 101)) for i in range(100)]
    return spark.createDataFrame(rows, "id long, g string, y double").repartition(3)


def test_null_groups_stay(spark, grouped):
    idx = O.row_index(grouped, ["id"], by=["g"])
    assert idx.count() == 100
    nulls = idx.filter("g is null")
    assert sorted(r["idx"] for r in nulls.collect()) == list(range(20))
    assert O.midrank(grouped, "y", by=["g"]).count() == 100
    cum = {r["id"]: r["c"] for r in O.prefix_sum(grouped, ["id"], "y", by=["g"], name="c").collect()}
    want, at = {}, {}
    for r in sorted(grouped.collect(), key=lambda r: r["id"]):
        at[r["g"]] = at.get(r["g"], 0.0) + r["y"]
        want[r["id"]] = at[r["g"]]
    assert cum == pytest.approx(want)
    assert exact_quantiles(grouped, ["y"], [0.5], by=["g"]).filter("g is null").count() == 1
    assert P.box_stats(grouped, "y", by=["g"]).agg(F.sum("n")).first()[0] == 100
    assert P.histogram(grouped, "y", 5, by=["g"]).agg(F.sum("count")).first()[0] == 100
    assert FE.lag_features(grouped, ["id"], [1], cols=["y"], by=["g"], dropna=False).count() == 100
    assert M.kfold_assign(grouped, ["id"], label="g").count() == 100
    assert O.sample_per_group(grouped, 4, by=["g"]).filter("g is null").count() == 4


def test_nearest_join_keeps_null_rows_and_groups(spark):
    left = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, "a", 5.0), (4, "a", None)], "i int, g string, x double")
    right = spark.createDataFrame([(None, 3.0), ("a", 4.0), ("a", 7.0)], "g string, x double")
    got = {r["i"]: (r["nearest"], r["distance"]) for r in O.nearest_join(left, right, "x", by=["g"]).collect()}
    assert got == {1: (3.0, 2.0), 2: (None, None), 3: (4.0, 1.0), 4: (None, None)}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 4 == 0 else float(i)) for i in range(100)], "id long, x double")
    live = [float(i) for i in range(100) if i % 4]
    assert [tuple(r) for r in C.null_counts(df).collect()] == [("x", 25, 25.0)]
    d = [r for r in P.describe_numeric(df).collect() if r["column"] == "x"][0]
    assert d["count"] == 75 and d["mean"] == pytest.approx(sum(live) / 75) and d["max"] == 99.0
    filled = C.impute(df, ["x"], "mean").filter("id = 0").first()["x"]
    assert filled == pytest.approx(sum(live) / 75)
    assert P.corr_long(df).first()["r"] == pytest.approx(1.0)


def test_mode_of_large_integers(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big,), (big,), (1,), (None,)], "k long")
    assert C.column_modes(df, ["k"]) == {"k": big}
    assert C.impute(df, ["k"], "mode").filter(F.col("k") == big).count() == 3


def test_datetime_share_of_all_rows(spark):
    junk_after = spark.createDataFrame([(i, "2024-01-01" if i < 10 else f"text {i}") for i in range(200)], "i int, s string")
    assert D.coerce_datetime(junk_after, ["s"], ["i"])[1] == []
    junk_before = spark.createDataFrame([(i, "junk" if i < 10 else "2024-01-01") for i in range(200)], "i int, s string")
    assert D.coerce_datetime(junk_before, ["s"], ["i"])[1] == ["s"]


@pytest.mark.parametrize("text", ["2024-03-05T10:20:30Z", "2024-03-05T12:20:30+02:00", "2024/03/05 10:20:30", "03/05/2024 10:20:30"])
def test_datetime_layouts(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert str(df.select(D.parse_datetime(F.col("s")).alias("t")).first()["t"]) == "2024-03-05 10:20:30"


@pytest.mark.parametrize("text", ["05-Mar-2024", "20240305", "2024-03-05"])
def test_date_layouts(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert str(df.select(D.parse_datetime(F.col("s")).alias("t")).first()["t"]) == "2024-03-05 00:00:00"


def test_no_column_caps(spark):
    cols = [f"c{i}" for i in range(33)]
    df = spark.createDataFrame([tuple(float(j * (i + 1)) for i in range(33)) for j in range(5)], cols)
    assert P.column_overview(df).count() == 33
    assert P.high_corr_pairs(df.select(*cols[:5])).count() == 10
    assert len([c for c in FE.lag_features(df.select(*cols[:5]), ["c0"], [1]).columns if c.endswith("_lag1")]) == 5


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,s\n1,"say ""hi"", ok"\n2,"two\nlines"\n')
    got = {str(r["id"]): r["s"] for r in R.scan_csv(spark, str(p), coerce=False, multi_line=True).collect()}
    assert got == {"1": 'say "hi", ok', "2": "two\nlines"}


def test_exact_mann_whitney_with_one_large_arm(spark):
    rows = [("a", i * 250.5) for i in range(8)] + [("b", float(i)) for i in range(1992)]
    r = A.mann_whitney(spark.createDataFrame(rows, "t string, y double"), "t", "y").collect()[0]
    z = abs(r["z"])
    assert r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=5e-3)
    # all orders of 2 and 3 values: two-sided p of the smallest U is 2 / C(5, 2)
    assert A._mw_exact_p(0, 2, 3) == pytest.approx(2 / 10) and A._mw_exact_p(3, 2, 3) == 1.0


def test_one_armed_segments_have_no_result(spark):
    rows = [("s", "a", float(i)) for i in range(20)] + [("u", x, float(i * i % 17)) for i in range(30) for x in "ab"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, seg string, arm string, y double")
    got = {r["seg"]: r for r in A.ab_test(df, "arm", "y", "id", by=["seg"], outcome_type="continuous").collect()}
    assert got["s"]["note"] == "one arm is empty" and got["u"]["note"] is None
    assert all(got["s"][c] is None for c in ("p_value", "effect_size", "effect_interpretation", "power", "mean_diff"))
    flag = df.withColumn("y", (F.col("id") % 2).cast("int"))
    got = {r["seg"]: r for r in A.ab_test(flag, "arm", "y", "id", by=["seg"], outcome_type="binary").collect()}
    assert all(got["s"][c] is None for c in ("p_value", "statistic", "lift_pct", "power", "effect_interpretation"))
    assert got["u"]["p_value"] is not None


def test_chi_square_of_sparse_tables(spark):
    cells = {("a", "x"): 7, ("b", "y"): 5, ("c", "z"): 9, ("a", "y"): 2, ("c", "x"): 1}
    df = spark.createDataFrame([(a, o) for (a, o), n in cells.items() for _ in range(n)], "t string, o string")
    r = A.chi_square(df, "t", "o").collect()[0]
    arm, out, n = {}, {}, sum(cells.values())
    for (a, o), k in cells.items():
        arm[a] = arm.get(a, 0) + k
        out[o] = out.get(o, 0) + k
    want = sum((cells.get((a, o), 0) - arm[a] * out[o] / n) ** 2 / (arm[a] * out[o] / n) for a in arm for o in out)
    assert r["chi2"] == pytest.approx(want, abs=1e-5) and r["dof"] == 4
    assert A.contingency(df, "t", "o").count() == 5 and A.contingency(df, "t", "o", zero_cells=True).count() == 9
    plan = A.chi_square(df, "t", "o")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_features_without_pruning_and_without_target(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 7), float(i * 2)) for i in range(50)], "id long, a double, b double, y double")
    m = FE.engineer_features(df, "y", "regression", drop_high_corr=False, keep_cols=["id"])
    got = m[0] if isinstance(m, tuple) else m
    assert got.transform(df.drop("y")).count() == 50


def test_datetime_covariate_is_used(spark):
    df = spark.createDataFrame([(i, i % 2, float(i), f"2024-01-{1 + i % 28:02d}") for i in range(60)], "id long, _T int, x double, d string")
    _, names = K.covariate_matrix(df.withColumn("d", F.col("d").cast("date")), ["x", "d"])
    assert names == ["_x_x", "_x_d"]
    with pytest.raises(ValueError, match="covariate"):
        K.covariate_matrix(df.withColumn("d", F.array("x")), ["x", "d"])


def test_quantile_scan_keeps_only_bracket_rows(spark, monkeypatch):
    from tabscale.functions import quantiles as Q
    n, seen, plain = 20_000, [], Q._bracket_rows

    def counted(*args):
        out = plain(*args)
        seen.append(out.count())
        return out
    monkeypatch.setattr(Q, "_bracket_rows", counted)
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
    got = Q.quantile_dict(df, ["x"], [0.25, 0.5, 0.75])
    assert [got[("x", p)] for p in (0.25, 0.5, 0.75)] == [(n - 1) * p for p in (0.25, 0.5, 0.75)]
    assert sum(seen) <= n // 100


def test_knn_hot_cell_is_halved(spark):
    from tabscale.operators import knn as K
    rng = np.random.RandomState(3)
    n, k = 3000, 3
    a, b = rng.rand(n) * 1000, rng.rand(n) * 1000
    hot = np.arange(n) < n // 3  # a third of the rows in a millionth of the area
    a[hot], b[hot] = 500 + rng.rand(hot.sum()), 500 + rng.rand(hot.sum())
    y = a + b
    y[np.arange(n) % 20 == 0] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"rid": [f"r{i:04d}" for i in range(n)], "a": a, "b": b, "y": y}))
    df = df.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    rec, don = df.filter("y is null").select("a", "b"), df.filter("y is not null").select("a", "b")
    origin, r0 = {"a": 0.0, "b": 0.0}, 1000 * 4.0 * k / n
    todo = K._start_levels(rec, don, ["a", "b"], origin, r0, 2.0, -30, K.CELL_DONORS * k)
    own = todo.select("_lvl", *K._cells(["a", "b"], origin, r0, 2.0))
    levels = [r["_lvl"] for r in own.select("_lvl").distinct().collect()]
    placed = don.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in levels])))
    placed = placed.select("_lvl", *K._cells(["a", "b"], origin, r0, 2.0))
    assert own.count() == rec.count()
    assert own.join(placed, ["_lvl", "_c0", "_c1"]).count() <= rec.count() * K.CELL_DONORS * k
    got = {r["rid"]: r["y"] for r in K.knn_impute(df, ["y"], id_col="rid", k=k).collect()}
    know = np.flatnonzero(~np.isnan(y))
    for i in np.flatnonzero(np.isnan(y)):
        d = (a[know] - a[i]) ** 2 + (b[know] - b[i]) ** 2
        assert got[f"r{i:04d}"] == pytest.approx(y[know[np.argsort(d, kind="stable")[:k]]].mean())


def test_kfold_many_classes_and_null_label(spark):
    from tabscale.operators import models as ML
    df = spark.range(400).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 83).alias("y"))
    got = ML.kfold_assign(df, ["id"], label="y").collect()
    assert len(got) == 400
    of: dict = {}
    for r in got:
        of.setdefault(r["y"], []).append(r["fold"])
    sizes = [sum(r["fold"] == i for r in got) for i in range(5)]
    assert sum(sizes) == 400 and max(sizes) - min(sizes) <= 1
    for folds in of.values():
        each = [folds.count(i) for i in range(5)]
        assert max(each) - min(each) <= 1


def test_boosting_search_draws_subset_and_leaf_limits(spark):
    from tabscale.operators import models as ML
    from tabscale.operators.tpe import Search
    est = ML.regression_models(100, rounds=7, forest_depth=3)["GradientBoosting"]
    assert est.getOrDefault("rounds") == 7
    draw = Search(ML.search_space("GradientBoosting"), 1).ask()[1]
    est = ML.with_params(est, draw, 100)
    assert 0.5 <= est.getOrDefault("colsample") <= 1.0 and 0.5 <= est.getOrDefault("subsample") <= 1.0
    assert est.getOrDefault("num_leaves") == draw["num_leaves"] and est.getOrDefault("reg_lambda") == draw["reg_lambda"] > 0
    assert set(ML.search_space("SVR")) == {"C", "epsilon"}
