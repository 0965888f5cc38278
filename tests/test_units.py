"""Unit / invariant tests on hand-made frames (nulls, ties, constants, edge sizes)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscale.functions import distributions as D
from tabscale.functions.quantiles import exact_quantiles, quantile_dict
from tabscale.operators import abtest as A
from tabscale.operators import causal as K
from tabscale.operators import clean as C
from tabscale.operators import metrics as M
from tabscale.operators import models as ML
from tabscale.operators import order as O
from tabscale.operators import profile as P
from tabscale.sources import readers as R

from .conftest import SF_SMALL


def test_exact_quantiles_match_numpy_with_ties_and_nulls(spark):
    rng = np.random.RandomState(0)
    vals = np.concatenate([rng.randint(0, 20, 500).astype(float), [np.nan] * 30, [7.0] * 300])
    df = spark.createDataFrame(pd.DataFrame({"x": vals, "g": np.arange(len(vals)) % 3}))
    df = df.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantile_dict(df, ["x"], probs, accuracy=50)  # tiny accuracy forces the widening path
    clean = vals[~np.isnan(vals)]
    for p in probs:
        assert got[("x", p)] == pytest.approx(np.quantile(clean, p))
    grouped = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x"], [0.5], by=["g"]).collect()}
    for g in range(3):
        sub = vals[(np.arange(len(vals)) % 3 == g)]
        assert grouped[(g, 0.5)] == pytest.approx(np.quantile(sub[~np.isnan(sub)], 0.5))


def test_all_null_column_quantile_is_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert quantile_dict(df, ["x"], [0.5])[("x", 0.5)] is None


def test_distributions_against_published_values():
    assert D.t_sf2(2.0, 10) == pytest.approx(0.07339, abs=1e-5)
    assert D.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    w, p = D.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.006704, abs=2e-5)


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    got = O.row_index(df, ["k", "id"], num_partitions=7).orderBy("idx").select("k", "idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_midrank_and_prefix_max(spark):
    pdf = pd.DataFrame({"v": [3.0, 1.0, 3.0, 2.0, 3.0, 5.0]})
    df = spark.createDataFrame(pdf)
    r = sorted((x["v"], x["rank"]) for x in O.midrank(df, "v").collect())
    exp = sorted(zip(pdf.v, pdf.v.rank()))
    assert r == exp
    s = spark.createDataFrame(pd.DataFrame({"t": range(8), "s": [1.0, 3.0, 2.0, 5.0, 4.0, 4.0, 9.0, 0.0]}))
    best = [x["best_so_far"] for x in M.best_so_far(s, "t", "s").orderBy("t").collect()]
    assert best == [1.0, 3.0, 3.0, 5.0, 5.0, 5.0, 9.0, 9.0]


def test_sample_per_group_exact_size_and_hot_group(spark):
    # one key holds most rows: still exactly n per group, never more
    df = spark.range(0, 5000).withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 3 + 1))
    got = {r["g"]: r["count"] for r in O.sample_per_group(df, 50, by=["g"], id_col="id").groupBy("g").count().collect()}
    assert got == {0: 50, 1: 50, 2: 50, 3: 50}


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert C.column_modes(df, ["s"]) == {"s": "a"}


def test_constant_column_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "k double, x double")
    d = {r["column"]: r for r in P.describe_numeric(df).collect()}
    assert d["k"]["std"] == 0.0 and d["k"]["skew"] is None
    assert P.corr_long(df).collect()[0]["r"] is None
    assert [r["column"] for r in P.flag_zero_variance(df).collect()] == ["k"]


def test_outlier_summary_without_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert C.outlier_summary(df).count() == 0


def test_load_table_rejects_unknown_extension(spark):
    with pytest.raises(ValueError, match="cannot read .xlsx"):
        R.load_table(spark, "/tmp/whatever.xlsx")


def test_ab_requires_two_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "t string, y double")
    with pytest.raises(ValueError, match="needs two values"):
        A.arms(df, "t")


def test_mann_whitney_small_exact_and_ties(spark):
    # reference values: U of the first sample and exact two-sided p (no ties, n <= 8)
    x, y = [1.0, 2.0, 3.5, 4.0], [3.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", v) for v in y], "t string, y double")
    r = A.mann_whitney(df, "t", "y").collect()[0]
    assert r["u_stat"] == 2.0  # 3.5 > 3 and 4 > 3
    # P(U <= 2) = (1 + 1 + 2) / C(9, 4); two-sided doubles it
    assert r["p_value"] == pytest.approx(2 * 4 / math.comb(9, 4), abs=1e-6)


def test_causal_errors(spark):
    df = spark.createDataFrame([(1, 1, 2.0)], "id int, t int, y double")
    with pytest.raises(ValueError, match="needs two values"):
        K.treatment_flag(df, "t")
    with pytest.raises(ValueError, match="covariate"):
        K.covariate_matrix(df, [])


def _brute_greedy(pdf):
    tr = pdf[pdf._T == 1].sort_values("_rank")
    co = pdf[pdf._T == 0]
    used, out = set(), {}
    for tid, tps in zip(tr._id, tr._ps):
        cand = sorted((abs(cps - tps), cid) for cid, cps in zip(co._id, co._ps) if cid not in used)
        if not cand:
            break
        out[tid] = cand[0][1]
        used.add(cand[0][1])
    return out


def test_psm_equals_serial_greedy_and_invariants(spark):
    rng = np.random.RandomState(3)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "_T": (rng.rand(n) < 0.4).astype(int),
                        "_ps": np.round(rng.rand(n), 2)})  # rounded: many ties
    df = spark.createDataFrame(pdf)
    pairs = K.psm_match(df, "id").toPandas()
    ref = _brute_greedy(pdf.rename(columns={"id": "_id"}).assign(_rank=pdf.id))
    assert dict(zip(pairs.t_id, pairs.c_id)) == ref


@pytest.mark.parametrize("shape", ["surplus", "balanced", "short", "disjoint", "ties", "hot"])
def test_psm_by_deferred_acceptance_equals_the_serial_rule(spark, monkeypatch, shape):
    """The serial loop's pairs in every shape, and no group above block_rows."""
    from tabscale.operators import matching
    rng = np.random.RandomState(11)
    n, rows = (4000, 200) if shape == "balanced" else (1200, 240)
    t = (rng.rand(n) < {"surplus": 0.15, "short": 0.7, "disjoint": 0.2, "balanced": 0.5}.get(shape, 0.45)).astype(int)
    ps = rng.beta(2, 3, n) + 0.05 * t
    if shape == "ties":
        ps = np.round(ps, 2)
    if shape == "hot":      # one score holds over a third of all units
        ps = np.where(rng.rand(n) < 0.4, 0.5, np.round(ps, 1))
    if shape == "disjoint":
        ps = np.where(t == 1, 2 + ps, ps)
    pdf = pd.DataFrame({"id": np.arange(n), "_T": t, "_ps": ps})
    ref = _brute_greedy(pdf.rename(columns={"id": "_id"}).assign(_rank=pdf.id))
    seen = spark.sparkContext.accumulator(0)
    real = matching._settle

    def settle(ctrl, units, *where):
        if len(ctrl) + len(units) > rows:
            seen.add(1)
        return real(ctrl, units, *where)

    monkeypatch.setattr(matching, "_settle", settle)
    pairs = K.psm_match(spark.createDataFrame(pdf), "id", block_rows=rows).toPandas()
    assert dict(zip(pairs.t_id, pairs.c_id)) == ref
    assert seen.value == 0
    assert pairs.block.nunique() > 4 and pairs.groupby("block").size().max() <= rows // 4


def test_covariates_read_their_input_once(spark):
    """The joins under the covariates run once, not in every scan of the fits that follow."""
    left = spark.range(60).withColumn("v", F.col("id") * 1.5)
    x, names = K.covariate_matrix(left.join(spark.range(60).withColumn("w", F.col("id") % 7), "id"), ["v", "w"])
    assert names == ["_x_v", "_x_w"] and x.count() == 60
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_psm_leaves_only_the_pairs_on_disk(spark):
    """The tables of the rounds are deleted."""
    import glob
    import os
    from tabscale.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(os.path.join(top, "tabscale-match-*")))
    rng = np.random.RandomState(4)
    pdf = pd.DataFrame({"id": np.arange(100), "_T": rng.randint(0, 2, 100), "_ps": rng.rand(100)})
    K.psm_match(spark.createDataFrame(pdf), "id", block_rows=80)
    left = set(glob.glob(os.path.join(top, "tabscale-match-*"))) - before
    assert [os.path.basename(x).rsplit("-", 1)[0] for x in left] == ["tabscale-match-pairs"]


def test_psm_with_text_ids_in_one_group_and_in_blocks(spark):
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"id": [f"u{i:04d}" for i in range(400)], "_T": rng.randint(0, 2, 400), "_ps": np.round(rng.rand(400), 2)})
    df = spark.createDataFrame(pdf)
    one, many = (K.psm_match(df, "id", block_rows=r).toPandas() for r in (1000, 120))
    assert one.block.nunique() == 1 < many.block.nunique()
    assert dict(zip(one.t_id, one.c_id)) == dict(zip(many.t_id, many.c_id))
    assert dict(zip(one.t_id, one.c_id)) == _brute_greedy(pdf.rename(columns={"id": "_id"}).assign(_rank=range(400)))


def test_psm_within_keys_and_null_scores(spark):
    rng = np.random.RandomState(12)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "_T": (rng.rand(n) < 0.3).astype(int), "_ps": rng.rand(n),
                        "g": np.where(rng.rand(n) < 0.3, None, np.where(rng.rand(n) < 0.5, "a", "b"))})
    pdf.loc[::50, "_ps"] = np.nan
    df = spark.createDataFrame(pdf, "id long, _T int, _ps double, g string")
    df = df.withColumn("_ps", F.nanvl("_ps", F.lit(None).cast("double")))
    pairs = K.psm_match(df, "id", block_rows=20, block_by=["g"]).toPandas()
    want = {}
    for _, part in pdf[pdf._ps.notna()].groupby("g", dropna=False):
        want.update(_brute_greedy(part.rename(columns={"id": "_id"}).assign(_rank=part.id)))
    assert dict(zip(pairs.t_id, pairs.c_id)) == want


def test_bootstrap_se_close_to_analytic(spark):
    rng = np.random.RandomState(1)
    v = rng.normal(10, 3, 4000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": v}))
    se = K.bootstrap_se(df, "v", "id", reps=200)
    analytic = v.std() / math.sqrt(len(v))
    assert abs(se - analytic) / analytic < 0.25


def test_auc_equals_u_statistic(spark):
    df = spark.read.parquet(f"{SF_SMALL}/labels.parquet").join(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id")
    auc = M.roc_auc(df, "quality", "n_chars").collect()[0]["roc_auc"]
    pdf = df.select("quality", "n_chars").toPandas()
    r = pdf.n_chars.rank()
    n1, n0 = (pdf.quality == 1).sum(), (pdf.quality == 0).sum()
    u = r[pdf.quality == 1].sum() - n1 * (n1 + 1) / 2
    assert auc == pytest.approx(u / (n1 * n0), abs=1e-6)


def test_kfold_partitions_rows(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    f = ML.kfold_assign(df, ids, label="l_returnflag")
    assert f.count() == df.count()
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert len(sizes) == 5 and sizes[-1] - sizes[0] <= 3


def test_knn_matches_brute_force(spark):
    rng = np.random.RandomState(5)
    n = 300
    x = rng.rand(n, 3) * [100, 10, 1]
    y = x[:, 0] * 0.5 + rng.rand(n)
    y[rng.rand(n) < 0.2] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    from tabscale.operators.knn import knn_impute
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    got = {r["id"]: r["y"] for r in knn_impute(df, ["y"], id_col="id").collect()}
    feats = ["a", "b", "c", "y", "id"]
    M_ = pdf[feats].to_numpy()
    for i in np.where(np.isnan(y))[0]:
        d = []
        for j in np.where(~np.isnan(y))[0]:
            both = ~np.isnan(M_[i]) & ~np.isnan(M_[j])
            d.append((math.sqrt(len(feats) / both.sum() * ((M_[i, both] - M_[j, both]) ** 2).sum()), j))
        d.sort()
        assert got[i] == pytest.approx(np.mean([y[j] for _, j in d[:5]]))


def test_label_codes_distributed_equals_literal_map(spark):
    from tabscale.operators import features as FE
    vals = ["b", None, "a", "c", "a", "b", None, "z"] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, c string")
    lit = {r["id"]: r["c"] for r in FE.label_encode(df, "c").collect()}
    codes = FE.fit_label_codes(df, "c")
    assert sorted((r["_le_v"], r["_le_code"]) for r in codes.collect()) == [
        ("a", 0), ("b", 1), ("c", 2), ("nan", 3), ("z", 4)]
    dist = {r["id"]: r["c"] for r in FE.label_encode(df, "c", codes).collect()}
    assert lit == dist
    # the fallback kicks in above the literal bound
    assert isinstance(FE.fit_label_categories(df, "c", max_literal=3), type(codes))


def test_class_balance_shares_sum_to_one(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(30)] + [(99, None)], "id long, t string")
    rows = P.class_balance(df, "t").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("x", 20), ("y", 10)]
    assert sum(r["share"] for r in rows) == pytest.approx(1.0)


def test_exact_quantiles_distributed_bracket_path(spark, monkeypatch):
    from tabscale.functions import quantiles as Q
    monkeypatch.setattr(Q, "WINDOW_MAX_BRACKET", 0)  # force the prefix-sum path
    rng = np.random.RandomState(3)
    vals = np.concatenate([rng.normal(size=700), rng.randint(0, 5, 300).astype(float), [np.nan] * 20])
    df = spark.createDataFrame(pd.DataFrame({"x": vals, "g": np.arange(len(vals)) % 2}))
    df = df.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantile_dict(df, ["x"], probs, accuracy=100)
    clean = vals[~np.isnan(vals)]
    for p in probs:
        assert got[("x", p)] == pytest.approx(np.quantile(clean, p))
    grouped = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x"], [0.25, 0.5], by=["g"]).collect()}
    for g in range(2):
        sub = vals[(np.arange(len(vals)) % 2 == g)]
        for p in (0.25, 0.5):
            assert grouped[(g, p)] == pytest.approx(np.quantile(sub[~np.isnan(sub)], p))


def test_pairwise_corr_matches_pandas_with_nulls_and_constants(spark):
    from tabscale.functions.moments import pairwise_corr
    rng = np.random.RandomState(7)
    n = 400
    a = rng.normal(1e6, 3.0, n)                 # large mean: needs the shift
    b = a * 2 + rng.normal(0, 1.0, n)
    c = rng.normal(size=n)
    c[::5] = np.nan
    d = np.where(np.isnan(c), rng.normal(size=n), 3.0)   # constant where c is present
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    df = spark.createDataFrame(pdf).repartition(3)
    df = df.select(*[F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in pdf.columns])
    got = pairwise_corr(df, list(pdf.columns))
    cols = list(pdf.columns)
    for (i, j), v in got.items():
        sub = pdf[[cols[i], cols[j]]].dropna()
        if cols[j] == "d" and cols[i] == "c":
            assert v is None                     # d is constant on the rows where c is present
            continue
        assert v == pytest.approx(sub[cols[i]].corr(sub[cols[j]]), abs=1e-9)


def test_knn_hot_duplicate_vector_and_string_id(spark):
    rng = np.random.RandomState(11)
    n = 240
    a = rng.rand(n) * 50
    b = rng.rand(n) * 5
    hot = np.arange(n) < n // 3              # a third of the rows share one vector
    a[hot], b[hot] = 7.0, 1.0
    y = a * 0.3 + b
    y[(rng.rand(n) < 0.25) & ~hot] = np.nan
    y[np.arange(n) % 17 == 0] = np.nan       # some hot-vector recipients too
    ids = [f"r{i:04d}" for i in range(n)]
    pdf = pd.DataFrame({"rid": ids, "a": a, "b": b, "y": y})
    from tabscale.operators.knn import knn_impute
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    got = {r["rid"]: r["y"] for r in knn_impute(df, ["y"], id_col="rid").collect()}
    M_ = pdf[["a", "b", "y"]].to_numpy()
    for i in np.where(np.isnan(y))[0]:
        d = []
        for j in np.where(~np.isnan(y))[0]:
            both = ~np.isnan(M_[i]) & ~np.isnan(M_[j])
            d.append((math.sqrt(3 / both.sum() * ((M_[i, both] - M_[j, both]) ** 2).sum()), ids[j], j))
        d.sort()
        assert got[ids[i]] == pytest.approx(np.mean([y[j] for _, _, j in d[:5]]))
