"""Parameter search, leaf-wise boosting and kernel machines against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabscale.operators import boosting as B
from tabscale.operators import kernel as K
from tabscale.operators import models as ML
from tabscale.operators.tpe import Density, Param, Search

HOW = {"task": "regression", "rounds": 5, "max_depth": 4, "num_leaves": 6, "learning_rate": 0.3, "reg_lambda": 1.0, "min_gain": 1e-9,
       "min_rows": 2, "min_hessian": 1e-3, "subsample": 1.0, "colsample": 1.0, "seed": 1, "n_bins": 32}


# ----------------------------------------------------------------------- search

def _surface(p):
    return (0.3 * (math.log10(p["a"]) + 2) ** 2 + 0.2 * abs(p["b"] - 7) + 3 * (p["c"] - 0.3) ** 2 + 0.3 * math.sin(5 * p["c"]))


def _best_of(n, seed, startup, sign=1):
    s = Search({"a": Param(1e-4, 100, log=True), "b": Param(2, 20, whole=True), "c": Param(0, 1)}, seed, sign > 0, startup)
    while len(s.trials) < n:
        for i, p in [s.ask() for _ in range(min(8, n - len(s.trials)))]:
            s.tell(i, sign * _surface(p))
    return s


def test_search_beats_random_draws():
    learnt, random = ([_best_of(50, seed, startup).best()[0] for seed in range(20)] for startup in (10, 10**9))
    assert np.mean(learnt) < 0.8 * np.mean(random)
    assert sum(a < b for a, b in zip(learnt, random)) >= 14


def test_search_is_repeatable_and_keeps_its_ranges():
    a, b = _best_of(40, 3, 10), _best_of(40, 3, 10)
    assert a.trials == b.trials
    assert all(1e-4 <= t["a"] <= 100 and t["b"] in range(2, 21) and 0 <= t["c"] <= 1 for t in a.trials)
    up, down = _best_of(40, 3, 10, -1), _best_of(40, 3, 10)
    assert up.best()[0] == -down.best()[0]
    s = Search({"x": Param(0, 1)})
    for i in range(12):
        s.tell(s.ask()[0], None if i % 2 else float("nan"))
    assert s.best() == (None, {}) and 0 <= s.ask()[1]["x"] <= 1


def test_density_is_one():
    for points in ([], [0.5], [0.0, 0.01, 0.9, 1.0, 1.0]):
        u = (np.arange(20_000) + 0.5) / 20_000
        assert np.exp(Density(points).log(u)).mean() == pytest.approx(1, abs=2e-3)


def test_hyperparam_search_reports_failures(spark):
    df = spark.createDataFrame([(i, float(i % 7), float((i % 7) * 2 + i % 3)) for i in range(60)], "i long, x double, y double")
    trials, best, base, score, model = ML.hyperparam_search(df, ["x"], "y", "regression", "Ridge", ["i"], n_trials=12, k=3)
    rows = trials.collect()
    assert len(rows) == 12 and all(r["error"] is None for r in rows)
    assert score == min(r["score"] for r in rows) and score <= base * 1.01 and set(best) == {"alpha"}
    assert model.transform(df).count() == 60


# --------------------------------------------------------------------- boosting

def _data(n=200, p=3, seed=0, classes=0):
    rng = np.random.RandomState(seed)
    bins = rng.randint(0, HOW["n_bins"], (n, p)).astype(np.uint8)
    y = np.sin(bins[:, 0] / 5) * 3 + (bins[:, 1] > 16) * bins[:, 2] / 8 + rng.normal(0, 0.2, n)
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    return bins, y


def _brute_split(bins, g, h, how):
    best = (-np.inf, 0, 0)
    lam = how["reg_lambda"]
    for f in range(bins.shape[1]):
        for b in range(how["n_bins"]):
            left = bins[:, f] <= b
            if min(left.sum(), (~left).sum()) < how["min_rows"]:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + lam) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + lam)
            if gain > best[0] + 1e-12:
                best = (gain, f, b)
    return best


def _serial_leafwise(bins, g, h, how):
    """One split at a time: the leaf with the greatest gain."""
    leaves = [(np.arange(len(g)), 0)]
    while len(leaves) < how["num_leaves"]:
        found = [(_brute_split(bins[i], g[i], h[i], how), n) for n, (i, d) in enumerate(leaves) if d < how["max_depth"]]
        found = [x for x in found if x[0][0] > how["min_gain"]]
        if not found:
            break
        (gain, f, b), n = max(found, key=lambda x: x[0][0])
        i, d = leaves.pop(n)
        left = bins[i, f] <= b
        leaves += [(i[left], d + 1), (i[~left], d + 1)]
    out = np.zeros(len(g))
    for i, _ in leaves:
        out[i] = -how["learning_rate"] * g[i].sum() / (h[i].sum() + how["reg_lambda"])
    return out, len(leaves)


@pytest.mark.parametrize("leaves,depth,lam", [(6, 4, 1.0), (2, 4, 0.0), (12, 3, 5.0), (31, 6, 0.1)])
def test_growth_equals_one_split_at_a_time(leaves, depth, lam):
    how = {**HOW, "num_leaves": leaves, "max_depth": depth, "reg_lambda": lam, "rounds": 1}
    bins, y = _data()
    start = np.array([y.mean()])
    rounds, losses = B.boost_solo(bins, y, np.arange(len(y)), start, how)
    g, h, _ = B.gradients("regression", np.full((len(y), 1), y.mean()), y)
    want, n = _serial_leafwise(bins, g[:, 0], h[:, 0], how)
    got = np.zeros(len(y))
    rounds[0][0].add_to(got, bins)
    assert np.allclose(got, want)
    assert sum(f < 0 for f in rounds[0][0].feature) >= n and losses[1] < losses[0]


@pytest.mark.parametrize("task,classes", [("regression", 0), ("classification", 2), ("classification", 4)])
def test_training_loss_falls_and_partitions_agree(spark, monkeypatch, task, classes):
    monkeypatch.setattr(B, "STATE_EVERY", 2)
    how = {**HOW, "task": task, "rounds": 3, "max_depth": 2, "subsample": 0.8, "colsample": 0.7}
    bins, y = _data(160, 3, 5, classes)
    shares = np.bincount(y.astype(int), minlength=2) / len(y) if classes else np.zeros(2)
    start = B.start_scores(task, y.mean(), shares)
    rounds, losses = B.boost_solo(bins, y, np.arange(len(y)), start, how)
    assert all(b < a for a, b in zip(losses, losses[1:]))
    frame = spark.createDataFrame([(i, float(v), bytearray(b.tobytes())) for i, (v, b) in enumerate(zip(y, bins))],
                                  "_i long, _y double, _b binary").repartition(3)
    spread, same = B.boost_spread(frame, len(y), 3, start, how)
    assert np.allclose(losses, same)
    assert [[t.feature for t in ts] for ts in spread] == [[t.feature for t in ts] for ts in rounds]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(2)
    x = rng.normal(0, 1, (600, 3))
    y = (x[:, 0] ** 2 + x[:, 1] > 0.7).astype(float) + (x[:, 2] > 1)
    pdf = pd.DataFrame({"i": range(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "z": 2 * x[:, 0] + np.sin(3 * x[:, 1])})
    pdf.loc[::40, "c"] = np.nan
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(spark.createDataFrame(pdf)).cache()


def test_boosting_estimator(spark, blobs, tmp_path):
    model = Pipeline(stages=[B.LeafBoosting(task="classification", labelCol="y", rounds=25)]).fit(blobs)
    out = model.transform(blobs)
    assert out.where("prediction = y").count() > 570
    assert out.where(F.size(vector_to_array("rawPrediction")) != 3).count() == 0
    assert model.stages[0].losses[-1] < 0.5 * model.stages[0].losses[0]
    assert model.stages[0].featureImportances.toArray().sum() == pytest.approx(1)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(blobs)
    assert again.select("i", "prediction").exceptAll(out.select("i", "prediction")).count() == 0
    one = B.LeafBoosting(labelCol="z", rounds=1, num_leaves=4, reg_lambda=0.0, learning_rate=1.0).fit(blobs)
    assert one.transform(blobs).select("prediction").distinct().count() == 4
    flat = B.LeafBoosting(labelCol="z", rounds=1, num_leaves=4, reg_lambda=1e9).fit(blobs).transform(blobs)
    assert flat.agg(F.stddev("prediction")).collect()[0][0] < 1e-4


# -------------------------------------------------------------- kernel machines

def _dense(kernel, y, C, epsilon, task):
    """The objective at the optimum in the kernel's own coefficients: linear systems on the rows that cost, until they stay."""
    n = len(y)
    on, sign = np.ones(n, bool), np.zeros(n)
    for _ in range(200):
        i = np.flatnonzero(on)
        target = y[i] + (sign[i] * epsilon if task == "regression" else 0)
        a = np.zeros((len(i) + 1, len(i) + 1))
        a[:-1, :-1] = kernel[np.ix_(i, i)] + np.eye(len(i)) / (2 * C)
        a[:-1, -1] = a[-1, :-1] = 1
        sol = np.linalg.solve(a, np.append(target, 0))
        alpha = np.zeros(n)
        alpha[i] = sol[:-1]
        f = kernel @ alpha + sol[-1]
        e = f - y
        new = (np.abs(e) > epsilon) if task == "regression" else (y * f < 1)
        s = np.sign(e)
        if (new == on).all() and (task != "regression" or (s[on] == sign[on]).all()):
            break
        on, sign = new, s
    r = np.maximum(np.abs(e) - epsilon, 0) if task == "regression" else np.maximum(1 - y * f, 0)
    return 0.5 * alpha @ kernel @ alpha + C * (r ** 2).sum()


@pytest.mark.parametrize("task,C,epsilon", [("classification", 1.0, 0.0), ("regression", 1.0, 0.1), ("regression", 10.0, 0.5)])
def test_kernel_objective_equals_a_dense_solve(spark, task, C, epsilon):
    rng = np.random.RandomState(8)
    x = rng.normal(0, 1, (500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.2, 500)
    t = (y > 0).astype(float) if task == "classification" else y
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": t})).repartition(3)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    fit = K.KernelMachine(task=task, C=C, epsilon=epsilon, gamma=0.5, landmarks=500).fit(df)
    want = _dense(K.rbf(x, x, 0.5), 2 * t - 1 if task == "classification" else y, C, epsilon, task)
    assert fit.objectives[0][-1] == pytest.approx(want, rel=0.01)
    assert all(b <= a for a, b in zip(fit.objectives[0], fit.objectives[0][1:]))
    small = K.KernelMachine(task=task, C=C, epsilon=epsilon, gamma=0.5, landmarks=60).fit(df)
    assert small.objectives[0][-1] < 1.5 * want


def test_kernel_classes_and_persistence(spark, blobs, tmp_path):
    whole = blobs.where(~F.isnan("c"))
    model = Pipeline(stages=[K.KernelMachine(task="classification", labelCol="y", C=10.0)]).fit(whole)
    out = model.transform(whole)
    assert out.where("prediction = y").count() > 0.9 * whole.count()
    model.write().overwrite().save(str(tmp_path / "k"))
    again = PipelineModel.load(str(tmp_path / "k")).transform(whole)
    assert again.select("i", "prediction").exceptAll(out.select("i", "prediction")).count() == 0


# ---------------------------------------------------------------------- metrics

def test_report_counts_null_predictions_and_many_classes(spark):
    from tabscale.operators import metrics as M
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "a"), ("b", "a"), ("c", "z")], "l string, p string")
    rep = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in M.classification_report(df, "l", "p").collect()}
    assert rep["a"] == (0.5, 0.5, 2) and rep["z"] == (0.0, 0.0, 0) and rep["accuracy"][0] == 0.25
    assert {(r[0], r[1]): r[2] for r in M.confusion_matrix(df, "l", "p").collect()} == {
        ("a", "a"): 1, ("a", None): 1, (None, "a"): 1, ("b", "a"): 1, ("c", "z"): 1}
    full = {(r[0], r[1]): r[2] for r in M.confusion_matrix(df, "l", "p", zero_cells=True).collect()}
    assert len(full) == 16 + 2 and full[("z", "z")] == 0
    many = spark.range(200_000).select(F.col("id").cast("string").alias("l"), (F.col("id") - F.col("id") % 2).cast("string").alias("p"))
    rep = {r["class"]: r["recall"] for r in M.classification_report(many, "l", "p").where("class IN ('accuracy', 'macro avg')").collect()}
    assert rep == {"accuracy": 0.5, "macro avg": 0.5}


def test_bootstrap_copies_no_row(spark):
    from tabscale.operators import causal as C
    df = spark.range(5000).select(F.col("id"), (F.rand(3) * 10).alias("v"))
    reps = C.poisson_bootstrap(df, "v", "id", 50, 7)
    assert "Generate" not in reps._jdf.queryExecution().executedPlan().toString()
    one, two = ({r["rep"]: r["estimate"] for r in C.poisson_bootstrap(df.repartition(n), "v", "id", 50, 7).collect()} for n in (1, 5))
    assert len(one) == 50 and all(one[k] == pytest.approx(two[k]) for k in one)
    assert C.poisson_bootstrap(df.limit(0), "v", "id").collect() == []


def test_ridge_solves_the_plain_objective(spark):
    rng = np.random.RandomState(1)
    x, y = rng.normal(0, 1, (80, 2)), rng.normal(0, 50, 80)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    for alpha in (0.5, 20.0):
        est = ML.with_params(ML.regression_models(80)["Ridge"], {"alpha": alpha}, 80)
        got = ML.build_pipeline(est, ["a", "b"], "y", "regression").fit(df).stages[-1].coefficients.toArray()
        c = x - x.mean(0)
        assert np.allclose(got, np.linalg.solve(c.T @ c + alpha * np.eye(2), c.T @ (y - y.mean())), rtol=1e-6)


def test_nearest_join_with_one_far_right_row(spark):
    """Left rows before, between and after their right rows, in several groups and partitions."""
    from tabscale.operators import order as O
    rng = np.random.RandomState(4)
    left = pd.DataFrame({"i": range(600), "g": rng.choice(["a", "b", "c"], 600), "x": np.round(rng.rand(600) * 50, 1)})
    right = pd.DataFrame({"g": ["a", "b", "b", "b"], "x": [49.9, 3.0, 25.0, 25.2]})
    got = O.nearest_join(spark.createDataFrame(left), spark.createDataFrame(right), "x", by=["g"], num_partitions=5).toPandas()
    for r in got.itertuples():
        vals = right[right.g == r.g].x.tolist()
        want = min((abs(r.x - v), v) for v in vals) if vals else None
        assert (pd.isna(r.nearest) and want is None) or r.distance == pytest.approx(want[0])
    one = O.nearest_join(spark.range(300_000).select(F.col("id").cast("double").alias("x")), spark.createDataFrame([(1e9,)], "x double"), "x")
    assert one.where("nearest = 1e9").count() == 300_000


def test_distinct_up_to_moves_few_values(spark):
    from tabscale.operators import detect as D
    df = spark.range(50_000, numPartitions=4).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"), F.lit(None).cast("string").alias("c"),
                                                     (F.col("id") % 21).cast("string").alias("d"))
    assert D.distinct_up_to(df, ["a", "b", "c", "d"], 20) == {"a": 3, "b": 21, "c": 0, "d": 21}
    assert D.distinct_up_to(df, [], 5) == {} and D.distinct_up_to(df.limit(0), ["a"], 5) == {"a": 0}
    assert [D.outcome_type(df, c) for c in "abd"] == ["continuous", "continuous", "continuous"]
    assert D.outcome_type(df.where("a < 2"), "a") == "binary"


def test_one_hot_of_many_categories(spark):
    from tabscale.operators import causal as C
    from tabscale.operators import features as FE
    df = spark.range(21_000).select("id", F.when(F.col("id") % 50 != 7, F.format_string("v%05d", F.col("id") % 10_500)).alias("c"),
                                    F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("d"), (F.col("id") % 2).alias("t"),
                                    (F.col("id") % 11).cast("double").alias("n"))
    out = FE.one_hot(df, ["c", "d"])
    assert out.columns == ["id", "t", "n", "c_onehot", "d_y"]
    cats = sorted({f"v{i % 10_500:05d}" for i in range(21_000) if i % 50 != 7})
    for r in out.where("id IN (0, 1, 7, 10501, 20999)").collect():
        v = f"v{r['id'] % 10_500:05d}"
        want = [] if r["id"] % 50 == 7 or v == cats[0] else [cats.index(v) - 1]
        assert r["c_onehot"].size == len(cats) - 1 and r["c_onehot"].indices.tolist() == want
    x, names = C.covariate_matrix(df, ["n", "c", "d"])
    assert names == ["_x_n", "_x_d_y", "_x_c"]
    scored, model = C.propensity_scores(x, names, tcol="t")
    assert model.numFeatures == len(cats) + 1 and scored.where("_ps > 0 AND _ps < 1").count() == 21_000


# ---------------------------------------------------------------------- forests

def test_forest_grows_to_pure_leaves(spark, blobs, tmp_path):
    from tabscale.operators import forest as FO
    whole = FO.Forest(task="classification", labelCol="y", trees=5, share=1.0).fit(blobs)
    # the trees are the same whoever grows a node: one task, or level by level and then tasks of 60 rows
    parts = FO.Forest(task="classification", labelCol="y", trees=5, share=1.0, task_rows=60).fit(blobs.repartition(1))
    assert all(max(v) == 1.0 for t in whole.nodes for f, v in zip(t["f"], t["v"]) if f < 0)
    one = FO.Forest(task="classification", labelCol="y", trees=5, share=1.0).fit(blobs.repartition(1))
    key = lambda m: [sorted(zip(t["f"], t["b"], map(tuple, t["v"]))) for t in m.nodes]
    assert key(parts) == key(one)
    out = whole.transform(blobs)
    assert out.where("prediction = y").count() > 540 and whole.featureImportances.toArray().sum() == pytest.approx(1)
    whole.write().overwrite().save(str(tmp_path / "f"))
    again = FO.ForestModel.load(str(tmp_path / "f")).transform(blobs)
    assert again.select("i", "prediction").exceptAll(out.select("i", "prediction")).count() == 0


def test_forest_regression_and_leaf_size(spark, blobs):
    from tabscale.operators import forest as FO
    m = FO.Forest(labelCol="z", trees=8, min_rows=20).fit(blobs)
    assert 600 / 20 >= max(sum(f < 0 for f in t["f"]) for t in m.nodes) > 4
    r2 = m.transform(blobs).agg(1 - F.sum(F.pow(F.col("prediction") - F.col("z"), 2)) / (F.var_pop("z") * F.count("z"))).collect()[0][0]
    assert r2 > 0.8


def test_forest_split_equals_brute_force():
    from tabscale.operators import forest as FO
    bins, y = _data(120, 3, 9)
    w = np.random.RandomState(0).randint(1, 4, 120).astype(float)
    t = y[:, None]
    sums = FO.bin_sums(bins, np.zeros(120, int), 1, t, w, HOW["n_bins"])[0]
    gain, at = FO.best_split(sums, 3)

    def sse(m):
        mean = (y[m] * w[m]).sum() / w[m].sum()
        return (w[m] * (y[m] - mean) ** 2).sum()
    for f in range(3):
        want = max(((sse(np.ones(120, bool)) - sse(bins[:, f] <= b) - sse(bins[:, f] > b)), -b) for b in range(HOW["n_bins"])
                   if 3 <= (bins[:, f] <= b).sum() <= 117)
        assert gain[f] == pytest.approx(want[0])


def test_forest_model_reaches_the_workers_as_arrays():
    """Nodes of a deep tree take bytes in a worker, not Python objects."""
    from tabscale.operators import forest as FO
    got = FO._packed({"f": [0, -1, -1], "b": [3, 0, 0], "l": [1, 0, 0], "r": [2, 0, 0], "v": [[0.5, 0.5], [1.0, 0.0], [0.0, 1.0]]})
    assert all(isinstance(x, np.ndarray) for x in got) and sum(x.nbytes for x in got) == 3 * (16 + 16)


def test_model_frames_have_few_parts(spark):
    """Many passes over few rows do not pay for the parts that the rows came in."""
    from tabscale.operators.boosting import dealt
    wide = spark.range(0, 1000, 1, 300)
    few = dealt(wide, 1000)
    assert few.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and few.count() == 1000


def test_class_trees_by_level_equal_node_by_node():
    from tabscale.operators import forest as FO
    rng = np.random.RandomState(5)
    for n, p, k, bins, how in [(400, 3, 2, 9, {}), (300, 4, 3, 256, {"min_rows": 4, "tries": 1}), (300, 2, 5, 4, {"min_split": 30}),
                               (250, 5, 2, 30, {"max_depth": 3, "tries": 5}), (40, 0, 2, 1, {}), (1, 2, 2, 3, {})]:
        how = {"seed": 7, "tries": min(2, p), "classes": k, "n_bins": bins, "min_rows": 1, "min_split": 2, "max_depth": 0} | how
        b, y, w = rng.randint(0, bins, (n, p)).astype(np.uint8), rng.randint(0, k, n).astype(float), rng.randint(1, 4, n).astype(float)
        for top in (1, 6):
            got, want = (grow(b, FO.targets(y, k), w, 3, top, how) for grow in (FO.grow_classes, FO.grow_whole))
            assert sorted(got) == sorted(want)


def test_boosting_takes_one_task_while_its_rows_fit(spark, monkeypatch):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.range(120_000).selectExpr("double(id % 97) as a", "double(id % 89) as b", "double(id % 97 > 40) as y"))
    fit = B.LeafBoosting(task="classification", labelCol="y", rounds=2, max_depth=2).fit

    def spread(*_):
        raise RuntimeError("spread")
    monkeypatch.setattr(B, "boost_spread", spread)
    assert len(fit(df).trees) == 2
    monkeypatch.setattr(B, "SOLO_BYTES", 1 << 20)
    with pytest.raises(RuntimeError, match="spread"):
        fit(df)


def test_matching_by_waves_equals_the_serial_loop(spark, monkeypatch):
    from tabscale.operators import causal as C
    from tabscale.operators import matching as MA
    assert MA._waves([{"_g": 0, "n": 10}] * 100 + [{"_g": 1, "n": 7}]) == {0: [250, 500, 750, 1000], 1: [7]}
    monkeypatch.setattr(MA, "BLOCKS", 4)
    rng = np.random.RandomState(3)
    ps = rng.randint(1, 400, 500) / 400
    t = (rng.rand(500) < ps).astype(int)        # few controls where the scores are high
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(t, ps))], "id long, _T int, _ps double")
    got = {(r["t_id"], r["c_id"]) for r in C.psm_match(df, "id", block_rows=120).collect()}
    left, want = {i for i in range(500) if not t[i]}, set()
    for i in np.flatnonzero(t):
        if left:
            c = min(left, key=lambda c: (abs(ps[c] - ps[i]), c))
            left.remove(c)
            want.add((int(i), int(c)))
    assert got == want
