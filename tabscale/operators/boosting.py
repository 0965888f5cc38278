"""Gradient boosting with second-order gains, grown leaf by leaf.

Features become at most ``max_bins`` bins at quantiles. A tree level is one pass
over the rows: gradients and Hessians are summed per (class, node, feature, bin),
and the best bin of every (class, node, feature) comes back, never a row. The
gain of a split is G_l^2/(H_l+a) + G_r^2/(H_r+a) - G^2/(H+a) with the ridge term
a = ``reg_lambda``; a leaf is -G/(H+a) times the learning rate.

Growing by the best leaf up to ``num_leaves`` takes exactly the splits with the
greatest least gain on their path from the root, so a whole level is searched at
once and only nodes that can still be among the best ``num_leaves - 1`` go on.

Several classes are one model: a tree per class and round on softmax gradients.
Rows that are few enough for one task (``SOLO_ROWS``, ``SOLO_BYTES``) are boosted in one task by
the same functions; above, scores are written to the checkpoint folder every
``STATE_EVERY`` rounds and carried on from there. NaN is larger than any value.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SOLO_ROWS = 1_000_000
SOLO_BYTES = 32 << 20  # of bins, gradients and Hessians of more than 100,000 rows
STATE_EVERY = 10
PART_ROWS = 100_000


def dealt(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in no more parts than two a core or one per ``PART_ROWS`` rows: a fit runs hundreds of passes."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)))


# --------------------------------------------------------------- loss functions

def start_scores(task: str, y_mean: float, shares: np.ndarray) -> np.ndarray:
    """The constant scores before the first tree."""
    if task == "regression":
        return np.array([y_mean])
    p = np.clip(shares, 1e-12, 1)
    return np.log(p) if len(p) > 2 else np.array([np.log(p[1] / p[0])])


def probabilities(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(raw[:, 0], -500, 500)))
        return np.column_stack([1 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(task: str, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradients, Hessians, summed loss) of rows x classes."""
    if task == "regression":
        d = raw - y[:, None]
        return d, np.ones_like(d), float((d * d).sum() / 2)
    p = probabilities(raw)
    at = y.astype(np.int64)
    loss = -float(np.log(np.clip(p[np.arange(len(y)), at], 1e-300, 1)).sum())
    if raw.shape[1] == 1:
        return (p[:, 1] - y)[:, None], np.maximum(p[:, 1] * p[:, 0], 1e-16)[:, None], loss
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), at] = 1
    return p - hit, np.maximum(p * (1 - p), 1e-16), loss


# ------------------------------------------------------------------------ trees

class Tree:
    """Arrays of nodes; a node with feature -1 is a leaf. Left: bin at most the split's."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, n, n + 1
        for k in (self.feature, self.bin, self.left, self.right, self.value):
            k.extend([-1 if k is self.feature else 0] * 2)
        return n, n + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, at, left, right = (np.asarray(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[node]
            go = f >= 0
            if not go.any():
                return node
            over = bins[rows, np.maximum(f, 0)] > at[node]
            node = np.where(go, np.where(over, right[node], left[node]), node)

    def add_to(self, raw: np.ndarray, bins: np.ndarray) -> None:
        raw += np.array(self.value)[self.leaf_of(bins)]


def sums_by_bin(bins: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray, n_bins: int) -> np.ndarray:
    """(nodes, features, bins, [gradient, Hessian, rows]); rows with node -1 take no part."""
    use = node >= 0
    bins, node, g, h = bins[use], node[use], g[use], h[use]
    out = np.zeros((n_nodes, bins.shape[1], n_bins, 3))
    for f in range(bins.shape[1]):
        cell = node * n_bins + bins[:, f]
        for k, w in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(cell, weights=w, minlength=n_nodes * n_bins).reshape(n_nodes, n_bins)
    return out


def best_bins(sums: np.ndarray, reg_lambda: float, min_rows: int, min_hessian: float):
    """Per leading index of (..., bins, 3): the gain of the best split, its bin, and the totals."""
    total = sums.sum(axis=-2)
    left = np.cumsum(sums, axis=-2)
    right = total[..., None, :] - left

    def quality(x):
        return x[..., 0] ** 2 / np.maximum(x[..., 1] + reg_lambda, 1e-300)
    gain = quality(left) + quality(right) - quality(total)[..., None]
    ok = (np.minimum(left[..., 2], right[..., 2]) >= max(min_rows, 1)) & (np.minimum(left[..., 1], right[..., 1]) >= min_hessian)
    gain = np.where(ok, gain, -np.inf)
    at = gain.argmax(axis=-1)
    return np.take_along_axis(gain, at[..., None], -1)[..., 0], at, total


def grow(level_sums, how: dict, allowed: np.ndarray, n_classes: int) -> list[Tree]:
    """One tree per class. ``level_sums(trees, nodes)`` gives, for each (class, node), the gain, feature and bin of its
    best split over ``allowed`` features, and G and H, of the trees as split so far."""
    trees = [Tree() for _ in range(n_classes)]
    splits: list[list[tuple]] = [[] for _ in range(n_classes)]        # (least gain on the path, node, feature, bin)
    totals: list[dict] = [{} for _ in range(n_classes)]
    ask = [(k, 0, np.inf) for k in range(n_classes)]
    room = how["num_leaves"] - 1
    for depth in range(how["max_depth"] + 1):
        if not ask:
            break
        found = level_sums(trees, [(k, node) for k, node, _ in ask])
        able = []
        for (k, node, path), (gain, feature, bin_, g, h) in zip(ask, found):
            totals[k][node] = (g, h)
            if depth < how["max_depth"] and gain > how["min_gain"]:
                able.append((k, node, min(path, gain), feature, bin_))
        ask = []
        for k in range(n_classes):
            mine = [(p, node, f, b) for kk, node, p, f, b in able if kk == k]
            # a path that is not among the best now cannot be at the end
            cut = sorted([s[0] for s in splits[k]] + [m[0] for m in mine], reverse=True)[:room]
            for p, node, f, b in mine:
                if cut and p >= cut[-1]:
                    left, right = trees[k].split(node, f, b)
                    splits[k].append((p, node, f, b))
                    ask += [(k, left, p), (k, right, p)]
    for k, tree in enumerate(trees):
        keep = {s[1] for s in sorted(splits[k], key=lambda s: (-s[0], s[1]))[:room]}
        for node in range(len(tree.feature)):
            if tree.feature[node] >= 0 and node not in keep:
                tree.feature[node] = -1
            if node in totals[k]:
                g, h = totals[k][node]
                tree.value[node] = -how["learning_rate"] * g / max(h + how["reg_lambda"], 1e-300)
    return trees


def drawn(rows: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Whether a row (by its number) is in the round's sample."""
    if share >= 1:
        return np.ones(len(rows), bool)
    x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + round_) % (1 << 63))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * ((1 << 64) - 1)))


def features_of(round_: int, how: dict, n: int) -> np.ndarray:
    use = np.ones(n, bool)
    if how["colsample"] < 1:
        rng = np.random.RandomState((how["seed"] + 7919 * round_) % (1 << 32))
        use[:] = False
        use[rng.permutation(n)[:max(1, int(np.ceil(how["colsample"] * n)))]] = True
    return use


def pick(gain, at, total, allowed):
    """Best feature of each node from (nodes, features) gains: list of (gain, feature, bin, G, H)."""
    gain = np.where(allowed[None, :], gain, -np.inf)
    f = gain.argmax(axis=1)
    rows = np.arange(len(f))
    return [(float(a), int(b), int(c), float(t[0]), float(t[1])) for a, b, c, t in zip(gain[rows, f], f, at[rows, f], total[rows, f])]


def _level(trees, nodes, bins, use, g, h, n_bins):
    """Sums of (class, node) pairs over the rows given, in their order."""
    out = []
    for k in sorted({k for k, _ in nodes}):
        mine = [n for kk, n in nodes if kk == k]
        slot = np.full(len(trees[k].feature), -1)
        slot[mine] = np.arange(len(mine))
        node = np.where(use, slot[trees[k].leaf_of(bins)], -1)
        out.append(sums_by_bin(bins, node, len(mine), g[:, k], h[:, k], n_bins))
    return np.concatenate(out)


def boost_solo(bins: np.ndarray, y: np.ndarray, rows: np.ndarray, start: np.ndarray, how: dict):
    """(trees per round, loss before each round and at the end) of rows in one task."""
    raw = np.tile(start, (len(y), 1)).astype(float)
    rounds, losses = [], []
    for r in range(how["rounds"]):
        g, h, loss = gradients(how["task"], raw, y)
        losses.append(loss / len(y))
        use, allowed = drawn(rows, how["seed"], r, how["subsample"]), features_of(r, how, bins.shape[1])

        def level_sums(trees, nodes):
            sums = _level(trees, nodes, bins, use, g, h, how["n_bins"])
            return pick(*best_bins(sums, how["reg_lambda"], how["min_rows"], how["min_hessian"]), allowed)
        trees = grow(level_sums, how, allowed, raw.shape[1])
        for k, tree in enumerate(trees):
            tree.add_to(raw[:, k], bins)
        rounds.append(trees)
    losses.append(gradients(how["task"], raw, y)[2] / len(y))
    return rounds, losses


def _matrix(col, kind, width: int) -> np.ndarray:
    """Rows of a binary Arrow column as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), width)


def boost_spread(frame: DataFrame, n: int, p: int, start: np.ndarray, how: dict):
    """The same over the partitions of ``frame`` (_i, _y, _b: a byte per feature)."""
    spark, k_all, n_bins = frame.sparkSession, len(start), how["n_bins"]
    state = frame.withColumn("_raw", F.lit(np.asarray(start, "<f8").tobytes()))
    rounds, losses, fresh = [], [], []

    def scores(rb, since):
        bins = _matrix(rb.column(2), np.uint8, p)
        raw = _matrix(rb.column(3), "<f8", k_all).copy()
        for trees in since:
            for k, tree in enumerate(trees):
                tree.add_to(raw[:, k], bins)
        return bins, raw

    def level_pass(trees, nodes, r):
        shared = spark.sparkContext.broadcast((list(fresh), trees, nodes))

        def run(batches):
            since, trees, nodes = shared.value
            sums, loss = np.zeros((len(nodes), p, n_bins, 3)), 0.0
            for rb in batches:
                bins, raw = scores(rb, since)
                g, h, part = gradients(how["task"], raw, np.asarray(rb.column(1)))
                use = drawn(np.asarray(rb.column(0)), how["seed"], r, how["subsample"])
                sums += _level(trees, nodes, bins, use, g, h, n_bins)
                loss += part
            flat = sums.reshape(-1, 3)
            some = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(np.append(flat[some, k], loss)) for k in range(3))],
                                             names=["cell", "g", "h", "c"])

        def best(key, pdf):
            if key[0] < 0:
                return pd.DataFrame({"f": [key[0]], "gain": [0.0], "at": [0], "g": [0.0], "h": [0.0], "loss": [pdf["g"].sum()]})
            one = np.zeros((n_bins, 3))
            one[pdf["cell"].to_numpy() % n_bins] = pdf[["g", "h", "c"]].to_numpy()
            gain, at, total = best_bins(one, how["reg_lambda"], how["min_rows"], how["min_hessian"])
            return pd.DataFrame({"f": [key[0]], "gain": [float(gain)], "at": [int(at)], "g": [total[0]], "h": [total[1]], "loss": [0.0]})

        # one job a level: a (class, node, feature) has its cells summed and its best bin found where they meet; -1 is the loss
        cells = state.mapInArrow(run, "cell long, g double, h double, c double").withColumn(
            "f", F.floor(F.col("cell") / n_bins).cast("long")).repartition("f")
        cells = cells.groupBy("f", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c"))
        got = cells.groupBy("f").applyInPandas(best, "f long, gain double, at long, g double, h double, loss double").toPandas()
        loss = float(got.loc[got["f"] == -1, "loss"].iloc[0])
        got = got[got["f"] >= 0]                               # one row per (class, node, feature)
        gain, at, total = np.full((len(nodes), p), -np.inf), np.zeros((len(nodes), p), int), np.zeros((len(nodes), p, 2))
        i, f = np.divmod(got["f"].to_numpy(np.int64), p)
        gain[i, f], at[i, f], total[i, f] = got["gain"], got["at"], got[["g", "h"]].to_numpy()
        return gain, at, total, loss

    for r in range(how["rounds"]):
        allowed = features_of(r, how, p)
        told = []

        def level_sums(trees, nodes):
            gain, at, total, loss = level_pass(trees, nodes, r)
            told.append(loss / n)
            return pick(gain, at, total, allowed)
        trees = grow(level_sums, how, allowed, k_all)
        losses.append(told[0])
        rounds.append(trees)
        fresh.append(trees)
        if len(fresh) == STATE_EVERY and r + 1 < how["rounds"]:
            shared = spark.sparkContext.broadcast(list(fresh))

            def carry(batches, shared=shared):
                for rb in batches:
                    _, raw = scores(rb, shared.value)
                    yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array([x.tobytes() for x in raw.astype("<f8")], pa.binary())],
                                                     names=rb.schema.names)
            state = state.mapInArrow(carry, state.schema).checkpoint()
            fresh.clear()
    losses.append(level_pass([Tree() for _ in range(k_all)], [(k, 0) for k in range(k_all)], how["rounds"])[3] / n)
    return rounds, losses


# -------------------------------------------------------------------- estimator

class _Params(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    task = Param(Params._dummy(), "task", "regression or classification (labels 0, 1, ...)", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "deepest leaf", TypeConverters.toInt)
    num_leaves = Param(Params._dummy(), "num_leaves", "most leaves of a tree", TypeConverters.toInt)
    learning_rate = Param(Params._dummy(), "learning_rate", "shrinkage of a leaf", TypeConverters.toFloat)
    reg_lambda = Param(Params._dummy(), "reg_lambda", "ridge term of a leaf", TypeConverters.toFloat)
    min_gain = Param(Params._dummy(), "min_gain", "least gain of a split", TypeConverters.toFloat)
    min_rows = Param(Params._dummy(), "min_rows", "least rows of a leaf", TypeConverters.toInt)
    min_hessian = Param(Params._dummy(), "min_hessian", "least Hessian of a leaf", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows of a round", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of features of a tree", TypeConverters.toFloat)
    max_bins = Param(Params._dummy(), "max_bins", "bins of a feature, at most 256", TypeConverters.toInt)


class LeafBoosting(Estimator, _Params):
    """Leaf-wise second-order boosting of the vector column ``featuresCol``; null labels must be gone."""

    @keyword_only
    def __init__(self, *, task="regression", rounds=100, max_depth=6, num_leaves=31, learning_rate=0.1, reg_lambda=1.0,
                 min_gain=1e-9, min_rows=5, min_hessian=1e-3, subsample=1.0, colsample=1.0, max_bins=255, seed=42,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        given = self._input_kwargs
        self._setDefault(task="regression", rounds=100, max_depth=6, num_leaves=31, learning_rate=0.1, reg_lambda=1.0, min_gain=1e-9,
                         min_rows=5, min_hessian=1e-3, subsample=1.0, colsample=1.0, max_bins=255, seed=42,
                         featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**given)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def _fit(self, df: DataFrame) -> "LeafBoostingModel":
        how = {p.name: self.getOrDefault(p) for p in self.params}
        x = df.select(vector_to_array(how["featuresCol"]).alias("x"), F.col(how["labelCol"]).cast("double").alias("_y"),
                      F.monotonically_increasing_id().alias("_i"))
        head = x.first()
        if head is None:
            raise ValueError("no rows to fit")
        p, bins = len(head["x"]), min(how["max_bins"], 256)
        cells = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(p)]
        probs = [j / bins for j in range(1, bins)]
        stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.max("_y").alias("top"),
                      *[F.percentile_approx(c, probs, 10_000).alias(f"e{i}") for i, c in enumerate(cells)]).collect()[0]
        edges = [np.unique(np.array(stats[f"e{i}"] or [], float)) for i in range(p)]
        how["n_bins"] = max(len(e) for e in edges) + 1 if p else 1
        n_classes = int(stats["top"]) + 1 if how["task"] == "classification" else 1
        shares = np.zeros(max(n_classes, 2))
        if how["task"] == "classification":
            for r in x.groupBy("_y").count().collect():         # one row a class
                shares[int(r["_y"])] = r["count"] / stats["n"]
        start = start_scores(how["task"], stats["m"], shares)
        frame = dealt(_binned(x, edges), stats["n"]).checkpoint()
        # some 700 jobs of a second take longer than one task, while its rows fit in little memory
        if stats["n"] <= min(SOLO_ROWS, max(100_000, SOLO_BYTES // (p + 24 * len(start) + 16))):
            def run(batches):
                t = pa.Table.from_batches(batches)
                t = t.take(pa.compute.sort_indices(t, [("_i", "ascending")]))
                bins_ = _matrix(t.column("_b"), np.uint8, p)
                rounds, losses = boost_solo(bins_, np.asarray(t.column("_y")), np.asarray(t.column("_i")), start, how)
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(_plain(rounds))]), pa.array([losses], pa.list_(pa.float64()))],
                                                 names=["trees", "losses"])
            got = frame.coalesce(1).mapInArrow(run, "trees string, losses array<double>").collect()[0]
            rounds, losses = json.loads(got["trees"]), list(got["losses"])
        else:
            rounds, losses = boost_spread(frame, stats["n"], p, start, how)
            rounds = _plain(rounds)
        model = LeafBoostingModel([e.tolist() for e in edges], start.tolist(), rounds, losses)
        return self._copyValues(model)


def _plain(rounds) -> list:
    return [[{"f": t.feature, "b": t.bin, "l": t.left, "r": t.right, "v": t.value} for t in trees] for trees in rounds]


def _tree(d: dict) -> Tree:
    t = Tree()
    t.feature, t.bin, t.left, t.right, t.value = d["f"], d["b"], d["l"], d["r"], d["v"]
    return t


def bin_matrix(x: np.ndarray, edges) -> np.ndarray:
    """The bin of each value: how many edges are below it."""
    return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8) \
        if len(edges) else np.zeros((len(x), 0), np.uint8)


def _binned(x: DataFrame, edges) -> DataFrame:
    def run(batches):
        for rb in batches:
            m = np.asarray(rb.column(0).flatten(), float).reshape(rb.num_rows, len(edges))
            b = bin_matrix(m, edges)
            yield pa.RecordBatch.from_arrays([rb.column(2), rb.column(1), pa.array([r.tobytes() for r in b], pa.binary())],
                                             names=["_i", "_y", "_b"])
    return x.mapInArrow(run, "_i long, _y double, _b binary")


class LeafBoostingModel(Model, _Params, MLWritable, MLReadable):
    def __init__(self, edges=None, start=None, rounds=None, losses=None):
        super().__init__()
        self.edges, self.start, self.trees, self.losses = edges or [], start or [0.0], rounds or [], losses or []

    @property
    def featureImportances(self):
        """Share of splits by feature."""
        c = np.zeros(len(self.edges))
        for trees in self.trees:
            for t in trees:
                todo = [0]
                while todo:
                    n = todo.pop()
                    if t["f"][n] >= 0:
                        c[t["f"][n]] += 1
                        todo += [t["l"][n], t["r"][n]]
        return Vectors.dense(c / c.sum() if c.sum() else c)

    def _transform(self, df: DataFrame) -> DataFrame:
        edges, start = [np.array(e) for e in self.edges], np.array(self.start)
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        @pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            m = np.array(x.tolist(), float).reshape(len(x), len(edges))
            bins, raw = bin_matrix(m, edges), np.tile(start, (len(x), 1)).astype(float)
            for trees in shared.value:
                for k, t in enumerate(trees):
                    _tree(t).add_to(raw[:, k], bins)
            return pd.Series(list(raw))

        out = df.withColumn("_raw", score(vector_to_array(self.getOrDefault("featuresCol"))))
        name = self.getOrDefault("predictionCol")
        if self.getOrDefault("task") == "regression":
            return out.withColumn(name, F.col("_raw")[0]).drop("_raw")
        raw = F.col("_raw") if len(start) > 1 else F.array(-F.col("_raw")[0], F.col("_raw")[0])
        out = out.withColumn("_raw", raw)
        best = F.array_position("_raw", F.array_max("_raw")) - 1
        return out.withColumn(name, best.cast("double")).withColumn("rawPrediction", array_to_vector("_raw")).drop("_raw")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext)
        rows = [(-1, json.dumps({"edges": m.edges, "start": m.start, "losses": m.losses}))]
        rows += [(i, json.dumps(t)) for i, t in enumerate(m.trees)]
        spark.createDataFrame(rows, "round int, body string").coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        rows = spark.read.parquet(f"{path}/trees").orderBy("round").collect()
        head = json.loads(rows[0]["body"])
        m = self.cls(head["edges"], head["start"], [json.loads(r["body"]) for r in rows[1:]], head["losses"])
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m
