"""Random forests grown to pure leaves (or ``min_rows``), of any number of rows.

Every tree sees each row with a Poisson(1) weight, a function of the row's number
and the tree, and tries a random subset of features at each node. The gain of a
split is the fall of the weighted squared error of the label, or of the one-hot
classes (the Gini impurity), from sums per bin.

Nodes with more than ``task_rows`` rows are split level by level: one pass over the
table sums all trees' open nodes, and the best bin of every (tree, node, feature)
comes back. A node below that goes with its rows to one task, which grows the
whole subtree, so depth needs no limit and no task holds more than that. Tables
of at most ``task_rows`` rows start there. The model itself is held by the driver:
full depth gives about as many nodes as rows, which ``min_rows`` bounds.
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

from .boosting import Tree, _binned, _matrix, bin_matrix, dealt

TASK_ROWS = 100_000
_CUTS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])    # P(X <= k) of Poisson(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights_of(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by its number) is in the tree's sample."""
    key = np.uint64((seed * 1_000_003 + tree * 7919 + 1) % (1 << 63))
    u = (_mix(_mix(rows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ _mix(np.array([key]))) >> np.uint64(11)).astype(np.float64)
    return np.searchsorted(_CUTS, u / (1 << 53), side="left")


def subset(tree: int, node: int, how: dict, p: int, rng: np.random.RandomState | None = None) -> np.ndarray:
    """The features a node tries; ``node`` is its number in a full binary tree, whoever grows it. A generator that is
    given is seeded anew, which takes a tenth of the time of a new one."""
    rng = rng or np.random.RandomState(0)
    rng.seed([how["seed"] % (1 << 31), tree, node % (1 << 31), (node >> 31) % (1 << 31)])
    return rng.permutation(p)[:how["tries"]]


def targets(y: np.ndarray, classes: int) -> np.ndarray:
    """The label as columns: itself, or one column a class."""
    if not classes:
        return y[:, None]
    out = np.zeros((len(y), classes))
    out[np.arange(len(y)), y.astype(int)] = 1
    return out


def bin_sums(bins: np.ndarray, slot: np.ndarray, n_slots: int, t: np.ndarray, w: np.ndarray, n_bins: int) -> np.ndarray:
    """(slots, features, bins, [weighted targets..., weight, rows]); rows with slot -1 take no part."""
    use = slot >= 0
    bins, slot, t, w = bins[use], slot[use], t[use], w[use]
    k = t.shape[1]
    out = np.zeros((n_slots, bins.shape[1], n_bins, k + 2))
    for f in range(bins.shape[1]):
        cell = slot * n_bins + bins[:, f]
        for j in range(k + 2):
            v = t[:, j] * w if j < k else w if j == k else None
            out[:, f, :, j] = np.bincount(cell, weights=v, minlength=n_slots * n_bins).reshape(n_slots, n_bins)
    return out


def best_split(sums: np.ndarray, min_rows: int):
    """(gain, bin) of the best split of (..., bins, targets + 2)."""
    left = np.cumsum(sums, axis=-2)
    total = left[..., -1:, :]
    right = total - left

    def quality(x):
        return (x[..., :-2] ** 2).sum(axis=-1) / np.maximum(x[..., -2], 1e-300)
    gain = quality(left) + quality(right) - quality(total)
    ok = np.minimum(left[..., -1], right[..., -1]) >= max(min_rows, 1)
    gain = np.where(ok, gain, -np.inf)
    at = gain.argmax(axis=-1)
    return np.take_along_axis(gain, at[..., None], -1)[..., 0], at


def _deeper(node: int, how: dict) -> bool:
    """Whether a node may be split (the root, node 1, has depth 0)."""
    return not how["max_depth"] or node.bit_length() - 1 < how["max_depth"]


def grow_whole(bins: np.ndarray, t: np.ndarray, w: np.ndarray, tree: int, top: int, how: dict) -> list[list]:
    """The subtree of node ``top``: rows [node, feature, bin, values, gain], feature -1 for a leaf."""
    out, rng = [], np.random.RandomState(0)
    todo = [(top, np.arange(len(w)))]
    while todo:
        node, at = todo.pop()
        value = (t[at] * w[at, None]).sum(axis=0) / w[at].sum()
        pure = (t[at] == t[at[0]]).all()
        best = (1e-12, -1, 0)
        if not pure and len(at) >= max(2 * how["min_rows"], how["min_split"]) and _deeper(node, how):
            # features in turn until some split helps, the subset first
            order = subset(tree, node, {**how, "tries": bins.shape[1]}, bins.shape[1], rng)
            for i, f in enumerate(order):
                if i >= how["tries"] and best[1] >= 0:
                    break
                sums = bin_sums(bins[at][:, [f]], np.zeros(len(at), int), 1, t[at], w[at], how["n_bins"])[0, 0]
                gain, b = best_split(sums, how["min_rows"])
                if gain > best[0]:
                    best = (float(gain), int(f), int(b))
        if best[1] < 0:
            out.append([node, -1, 0, value.tolist(), 0.0])
            continue
        out.append([node, best[1], best[2], value.tolist(), best[0]])
        over = bins[at, best[1]] > best[2]
        todo += [(2 * node, at[~over]), (2 * node + 1, at[over])]
    return out


def grow_classes(bins: np.ndarray, t: np.ndarray, w: np.ndarray, tree: int, top: int, how: dict) -> list[list]:
    """The nodes of ``grow_whole`` for classes, all of a depth at once. Weights and class sums are whole numbers, which add
    up alike in any order; so rows of equal bins are one row with their sums."""
    p, k = bins.shape[1], t.shape[1]
    order = np.lexsort(bins.T) if p else np.arange(len(w))
    bins = bins[order]
    new = np.flatnonzero(np.append(True, (bins[1:] != bins[:-1]).any(axis=1)))
    sums = np.add.reduceat(np.column_stack([t * w[:, None], w, np.ones(len(w))])[order], new, axis=0)
    bins = bins[new]

    def quality(x):
        return (x[..., :-2] ** 2).sum(axis=-1) / np.maximum(x[..., -2], 1e-300)
    out, nodes, rng = [], [top], np.random.RandomState(0)
    row, slot = np.arange(len(bins)), np.zeros(len(bins), np.int64)       # rows in the order of their node's place
    while nodes:
        m = len(nodes)
        total = np.add.reduceat(sums[row], np.searchsorted(slot, np.arange(m)), axis=0)
        value = total[:, :k] / total[:, k:k + 1]
        best, feature, at = np.full(m, 1e-12), np.full(m, -1), np.zeros(m, np.int64)
        able = ((total[:, :k] > 0).sum(axis=1) > 1) & (total[:, -1] >= max(2 * how["min_rows"], how["min_split"]))
        able &= np.array([_deeper(node, how) for node in nodes])
        turns = np.zeros((m, p), np.int64)
        for i in np.flatnonzero(able):
            turns[i] = subset(tree, nodes[i], {**how, "tries": p}, p, rng)
        for i in range(p):      # features in turn until some split helps, the subset first
            who = able & ((feature < 0) | (i < how["tries"]))
            if not who.any():
                break
            r, s = row[who[slot]], slot[who[slot]]
            cell = s * 256 + bins[r, turns[s, i]]
            by = np.argsort(cell, kind="stable")
            cell = cell[by]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            part, cell = np.add.reduceat(sums[r[by]], first, axis=0), cell[first]
            s = cell >> 8
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            many = np.diff(np.append(first, len(s)))
            left = np.cumsum(part, axis=0)
            left -= np.repeat(left[first] - part[first], many, axis=0)
            right = total[s] - left
            gain = quality(left) + quality(right) - quality(total[s])
            gain = np.where(np.minimum(left[:, -1], right[:, -1]) >= max(how["min_rows"], 1), gain, -np.inf)
            most = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(most, many))
            hit = hit[np.unique(s[hit], return_index=True)[1]]              # the lowest bin of the greatest gain
            hit = hit[gain[hit] > best[s[hit]]]
            best[s[hit]], feature[s[hit]], at[s[hit]] = gain[hit], turns[s[hit], i], cell[hit] & 255
        out += [[node, f, b, v, g if f >= 0 else 0.0]
                for node, f, b, v, g in zip(nodes, feature.tolist(), at.tolist(), value.tolist(), best.tolist())]
        go = feature[slot] >= 0
        row, slot = row[go], slot[go]
        child = 2 * (np.cumsum(feature >= 0) - 1)[slot] + (bins[row, feature[slot]] > at[slot])
        by = np.argsort(child, kind="stable")
        row, slot = row[by], child[by]
        nodes = [c for node, f in zip(nodes, feature.tolist()) if f >= 0 for c in (2 * node, 2 * node + 1)]
    return out


def _as_tree(rows: list[list]) -> tuple[Tree, list]:
    """Nodes numbered as in a full binary tree (root 1) as arrays, with their values and gains."""
    place = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0].bit_length(), r[0])))}
    t = Tree()
    n = len(rows)
    t.feature, t.bin, t.left, t.right, t.value = [-1] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    extra = [None] * n
    for node, f, b, value, gain in rows:
        i = place[node]
        t.feature[i], t.bin[i], extra[i] = f, b, (value, gain)
        if f >= 0:
            t.left[i], t.right[i] = place[2 * node], place[2 * node + 1]
    return t, extra


class _Params(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    task = Param(Params._dummy(), "task", "regression or classification (labels 0, 1, ...)", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    min_rows = Param(Params._dummy(), "min_rows", "least rows of a leaf", TypeConverters.toInt)
    min_split = Param(Params._dummy(), "min_split", "least rows of a node that is split", TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "deepest leaf; 0: no limit", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of features a node tries; 0: the root of their number for classes, all for numbers",
                  TypeConverters.toFloat)
    max_bins = Param(Params._dummy(), "max_bins", "bins of a feature, at most 256", TypeConverters.toInt)
    task_rows = Param(Params._dummy(), "task_rows", "rows of a node that one task takes over", TypeConverters.toInt)


class Forest(Estimator, _Params):
    """Random forest on the vector column ``featuresCol``; null labels must be gone. NaN is larger than any value."""

    @keyword_only
    def __init__(self, *, task="regression", trees=100, min_rows=1, min_split=2, max_depth=0, share=0.0, max_bins=255, task_rows=TASK_ROWS, seed=42,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        given = self._input_kwargs
        self._setDefault(task="regression", trees=100, min_rows=1, min_split=2, max_depth=0, share=0.0, max_bins=255, task_rows=TASK_ROWS, seed=42,
                         featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**given)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def _fit(self, df: DataFrame) -> "ForestModel":
        how = {p.name: self.getOrDefault(p) for p in self.params}
        x = df.select(vector_to_array(how["featuresCol"]).alias("x"), F.col(how["labelCol"]).cast("double").alias("_y"),
                      F.monotonically_increasing_id().alias("_i"))
        head = x.first()
        if head is None:
            raise ValueError("no rows to fit")
        p, bins = len(head["x"]), min(how["max_bins"], 256)
        probs = [j / bins for j in range(1, bins)]
        stats = x.agg(F.count(F.lit(1)).alias("n"), F.max("_y").alias("top"), *[
            F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), probs, 10_000).alias(f"e{i}") for i in range(p)]).collect()[0]
        edges = [np.unique(np.array(stats[f"e{i}"] or [], float)) for i in range(p)]
        how["n_bins"] = max([len(e) for e in edges] + [0]) + 1
        how["classes"] = int(stats["top"]) + 1 if how["task"] == "classification" else 0
        share = how["share"] or (np.sqrt(p) / p if how["classes"] else 1.0)
        how["tries"] = max(1, int(round(share * p)))
        frame = dealt(_binned(x, edges), stats["n"]).checkpoint()
        rows = _grow_all(frame, p, how)
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r[0], []).append(list(r[1:]))
        model = ForestModel([e.tolist() for e in edges], how["classes"], [_plain(by[k]) for k in sorted(by)])
        return self._copyValues(model)


def _plain(rows: list[list]) -> dict:
    t, extra = _as_tree(rows)
    return {"f": t.feature, "b": t.bin, "l": t.left, "r": t.right, "v": [e[0] for e in extra], "g": [e[1] for e in extra]}


def _packed(d: dict) -> tuple:
    """A tree as arrays: a node takes 16 bytes and its values in a Python worker, not a few hundred."""
    return (*(np.array(d[k], np.int32) for k in "fblr"), np.array(d["v"], float))


def _find(nodes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Place of each row's node in the sorted ``nodes``, -1 where it is not among them."""
    at = np.searchsorted(nodes, node)
    hit = at < len(nodes)
    hit[hit] = nodes[at[hit]] == node[hit]
    return np.where(hit, at, -1)


def _route(bins: np.ndarray, splits: dict[int, tuple]) -> np.ndarray:
    """Each row's node under the splits {node: (feature, bin)}, from the root 1."""
    node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    keys = np.array(sorted(splits), np.int64)
    f, b = (np.array([splits[k][j] for k in keys.tolist()], np.int64) for j in (0, 1))
    while len(keys):
        at = _find(keys, node)
        on = np.flatnonzero(at >= 0)
        if not len(on):
            break
        node[on] = 2 * node[on] + (bins[rows[on], f[at[on]]] > b[at[on]])
    return node


def _grow_all(frame: DataFrame, p: int, how: dict) -> list[tuple]:
    """(tree, node, feature, bin, values, gain) of all trees' nodes."""
    spark, n_bins, seed = frame.sparkSession, how["n_bins"], how["seed"]
    k = max(how["classes"], 1)
    splits: dict[int, dict] = {t: {} for t in range(how["trees"])}
    done: list[tuple] = []
    open_ = {(t, 1): None for t in range(how["trees"])}      # nodes of unknown size
    small: list[tuple[int, int]] = []
    n = frame.count()
    if n <= how["task_rows"]:
        small, open_ = list(open_), {}
    while open_:
        asked = sorted(open_)
        shared = spark.sparkContext.broadcast((splits, asked))

        def run(batches):
            splits_, asked_ = shared.value
            of, base = {}, {}
            for i, (tree, node) in enumerate(asked_):
                of.setdefault(tree, []).append(node)
                base.setdefault(tree, i)
            sums = np.zeros((len(asked_), p, n_bins, k + 2))
            for rb in batches:
                rows, bins = np.asarray(rb.column(0)), _matrix(rb.column(2), np.uint8, p)
                t = targets(np.asarray(rb.column(1)), how["classes"])
                for tree in sorted(of):
                    w = weights_of(rows, tree, seed)
                    slot = _find(np.array(of[tree]), _route(bins, splits_[tree]))
                    slot = np.where((slot >= 0) & (w > 0), slot, -1)
                    sums[base[tree]:base[tree] + len(of[tree])] += bin_sums(bins, slot, len(of[tree]), t, w.astype(float), n_bins)
            flat = sums.reshape(-1, k + 2)
            some = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(flat[some, j]) for j in range(k + 2))],
                                             names=["cell", *(f"s{j}" for j in range(k + 2))])

        def best(key, pdf):
            one = np.zeros((n_bins, k + 2))
            one[pdf["cell"].to_numpy() % n_bins] = pdf[[f"s{j}" for j in range(k + 2)]].to_numpy()
            gain, at = best_split(one, how["min_rows"])
            total = one.sum(axis=0)
            return pd.DataFrame({"f": [key[0]], "gain": [float(gain)], "at": [int(at)], "total": [total.tolist()]})

        names = [f"s{j}" for j in range(k + 2)]
        cells = frame.mapInArrow(run, "cell long, " + ", ".join(f"{c} double" for c in names)).groupBy("cell").agg(
            *[F.sum(c).alias(c) for c in names])
        got = cells.groupBy(F.floor(F.col("cell") / n_bins).cast("long").alias("f")).applyInPandas(
            best, "f long, gain double, at long, total array<double>").collect()     # one row per (tree, node, feature)
        found: dict = {}
        for r in got:
            i, f = divmod(r["f"], p)
            found.setdefault(asked[i], {})[f] = (r["gain"], r["at"], np.array(r["total"]))
        open_ = {}
        for (tree, node), by in found.items():
            total = next(iter(by.values()))[2]
            if node > 1 and total[-1] <= how["task_rows"]:
                small.append((tree, node))
                continue
            order = subset(tree, node, {**how, "tries": p}, p)
            tried = order[:how["tries"]]
            if all(by[f][0] <= 1e-12 for f in tried):
                tried = order
            f = max(tried, key=lambda f: by[f][0])
            gain, at, _ = by[f]
            value = (total[:k] / total[k]).tolist()
            if gain <= 1e-12 or total[-1] < how["min_split"] or not _deeper(node, how):
                done.append((tree, node, -1, 0, value, 0.0))
                continue
            splits[tree][node] = (int(f), int(at))
            done.append((tree, node, int(f), int(at), value, float(gain)))
            open_ |= {(tree, 2 * node): None, (tree, 2 * node + 1): None}
    if small:
        shared = spark.sparkContext.broadcast((splits, set(small)))

        def deal(batches):
            splits_, small_ = shared.value
            of: dict = {}
            for tree, node in sorted(small_):
                of.setdefault(tree, []).append(node)
            for rb in batches:
                rows, bins = np.asarray(rb.column(0)), _matrix(rb.column(2), np.uint8, p)
                for tree, nodes in of.items():
                    w, node = weights_of(rows, tree, seed), _route(bins, splits_[tree])
                    at = np.flatnonzero((w > 0) & (_find(np.array(nodes), node) >= 0))
                    if len(at):
                        take = pa.array(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), tree, np.int32)), pa.array(node[at]), rb.column(0).take(take), rb.column(1).take(take),
                             rb.column(2).take(take), pa.array(w[at].astype(np.int32))], names=["tree", "node", "_i", "_y", "_b", "w"])

        def finish(key, pdf):
            pdf = pdf.sort_values("_i")
            bins = np.frombuffer(b"".join(pdf["_b"]), np.uint8).reshape(len(pdf), p)
            grow = grow_classes if how["classes"] else grow_whole
            got = grow(bins, targets(pdf["_y"].to_numpy(float), how["classes"]), pdf["w"].to_numpy(float), int(key[0]), int(key[1]), how)
            return pd.DataFrame({"tree": [int(key[0])], "body": [json.dumps(got)]})

        dealt = frame.mapInArrow(deal, "tree int, node long, _i long, _y double, _b binary, w int")
        for r in dealt.groupBy("tree", "node").applyInPandas(finish, "tree int, body string").collect():
            done += [(r["tree"], *x) for x in json.loads(r["body"])]
    return done


class ForestModel(Model, _Params, MLWritable, MLReadable):
    def __init__(self, edges=None, classes=0, trees=None):
        super().__init__()
        self.edges, self.classes, self.nodes = edges or [], classes, trees or []

    @property
    def featureImportances(self):
        """Share of the gains by feature."""
        c = np.zeros(len(self.edges))
        for t in self.nodes:
            for f, g in zip(t["f"], t["g"]):
                if f >= 0:
                    c[f] += g
        return Vectors.dense(c / c.sum() if c.sum() else c)

    def _transform(self, df: DataFrame) -> DataFrame:
        edges = [np.array(e) for e in self.edges]
        shared = df.sparkSession.sparkContext.broadcast([_packed(d) for d in self.nodes])

        @pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            bins = bin_matrix(np.array(x.tolist(), float).reshape(len(x), len(edges)), edges)
            total = 0.0
            for feature, at, left, right, value in shared.value:
                t = Tree()
                t.feature, t.bin, t.left, t.right = feature, at, left, right
                total = total + value[t.leaf_of(bins)]
            return pd.Series(list(total / len(shared.value)))

        out = df.withColumn("_raw", score(vector_to_array(self.getOrDefault("featuresCol"))))
        name = self.getOrDefault("predictionCol")
        if not self.classes:
            return out.withColumn(name, F.col("_raw")[0]).drop("_raw")
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
        rows = [(-1, json.dumps({"edges": m.edges, "classes": m.classes}))] + [(i, json.dumps(t)) for i, t in enumerate(m.nodes)]
        spark.createDataFrame(rows, "tree int, body string").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        m = self.cls(**json.loads(rows[0]["body"]), trees=[json.loads(r["body"]) for r in rows[1:]])
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m
