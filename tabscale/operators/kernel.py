"""RBF kernel machines on Nystroem features, fitted by Newton steps on summed derivatives.

Landmarks are ``landmarks`` rows by hash (all rows where there are no more, which
makes the kernel exact). A row's features are its kernel values to the landmarks
times the inverse root of the landmarks' own kernel matrix. The objective is
|w|^2 / 2 + C * loss, the intercept free, with the squared hinge for classes (one
weight vector per class, one against the rest) and the squared epsilon-insensitive
loss for numbers. Both are smooth and convex, so each Newton step is one pass: loss,
gradient and Hessian are summed over Arrow batches, then over partitions by a
grouped sum; the step is halved while the objective does not fall.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

STEPS = 50
TOLERANCE = 1e-6        # relative fall of the objective at which the steps end


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(d, 0))


def root_of(kernel: np.ndarray) -> np.ndarray:
    """Columns that turn kernel values to the landmarks into features (directions without weight are left out)."""
    value, vector = np.linalg.eigh(kernel)
    use = value > 1e-10 * max(value.max(), 1e-300)
    return vector[:, use] / np.sqrt(value[use])


def derivatives(task: str, z: np.ndarray, y: np.ndarray, w: np.ndarray, epsilon: float):
    """(loss, gradient, Hessian) sums of one weight vector, the intercept last; z has a column of ones."""
    f = z @ w
    if task == "classification":        # y is -1 or 1
        r = 1 - y * f
        on = r > 0
        return float((r[on] ** 2).sum()), -2 * z[on].T @ (y[on] * r[on]), 2 * z[on].T @ z[on]
    e = f - y
    on = np.abs(e) > epsilon
    r = e[on] - np.sign(e[on]) * epsilon
    return float((r ** 2).sum()), 2 * z[on].T @ r, 2 * z[on].T @ z[on]


def newton(sums, n_weights: int, size: int, C: float):
    """Minimise |w|^2 / 2 + C * loss for each weight vector. ``sums(list of w)`` gives their (loss, gradient, Hessian).
    Returns the weights and the objectives by step."""
    free = np.ones(size)
    free[-1] = 0                        # the intercept has no penalty
    w = [np.zeros(size) for _ in range(n_weights)]
    trace = [[] for _ in range(n_weights)]
    step: list = [None] * n_weights
    scale = [1.0] * n_weights
    trial = [x.copy() for x in w]
    live = set(range(n_weights))
    for _ in range(STEPS):
        if not live:
            break
        for k, (loss, g, h) in zip(sorted(live), sums([trial[k] for k in sorted(live)])):
            value = 0.5 * float((free * trial[k] ** 2).sum()) + C * loss
            if trace[k] and not value <= trace[k][-1]:
                scale[k] /= 2
                if scale[k] < 1e-6:
                    live.discard(k)
                    continue
            else:
                w[k] = trial[k]
                done = bool(trace[k]) and trace[k][-1] - value <= TOLERANCE * abs(value)
                trace[k].append(value)
                if done:
                    live.discard(k)
                    continue
                # a row at the edge of the loss may leave the intercept without curvature
                step[k] = -np.linalg.solve(np.diag(free) + C * h + 1e-9 * np.eye(size), free * w[k] + C * g)
                scale[k] = 1.0
            trial[k] = w[k] + scale[k] * step[k]
    return w, trace


class _Params(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    task = Param(Params._dummy(), "task", "regression or classification (labels 0, 1, ...)", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "weight of the summed loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "error that costs nothing (regression)", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0: 1 / (features * variance of all values)", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "rows that stand for the kernel", TypeConverters.toInt)


class KernelMachine(Estimator, _Params):
    """RBF kernel classifier or regressor of the vector column ``featuresCol``; null labels must be gone."""

    @keyword_only
    def __init__(self, *, task="regression", C=1.0, epsilon=0.1, gamma=0.0, landmarks=128, featuresCol="features", labelCol="label",
                 predictionCol="prediction"):
        super().__init__()
        given = self._input_kwargs
        self._setDefault(task="regression", C=1.0, epsilon=0.1, gamma=0.0, landmarks=128, featuresCol="features", labelCol="label",
                         predictionCol="prediction")
        self._set(**given)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def _fit(self, df: DataFrame) -> "KernelMachineModel":
        spark = df.sparkSession
        task, C, epsilon = (self.getOrDefault(x) for x in ("task", "C", "epsilon"))
        x = df.select(vector_to_array(self.getOrDefault("featuresCol")).alias("x"),
                      F.col(self.getOrDefault("labelCol")).cast("double").alias("_y"))
        m = self.getOrDefault("landmarks")
        marks = [r["x"] for r in x.select("x", F.xxhash64("x").alias("h")).distinct().orderBy("h", "x").limit(m).select("x").collect()]
        if not marks:
            raise ValueError("no rows to fit")
        centres = np.array(marks, float)
        p = centres.shape[1]
        stats = x.select("_y", F.explode("x").alias("v")).agg(F.var_pop("v").alias("v"), F.max("_y").alias("top")).collect()[0]
        gamma = self.getOrDefault("gamma") or (1.0 / (p * stats["v"]) if stats["v"] else 1.0)
        turn = root_of(rbf(centres, centres, gamma))
        size = turn.shape[1] + 1
        classes = int(stats["top"]) + 1 if task == "classification" else 1
        n_weights = classes if classes > 2 else 1
        frame = x.checkpoint()

        def sums(ws):
            shared = spark.sparkContext.broadcast(ws)

            def run(batches):
                total = [[0.0, np.zeros(size), np.zeros((size, size))] for _ in shared.value]
                for rb in batches:
                    rows = np.asarray(rb.column(0).flatten(), float).reshape(rb.num_rows, p)
                    y = np.asarray(rb.column(1), float)
                    for lo in range(0, len(rows), 4096):
                        z = rbf(rows[lo:lo + 4096], centres, gamma) @ turn
                        z = np.column_stack([z, np.ones(len(z))])
                        for k, (part, (which, w)) in enumerate(zip(total, shared.value)):
                            t = y[lo:lo + 4096]
                            t = np.where(t == (which if n_weights > 1 else 1), 1.0, -1.0) if task == "classification" else t
                            a, b, c = derivatives(task, z, t, w, epsilon)
                            part[0] += a
                            part[1] += b
                            part[2] += c
                flat = np.concatenate([np.concatenate([[a], b, c.ravel()]) for a, b, c in total])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "v"])

            got = frame.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
            flat = np.zeros(len(ws) * (1 + size + size * size))
            flat[got["cell"].to_numpy(np.int64)] = got["v"].to_numpy()
            return [(a[0], a[1:1 + size], a[1 + size:].reshape(size, size)) for a in flat.reshape(len(ws), -1)]

        fitted, traces = [], []
        for k in range(n_weights):
            w, trace = newton(lambda ws, k=k: sums([(k, w) for w in ws]), 1, size, C)
            fitted.append(w[0].tolist())
            traces.append(trace[0])
        return self._copyValues(KernelMachineModel(centres.tolist(), turn.tolist(), fitted, float(gamma), traces))


class KernelMachineModel(Model, _Params, MLWritable, MLReadable):
    def __init__(self, centres=None, turn=None, weights=None, width=1.0, objectives=None):
        super().__init__()
        self.centres, self.turn, self.weights, self.width = centres or [], turn or [], weights or [], width
        self.objectives = objectives or []

    def _transform(self, df: DataFrame) -> DataFrame:
        centres, turn, weights, gamma = np.array(self.centres), np.array(self.turn), np.array(self.weights), self.width

        @pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            z = rbf(np.array(x.tolist(), float).reshape(len(x), centres.shape[1]), centres, gamma) @ turn
            return pd.Series(list(z @ weights[:, :-1].T + weights[:, -1]))

        out = df.withColumn("_raw", score(vector_to_array(self.getOrDefault("featuresCol"))))
        name = self.getOrDefault("predictionCol")
        if self.getOrDefault("task") == "regression":
            return out.withColumn(name, F.col("_raw")[0]).drop("_raw")
        out = out.withColumn("_raw", F.col("_raw") if len(weights) > 1 else F.array(-F.col("_raw")[0], F.col("_raw")[0]))
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
        body = json.dumps({"centres": m.centres, "turn": m.turn, "weights": m.weights, "width": m.width, "objectives": m.objectives})
        spark.createDataFrame([(body,)], "body string").write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        m = self.cls(**json.loads(spark.read.parquet(f"{path}/weights").collect()[0]["body"]))
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        return m
