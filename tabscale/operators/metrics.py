"""Evaluation metrics over scored rows: running best, confusion matrix,
classification report (macro and weighted), ROC curve and AUC (mid-ranks),
regression metrics, residuals. All are aggregates or distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .order import prefix_sum, value_ranks


def best_so_far(df: DataFrame, order_col: str, score: str, higher_is_better: bool = True,
                name: str = "best_so_far") -> DataFrame:
    """Running best of ``score`` in ``order_col`` order (distributed prefix maximum)."""
    s = q(score).cast("double")
    x = df.withColumn("_s", s if higher_is_better else -s)
    out = prefix_sum(x, [order_col], "_s", name="_best", op="max")
    best = F.col("_best") if higher_is_better else -F.col("_best")
    return out.withColumn(name, best).drop("_s", "_best")


def confusion_matrix(df: DataFrame, label: str, prediction: str, zero_cells: bool = False) -> DataFrame:
    """(actual, predicted, count) of the cells that occur, null a class of its own. ``zero_cells`` adds the empty cells
    between all observed non-null classes, for a table of few classes."""
    x = df.select(q(label).cast("string").alias("actual"), q(prediction).cast("string").alias("predicted"))
    cnt = x.groupBy("actual", "predicted").agg(F.count(F.lit(1)).cast("long").alias("count"))
    if not zero_cells:
        return cnt
    seen = cnt.select(F.explode(F.array("actual", "predicted")).alias("c")).where("c IS NOT NULL")
    # one row with the list of classes makes the grid
    lists = seen.agg(F.collect_set("c").alias("cs"))
    grid = lists.select(F.explode("cs").alias("actual"), "cs").select("actual", F.explode("cs").alias("predicted"), F.lit(0).alias("z"))
    return cnt.unionByName(grid.select("actual", "predicted", F.col("z").cast("long").alias("count"))).groupBy(
        "actual", "predicted").agg(F.sum("count").cast("long").alias("count"))


def classification_report(df: DataFrame, label: str, prediction: str, digits: int = 6) -> DataFrame:
    """Per class precision, recall, f1, support; plus accuracy, macro avg and weighted avg rows
    (undefined ratios count as 0). Rows without a label are left out; a null prediction is a wrong one.

    Two grouped sums of the cells that occur and a full join by class: no list of classes, no grid."""
    cm = confusion_matrix(df, label, prediction).where("actual IS NOT NULL").checkpoint()
    per = cm.groupBy(F.col("actual").alias("cls")).agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count"))).alias("tp"),
        F.sum("count").alias("support"))
    pred = cm.where("predicted IS NOT NULL").groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("npred"))
    j = per.join(pred, "cls", "full").fillna(0, ["tp", "support", "npred"])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    rows = j.select(F.col("cls").alias("class"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("long").alias("support"), F.col("tp"))
    tot = rows.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.avg("precision").alias("mp"),
                   F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                   (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                   (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                   (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = (F.col("tp") / F.col("n")).cast("double")
    extra = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")))))
    out = rows.drop("tp").unionByName(extra)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def macro_f1(df: DataFrame, label: str, prediction: str) -> float:
    return classification_report(df, label, prediction).filter(F.col("class") == "macro avg").collect()[0]["f1"]


def roc_curve(df: DataFrame, label: str, score: str, positive=None, digits: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (descending) plus the (0, 0) origin
    (no intermediate points dropped). Cumulative counts are distributed prefix sums."""
    pos = positive if positive is not None else df.select(F.max(q(label).cast("string"))).collect()[0][0]
    x = df.select((q(label).cast("string") == F.lit(str(pos))).cast("long").alias("_p"),
                  q(score).cast("double").alias("_s")).filter(F.col("_s").isNotNull())
    g = x.groupBy("_s").agg(F.sum("_p").alias("_tp"), F.sum(1 - F.col("_p")).alias("_fp"))
    tot = x.agg(F.sum("_p").alias("P"), F.sum(1 - F.col("_p")).alias("N")).collect()[0]
    P, N = tot["P"] or 0, tot["N"] or 0
    g = g.withColumn("_neg", -F.col("_s"))
    c1 = prefix_sum(g, ["_neg"], "_tp", name="_ctp")
    c2 = prefix_sum(c1, ["_neg"], "_fp", name="_cfp")
    curve = c2.select(F.col("_s").alias("threshold"),
                      F.round(F.try_divide(F.col("_cfp"), F.lit(float(N))), digits).alias("fpr"),
                      F.round(F.try_divide(F.col("_ctp"), F.lit(float(P))), digits).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(curve)


def roc_auc(df: DataFrame, label: str, score: str, positive=None, digits: int = 6) -> DataFrame:
    """AUC = (R_pos - n_pos (n_pos + 1) / 2) / (n_pos n_neg) with mid-ranks (= trapezoid AUC)."""
    pos = positive if positive is not None else df.select(F.max(q(label).cast("string"))).collect()[0][0]
    x = df.select((q(label).cast("string") == F.lit(str(pos))).cast("long").alias("_p"),
                  q(score).cast("double").alias("_s"))
    vr = value_ranks(x, "_s", weight_cols=["_p"])
    r = vr.agg(F.sum(F.col("_p") * F.col("_midrank")).alias("rp"), F.sum("_p").alias("np_"),
               F.sum(F.col("_t") - F.col("_p")).alias("nn"))
    auc = (F.col("rp") - F.col("np_") * (F.col("np_") + 1) / 2.0) / (F.col("np_") * F.col("nn"))
    return r.select(F.round(auc, digits).alias("roc_auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    y, p = q(actual).cast("double"), q(predicted).cast("double")
    x = df.select(y.alias("y"), p.alias("p")).filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    g = x.agg(F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("mse"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
              F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("ssr"), F.var_pop("y").alias("vy"), F.count(F.lit(1)).alias("n"))
    r2 = 1 - F.try_divide(F.col("ssr"), F.col("vy") * F.col("n"))
    return g.select(F.round(F.sqrt("mse"), digits).alias("rmse"), F.round("mae", digits).alias("mae"),
                    F.round(r2, digits).alias("r2"))


def residuals(df: DataFrame, actual: str, predicted: str, keep=(), digits: int = 6) -> DataFrame:
    return df.select(*[q(k) for k in keep], F.round(q(predicted).cast("double"), digits).alias("predicted"),
                     F.round(q(actual).cast("double"), digits).alias("actual"),
                     F.round(q(actual).cast("double") - q(predicted).cast("double"), digits).alias("residual"))
