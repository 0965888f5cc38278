"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a in [0, 1] and
normalised: a = 1 keeps the natural mix, a = 0 gives every source the same
weight. ``solve_exponent`` bisects a: a target entropy asks for the largest a
that is flat enough, a repetition limit for the smallest a whose largest number
of epochs stays in the limit; where both are given the limit wins.

The weights become token budgets. By default the total is the smallest one at
which no source falls below one epoch, so every document is used. A source's
budget is realised as whole epochs plus a prefix of one more. Every epoch has its
own permutation of the documents: a place in [0, 1) by a hash of seed, epoch and
row. The prefix takes whole blocks of its epoch's permutation, one of ``BLOCKS``,
by their token sums and cuts only one block row by row, so a hot source is never
sorted as one group. In the mix copy c of a row stands at (c + its place in epoch
c) / epochs, so all sources run out together; ``mix`` deals that line into blocks
and writes every block in its order.

Defined cases: null and empty texts have 0 tokens; a null source is a source of
its own; a source without tokens gets weight 0 and one epoch; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_id

TARGET_ENTROPY = 0.9  # of the logarithm of the number of sources
MAX_EPOCHS = 1.5      # repetition limit of the most repeated source
BLOCKS = 4096
SEED = 17
HALVINGS = 40
DEPTH = 4             # halvings answered by one Spark job


def _halvings(lo: float, hi: float, depth: int) -> list[float]:
    """All middles that ``depth`` halvings of [lo, hi] can ask for, in order."""
    n = 1 << depth
    return [lo + (hi - lo) * i / n for i in range(1, n)]


def _bisect(evaluate, ok) -> float:
    """The border in [0, 1] of a predicate that holds from some point on. ``evaluate`` gives the
    state of many exponents at once, so one Spark job serves ``DEPTH`` halvings."""
    if ok(0.0, evaluate([0.0])[0]):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(HALVINGS // DEPTH):
        at = _halvings(lo, hi, DEPTH)
        known = dict(zip(at, evaluate(at)))
        for _ in range(DEPTH):
            mid = min(known, key=lambda x: abs(x - (lo + hi) / 2))
            lo, hi = (lo, mid) if ok(mid, known[mid]) else (mid, hi)
    return hi


def _powers(shares: DataFrame, at: list[float]) -> list[tuple[float, float]]:
    """(sum of p^a, sum of p^a ln p) over the sources for each exponent: one aggregate row."""
    p = F.col("p")
    cols = [f(F.pow(p, F.lit(a))) for a in at for f in (F.sum, lambda x: F.sum(x * F.log(p)))]
    row = shares.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(at))]


def solve_exponent(shares: DataFrame, target_entropy: float | None = TARGET_ENTROPY,
                   max_epochs: float | None = MAX_EPOCHS, total: float | None = None) -> float:
    """Exponent for the target entropy (share of the log of the source count) and the repetition
    limit; ``shares`` has one row (p, t) per source with tokens and never leaves Spark."""
    got = shares.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least"), F.max("p").alias("most"), F.sum("t").alias("t")).first()
    if got["n"] < 2:
        return 1.0

    def evaluate(at):
        return _powers(shares, at)

    def entropy(a, s):
        return math.log(s[0]) - a * s[1] / s[0]

    def most_epochs(a, s):  # the smallest source is repeated most
        scale = got["most"] ** (1 - a) if total is None else total / got["t"] / s[0]
        return got["least"] ** (a - 1) * scale

    a = 1.0 if target_entropy is not None else 0.0
    if target_entropy is not None:
        want = target_entropy * math.log(got["n"])
        if entropy(1.0, evaluate([1.0])[0]) < want:
            a = _bisect(evaluate, lambda x, s: entropy(x, s) < want)
    if max_epochs is not None and most_epochs(a, evaluate([a])[0]) > max_epochs:
        a = max(a, _bisect(evaluate, lambda x, s: most_epochs(x, s) <= max_epochs * (1 + 1e-9)))
    return a


def _place(seed: int, epoch, rid):
    """Place of a row in the permutation of an epoch, in 2^40 steps."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch, rid), F.lit(1 << 40))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             target_entropy: float | None = TARGET_ENTROPY, max_epochs: float | None = MAX_EPOCHS,
             total: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per input row: _rid, _id, _source, n_tokens, weight, epochs, copies, mix_pos.

    ``copies`` is how often the mix uses the row, ``mix_pos`` its place in the permutation of the last, partial epoch."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    n_tokens = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1)
    stats = docs.select(row_id(docs).alias("_rid"), F.col(id_col).alias("_id"),
                        F.col(source_col).cast("string").alias("_source"), n_tokens.cast("long").alias("n_tokens"))
    stats = materialise(stats, "mix-stats")

    per_source = materialise(stats.groupBy(F.col("_source").alias("_s")).agg(F.sum("n_tokens").cast("double").alias("t")), "mix-sources")
    everything = per_source.agg(F.sum("t")).first()[0] or 0.0
    shares = per_source.where("t > 0").select((F.col("t") / everything).alias("p"), "t") if everything else None
    a = solve_exponent(shares, target_entropy, max_epochs, total) if everything else 1.0
    z = _powers(shares, [a])[0][0] if everything else 1.0
    p = F.col("t") / (everything or 1.0)
    weight = F.when(F.col("t") > 0, F.pow(p, F.lit(a)) / z).otherwise(0.0)
    # by default the least repeated source, the largest one, gets one epoch
    if total is None:
        most = shares.agg(F.max("p")).first()[0] if everything else 1.0
        epochs = F.pow(p / most, F.lit(a - 1))
    else:
        epochs = weight * total / F.col("t")
    epochs = F.when(F.col("t") > 0, epochs).otherwise(1.0)
    plan = per_source.select("_s", weight.alias("weight"), epochs.alias("epochs"), "t")
    whole = F.floor(F.col("epochs") + 1e-9)
    plan = plan.select("_s", "weight", "epochs", whole.alias("_whole"),
                       F.round(F.greatest(F.col("epochs") - whole, F.lit(0.0)) * F.col("t")).cast("long").alias("_rest"))
    rows = stats.join(plan, stats["_source"].eqNullSafe(plan["_s"])).drop("_s")
    rows = rows.withColumn("_u", _place(seed, F.col("_whole").cast("long"), F.col("_rid")))
    rows = rows.withColumn("_blk", F.floor(F.col("_u") / ((1 << 40) // BLOCKS)).cast("int"))

    # the partial epoch: whole blocks by their token sums, one block row by row
    blocks = rows.where("_rest > 0").groupBy("_source", "_blk").agg(F.sum("n_tokens").alias("_bt"), F.first("_rest").alias("_r"))
    upto = Window.partitionBy("_source").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)  # <= BLOCKS rows
    blocks = blocks.withColumn("_end", F.sum("_bt").over(upto)).select(
        F.col("_source").alias("_s"), F.col("_blk").alias("_b"), (F.col("_end") - F.col("_bt")).alias("_start"),
        F.when(F.col("_end") <= F.col("_r"), "in").when(F.col("_end") - F.col("_bt") >= F.col("_r"), "out")
        .otherwise("cut").alias("_fate"))
    rows = rows.join(blocks, rows["_source"].eqNullSafe(blocks["_s"]) & (rows["_blk"] == blocks["_b"]), "left").drop("_s", "_b")
    inside = Window.partitionBy("_source", "_blk").orderBy("_u", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where("_fate = 'cut'").withColumn("_cum", F.col("_start") + F.sum("n_tokens").over(inside))
    rest = rows.where("_fate is null or _fate <> 'cut'").withColumn(
        "_cum", F.when(F.col("_fate") == "in", F.lit(0)).otherwise(F.lit(None)).cast("long"))
    both = cut.unionByName(rest)
    taken = F.coalesce((F.col("_cum") <= F.col("_rest")).cast("long"), F.lit(0))
    return both.select("_rid", "_id", "_source", "n_tokens", "weight", "epochs",
                       (F.col("_whole") + taken).alias("copies"), (F.col("_u") / float(1 << 40)).alias("mix_pos"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
        **targets) -> DataFrame:
    """The input rows, each as often as the mix uses it and in the mix's order within blocks, with the input's columns."""
    copies = mix_plan(docs, id_col, text_col, source_col, seed=seed, **targets).select(
        F.col("_rid").alias("__llm_rid"), F.col("copies").alias("__llm_copies"), F.col("epochs").alias("__llm_epochs"))
    rows = docs.withColumn("__llm_rid", row_id(docs)).join(copies, "__llm_rid").where("__llm_copies > 0")
    rows = rows.withColumn("__llm_copy", F.explode(F.expr("sequence(0L, __llm_copies - 1)")))
    at = (F.col("__llm_copy") + _place(seed, F.col("__llm_copy"), F.col("__llm_rid")) / float(1 << 40)) / F.col("__llm_epochs")
    rows = rows.withColumn("__llm_at", at).withColumn("__llm_block", F.floor(at * BLOCKS))
    rows = rows.repartition("__llm_block").sortWithinPartitions("__llm_block", "__llm_at", "__llm_rid")
    return rows.drop("__llm_rid", "__llm_copies", "__llm_epochs", "__llm_copy", "__llm_at", "__llm_block")
