"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Rows are refined in three steps: by normalised length,
then by the hash of a normalised prefix, then by SHA-256 of the whole content.
The first two steps move a few integers per row; only rows whose (length,
prefix) group still has company have their full content hashed for the
decision. That test reaches the scan as a broadcast set of at most
``SLOTS`` hash slots (a proven bound), so no text is ever shuffled. A group is
never collected: it is one aggregate row, joined back (AQE splits a hot key).

Defined cases: a null text is empty; empty texts equal each other; of equal
texts the one with most code points, then smallest doc_id (null last), then
first in scan order stays, so of fully repeated rows exactly one stays; an
empty table gives an empty result; other input columns are ignored here and
returned unchanged by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_id

PREFIX_CHARS = 64
SLOTS = 1 << 17  # upper bound of the broadcast rows


def _normal(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def _slot():
    return F.pmod(F.xxhash64("_len", "_prefix"), F.lit(SLOTS))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: bool = False) -> DataFrame:
    """One row per input row: _rid, _id, keep_id, group_size, kept, and the
    SHA-256 of the normalised text where the refinement needed it (of every row
    with ``digest=True``)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       row_id(docs).alias("_rid"))
    base = base.withColumn("_norm", _normal(F.col("_text")))
    narrow = materialise(base.select(
        F.octet_length("_norm").alias("_len"),
        F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix")), "exact-narrow")
    lengths = materialise(narrow.groupBy("_len").count().where("count > 1").select("_len"), "exact-lengths")
    prefixes = (narrow.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").count().where("count > 1"))
    slots = prefixes.select(_slot().alias("_slot")).distinct().withColumn("_hit", F.lit(True))

    keyed = base.select("_rid", "_id", "_norm", F.length(F.coalesce("_text", F.lit(""))).alias("_points"),
                        F.octet_length("_norm").alias("_len"),
                        F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix"))
    keyed = keyed.withColumn("_slot", _slot()).join(F.broadcast(slots), "_slot", "left")
    full = F.when(F.col("_hit"), F.sha2("_norm", 256))
    cols = ["_rid", "_id", "_points", full.alias("_full")]
    if digest:
        cols.append(F.coalesce(full, F.sha2("_norm", 256)).alias("text_sha256"))
    rows = materialise(keyed.select(*cols), "exact-rows")

    order = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"),
                     F.col("_id").alias("i"), F.col("_rid").alias("r"))
    groups = (rows.where("_full is not null").groupBy("_full")
              .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_best")))
    groups = materialise(groups, "exact-groups")  # a join of two plain shuffles, so AQE can split a hot group
    out = rows.join(groups, "_full", "left")
    alone = F.col("_n").isNull()
    cols = ["_rid", "_id",
            F.when(alone, F.col("_id")).otherwise(F.col("_best.i")).alias("keep_id"),
            F.coalesce(F.col("_n"), F.lit(1)).cast("long").alias("group_size"),
            F.when(alone, F.lit(True)).otherwise(F.col("_rid") == F.col("_best.r")).alias("kept")]
    return out.select(*cols, "text_sha256" if digest else F.col("_full").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with the input's columns."""
    dropped = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("_rid").alias("__llm_rid"))
    return (docs.withColumn("__llm_rid", row_id(docs))
            .join(dropped, "__llm_rid", "left_anti").drop("__llm_rid"))
