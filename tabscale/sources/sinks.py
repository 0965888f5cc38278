"""Sinks: Spark ML model persistence and report tables written as Parquet
into the shared checkpoint location (never a machine-local folder)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_report_tables(spark: SparkSession, sections: dict, base: str | None = None) -> DataFrame:
    """Write one Parquet table per report section; returns (section, path, n_rows)."""
    base = base or scratch_path(spark, "report")
    rows = []
    for name, df in sections.items():
        path = f"{base}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((name, path, spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "section string, path string, n_rows long")
