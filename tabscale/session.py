"""Session helpers: a test/bench session and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_spark(master: str | None = None, partitions: int = 8, app: str = "tabscale") -> SparkSession:
    """Session for tests and the bench (a cluster job gets its session from spark-submit)."""
    b = (
        SparkSession.builder.master(master or os.environ.get("TABSCALE_MASTER", "local[8]"))
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TABSCALE_DRIVER_MEMORY", "16g"))
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` always wins; a private folder is
    created only when the setting is absent and the master is local (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tabscale-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for tables we write."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabscale-{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint dir and read back (``checkpoint`` runs a plan twice).

    Columns without a type have no Parquet form: such a table is checkpointed."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df.checkpoint()
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_kept", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers (a zip through ``addPyFile``), once per application.

    Workers do not share the driver's ``sys.path``; a job submitted with ``--py-files`` has the same effect."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(root)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tabscale-ship-")), "tabscale.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), top))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
