"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "duelframe", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators assume. On a cluster, leave `master` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders of local sessions that name none, by application.
_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` where the cluster names one.
    Where that is unset, a local master gets a fresh temporary folder for the session; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_ROOTS:         # the setting itself can't be changed in a running session
        _OWN_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="duelframe-")
    return _OWN_ROOTS[context.applicationId]


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, purpose: str, compact: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs start from the table and
    survive lost executors. `compact`: for large tables; packed more tightly, and the shuffle files behind the table
    go when it is written, not when the driver collects its garbage."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    if not compact:
        df.write.mode("errorifexists").parquet(path)
    else:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
