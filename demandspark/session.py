"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys are split at run time from measured partition sizes
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # many-core executors: keep Arrow batches of wide design rows small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # a day's refresh replaces only the partitions it recomputed
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # checkpoint files go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "demandspark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this library to the executors, once a context, so that Python steps load there.

    Needed where only the driver's path names it; executors that have it installed are
    not harmed.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = "demandspark-package.zip"
    if name not in context._python_includes:
        path = os.path.join(context._temp_dir, name)
        with zipfile.ZipFile(path, "w") as out:
            for package in ("demandspark", "checks"):
                for folder, _, files in os.walk(os.path.join(root, package)):
                    for file in files:
                        if file.endswith(".py"):
                            full = os.path.join(folder, file)
                            out.write(full, os.path.relpath(full, root))
            for file in os.listdir(root):
                if file.endswith("_pipeline.py"):
                    out.write(os.path.join(root, file), file)
        context.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Only where it is unset in local mode (tests) a scratch folder is used; on a
    cluster an unset folder is an error, because executors do not share a
    machine-local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="demandspark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps restart from files, not from the source."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
