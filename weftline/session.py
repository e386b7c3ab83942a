"""Session defaults and the shared-storage checkpoint directory."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew handling and a fixed UTC zone.

    Cluster sizing (executors, memory, ``spark.checkpoint.dir``) is left to spark-submit;
    ``conf`` overrides anything set here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a fresh folder in local mode only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif re.match(r"local(\[|$)", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage stops here and survives executor loss.

    A checkpoint keeps the size that was guessed for its plan. In a loop that joins its own rounds the guesses multiply, until
    planning itself takes for ever; so the rows are taken up as a table of unknown size, and adaptive execution measures them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def kept(df: DataFrame) -> DataFrame:
    """Rows written once as Parquet to the shared folder, so that readers fetch only the columns they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-package-")) / root.name), "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._weftline_shipped = True
