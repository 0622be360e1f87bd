"""Session defaults and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "forecourt", **overrides: str) -> SparkSession:
    """Session with the settings the operators expect.

    A cluster brings its own master, memory and shuffle settings; only the semantics that results
    depend on (UTC) and the adaptive features the skew handling relies on are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the cluster names; a private one only in local mode."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="forecourt-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder itself, for tables that must outlive a job."""
    ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's state in reliable storage, so that a lost executor costs no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; they import it for per-batch functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="forecourt-code-")) / "forecourt"), "zip", root.parent, root.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
