"""Session defaults and the lineage-cut helper."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. Sizes (shuffle partitions, split bytes) are
# left to the cluster: AQE coalesces small shuffles and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Call-site capture costs several round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per Spark context), so that it need not be
    installed on them."""
    context = spark.sparkContext
    if any("tidemark-package" in name for name in context.listFiles):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")  # on the driver; Spark distributes the file
    context.addPyFile(shutil.make_archive(f"{folder}/tidemark-package", "zip", here.parent,
                                          here.name))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a session in one local
    process (tests, a laptop) may name none and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}: executors "
                         "do not see each other's local folders")
    return tempfile.mkdtemp(prefix="tidemark-")


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there; reliable checkpoints
    survive the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table below the shared folder and continue from there: it is computed once however often it is
    read, and a reader takes only the columns it needs. The folder's owner clears it."""
    path = run_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
