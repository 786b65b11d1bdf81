"""Session construction and the settings the engine relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "lumenloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's defaults; `conf` wins over them. Checkpoints are removed once nothing refers to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the shared one named by `spark.checkpoint.dir`.

    Only where that is unset and Spark runs inside this very process (tests, a
    laptop) a local folder is chosen; on a cluster its lack is an error, as no
    other executor could read a local one.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "lumenloom-checkpoints")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared)
    return shared


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, for what a query writes and reads again; it is removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lumenloom-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table written to the checkpoint folder: a lineage cut that is stored by column, so that later readers read only what they use."""
    path = scratch(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> str:
    """Sends this package to all executors as a zip file, for clusters on which it isn't installed; returns the file's path."""
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), "lumenloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(Path("lumenloom") / file.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    return target
