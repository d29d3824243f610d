"""Spark sessions and shared settings."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Nothing is done where they find it anyway (it is installed, on PYTHONPATH or
    in the working directory); else Spark hands a copy to them, once a session.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = str(_PACKAGE.parent)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if "site-packages" in root or any(p and os.path.realpath(p) == os.path.realpath(root) for p in known):
        return
    archive = Path(tempfile.mkdtemp(prefix="stridewell-")) / "stridewell.zip"  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))


def local_session(cores: int | str = 8, app: str = "stridewell", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("STRIDEWELL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    It is read from ``spark.checkpoint.dir``.  Only where that is unset, and the
    session runs in a single process, is a local folder made.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = context._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else tempfile.mkdtemp(prefix="stridewell-checkpoint-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder
