"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: they may lack it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_doppel_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="doppel-code-")) / "doppel.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(str(path))
    context._doppel_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="doppel-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")
