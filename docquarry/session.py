"""Sessions, and the package's way to the workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(name: str = "docquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys have ``__`` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once a session, where they can't import it by themselves."""
    context = spark.sparkContext
    if getattr(context, "_docquarry_shipped", False) or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="docquarry-")) / "docquarry.zip"  # the driver serves it from there
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(str(path))
    context._docquarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables, ``spark.checkpoint.dir``.

    Where it is unset, one machine (``local``, as in tests) gets a folder of its own
    for the session; a cluster has no folder that would do, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_docquarry_folder"):
        context._docquarry_folder = tempfile.mkdtemp(prefix="docquarry-")
        atexit.register(shutil.rmtree, context._docquarry_folder, ignore_errors=True)
    return context._docquarry_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
