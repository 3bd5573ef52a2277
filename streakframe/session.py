"""What a session needs before Python code of this package can run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it.

    A session that names none gets a temporary one if it runs on one machine; on a cluster that is an error, as executors
    would write to disks of their own.
    """
    root, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    root = shared_root(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint()
