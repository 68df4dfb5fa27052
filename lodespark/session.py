"""Session helpers: table access and the shared folder for cut lineages."""

from __future__ import annotations

import gc
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per Spark context, so that no path has to be set on them."""
    context = spark.sparkContext
    if not getattr(context, "_lodespark_shipped", False):
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lodespark-")) / "lodespark.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in package.rglob("*.py"):
                archive.write(source, source.relative_to(package.parent))
        context.addPyFile(str(target))
        context._lodespark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``. Only a local master without
    that setting (tests) gets a temporary folder; any other master without it is an error, as executors could not
    read one another's files.
    """
    context = spark.sparkContext
    if (current := context.getCheckpointDir()) is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodespark-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession, rounds: int = 1) -> None:
    """Lets go of what only lineages hold that nothing refers to any more: shuffle files and, where Spark is set to
    clean them, checkpoint files. Spark removes them in the background; further rounds wait for what the first frees."""
    for left in range(rounds, 0, -1):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if left > 1 or rounds > 1:
            time.sleep(0.3)
