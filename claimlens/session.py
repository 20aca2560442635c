"""Session settings and durable scratch space."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for scripts and tests; on a cluster the submitter's settings win."""
    b = (
        SparkSession.builder.appName("claimlens")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, so that kernels can be loaded there."""
    sc = spark.sparkContext
    if getattr(sc, "_claimlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="claimlens-package-")
    archive = shutil.make_archive(os.path.join(folder, "claimlens"), "zip", root, "claimlens")
    sc.addPyFile(archive)
    sc._claimlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a fresh local one where none is set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="claimlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), "claimlens", f"{name}-{uuid.uuid4().hex}")


# The checkpoints made in each open `freed` block of a thread.
_open = threading.local()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: the rows survive executor loss.

    The files stay until the surrounding `freed` block ends; outside of one, until Spark
    collects them (`spark.cleaner.referenceTracking.cleanCheckpoints`) or the folder goes.
    """
    shared_dir(df.sparkSession)
    stored = df.checkpoint(eager=True)
    for made in getattr(_open, "blocks", []):
        file = stored._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            made.append(file.get())
    return stored


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can write one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def freed(spark: SparkSession):
    """Delete the checkpoints made inside, at the end: for work whose result is written by then."""
    made: list[str] = []
    blocks = _open.blocks = getattr(_open, "blocks", [])
    blocks.append(made)
    try:
        yield
    finally:
        blocks.remove(made)
        for path in made:
            drop_path(spark, path)
