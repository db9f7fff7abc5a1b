"""Session helpers: a configured local session for tests and benches, and the
shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "redactflow",
                  driver_memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # the local test tables are single files: deal them to all cores
        .config("spark.redactflow.inputPartitions", str(4 * (os.cpu_count() if cores == "*" else int(cores))))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    A folder is made up only for a ``local[...]`` master whose session names
    none (tests, benches).  Any other master must name one that driver and
    executors share; a machine's own temporary folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except PySparkNotImplementedError:  # Spark Connect: only the server's setting counts
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return folder
    folder = sc.getCheckpointDir() or folder  # the context's own folder within the named one
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="redactflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark context, so that
    they find it wherever they run (Spark's own file server carries the archive)."""
    sc = spark.sparkContext
    if getattr(sc, "_redactflow_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "redactflow"), "zip", os.path.dirname(here), os.path.basename(here)))
    sc._redactflow_shipped = True


def cut_lineage(df):
    """Materialize ``df`` in the shared checkpoint folder (reliable checkpoint)
    so that several branches of a plan read it once instead of recomputing it,
    and a lost executor does not force a recomputation from the sources."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
