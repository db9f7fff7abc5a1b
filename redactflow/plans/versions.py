"""Append-only tables in versions, and running totals over range partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write the rows that one version adds.  A repeated write of a version
    replaces it, so a run that was cut short can simply be run again."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read_versions(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows of a versioned table with their ``version`` (those before a given one); empty if nothing is written yet."""
    try:
        rows = spark.read.schema(f"{schema}, version int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, version int")
    return rows if before is None else rows.where(F.col("version") < before)


def in_ranges(df: DataFrame, key: str, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of (key, order) and checkpointed, with its ``range``: the rows of one
    large key lie in as many ranges as they need.  ``df`` is checkpointed before as well: the
    ranges' bounds come from a first pass over it, which would run its whole plan a second time."""
    from redactflow.session import cut_lineage

    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(cut_lineage(df).repartitionByRange(n, key, order).withColumn("range", F.spark_partition_id()))


def running_before(ranged: DataFrame, key: str, order: str, value: Column, how: Callable, add: Callable, name: str) -> DataFrame:
    """Adds ``name``: ``how`` (F.max, F.sum) of ``value`` over the key's earlier rows, null at its first.

    A segmented prefix scan: within a range by a window, and what earlier
    ranges bring from a table with one row for each (key, range).  ``add``
    combines two results.  No task holds all rows of a key.
    """
    held = ranged.withColumn("_v", value)
    brought = (held.groupBy(key, "range").agg(how("_v").alias("_t")).withColumn(
        "_b", how("_t").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("_t"))
    inside = how("_v").over(Window.partitionBy("range", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    both = F.when(F.col("_i").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_i")).otherwise(add(F.col("_i"), F.col("_b")))
    return held.withColumn("_i", inside).join(brought, [key, "range"]).withColumn(name, both).drop("_v", "_i", "_b")
