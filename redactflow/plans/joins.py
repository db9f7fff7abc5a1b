"""Join helpers: broadcast a side only behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Session setting: partitions that an input is dealt to (by its key) when read.
SPREAD = "spark.redactflow.inputPartitions"
#: Rows of a task of ``spread_rows``.
ROWS_PER_TASK = 2048


def sized_broadcast(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """``broadcast(df)`` if its rows, written as JSON, take at most ``max_bytes``,
    else ``by_shuffle(df)``.  The sum is a cheap job on a
    dimension table; it is the proof of the size bound that a broadcast needs.
    """
    size = df.select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("n")).agg(F.sum("n")).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else by_shuffle(df)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles, whatever size the planner expects of the two.

    It expects the size of the files that rows come from, of checkpointed rows too.
    A few bytes of a key become a long text, and that many entities, so tables of
    gigabytes pass as a few MB and would be broadcast by way of the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal ``df`` to the number of partitions that the session names in
    ``spark.redactflow.inputPartitions``, by the hash of ``key`` (deterministic
    under task retries).  Without the setting the input keeps its splits and
    nothing is shuffled: that is the choice for a large input.
    """
    n = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n, key) if n else df


def spread_rows(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal the small rows of ``df`` evenly to tasks of at most ``rows_per_task`` before they become long texts.

    A scan is split by its bytes, so a whole table of keys, a few bytes a row,
    arrives in one task however much work its rows are.  Their number (of a
    Parquet table, a sum over its footers) sets the number of tasks, which so grows
    with the input; rows of one key or without a key spread like all others.
    The setting ``spark.redactflow.inputPartitions`` goes first, as in ``spread``.
    """
    if int(df.sparkSession.conf.get(SPREAD, "0")):
        return spread(df, key)
    n = -(-df.count() // rows_per_task)
    return df.repartition(n) if n > 1 else df
