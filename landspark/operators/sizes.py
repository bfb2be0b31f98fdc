"""Broadcasts behind a check of their size, and rows spread before costly steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of small rows may be broadcast.
SMALL = 200_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``most`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores: a file of short rows is read by one task or few, however much is then done for each row."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))
