"""Tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted to have at most so many rows of a few short columns.
BROADCAST_ROWS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to twice as many partitions as there are cores if it has fewer partitions than cores (one file with one row group is one
    task, whatever its size); a table with more is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def narrow(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join). It is counted for that."""
    return df.hint("broadcast") if df.limit(rows + 1).count() <= rows else df


def held(value: Column) -> Column:
    """A value as one row of a generator, for a select: the optimiser does not carry what made it into later lambdas, where it would be
    worked out anew for each element."""
    return F.explode(F.array(value))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt for a decoder: by a number of partitions, which are not put together as small ones are."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
