"""Columns that are computed once however often later expressions use them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose value is fixed here.

    The optimizer merges neighbouring projections and pushes filters below them, so a costly
    expression (a pattern match) used by ten later columns may run ten times per row. It never
    repeats an expression that names the partition it runs in. The condition is always true, so
    values depend on the row alone. The step is a plain projection inside its stage: no shuffle, no
    sort, and unused columns are pruned.
    """
    here = F.spark_partition_id() >= 0
    return df.select("*", *[F.when(here, expr).alias(name) for name, expr in columns.items()])
