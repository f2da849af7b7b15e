"""Row numbers within large groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: File numbers of one block; a block is sorted by one task.
BLOCK = 10_000


def positions(df: DataFrame, by: str, order: list[str], block: Column, out: str = "pos", total: str | None = None) -> DataFrame:
    """Adds the 1-based place of each row in its group, and optionally the group's size.

    ``block`` must rise with ``order``: rows are numbered inside a block, blocks are
    counted, and the counts before a block are added. A group that holds a third of all
    rows is thus spread over as many tasks as it has blocks.
    """
    x = df.withColumn("_block", F.coalesce(block, F.lit(None)))
    n = x.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy(F.asc_nulls_first("_block"))) - F.col("_n")
    n = n.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), before.alias("_before"), *([F.sum("_n").over(Window.partitionBy(by)).alias(total)] if total else []))
    x = x.withColumn(out, F.row_number().over(Window.partitionBy(by, "_block").orderBy(*[F.asc_nulls_first(c) for c in order])))
    x = x.join(n, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_b")))
    return x.withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_by", "_b", "_block", "_before")


def number_block(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK)


def name_block(column: str) -> Column:
    """Names fall into blocks by their first letters, which rise with the names."""
    return F.substring(column, 1, 10)
