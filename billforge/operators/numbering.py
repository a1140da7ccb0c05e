"""Places of rows in a total order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: str, order: list[str], settle: Callable[[DataFrame], DataFrame], *, place: str = "place") -> DataFrame:
    """``rows`` with ``place`` (long, gapless from 0 in each ``group``), ordered by the columns ``order``, nulls first.

    Rows are spread by ranges of group and order, so a group of any size lies in as
    many tasks as it needs; a task's rows are counted, and each gets the sum of the
    counts before it. Rows that are equal in ``order`` are told apart by where they
    were read. A null group is a group of its own. ``settle`` writes a table and reads
    it back; ``rows`` is evaluated twice, so it should be a written table itself.
    """
    keys = [*(F.asc_nulls_first(F.col(f"`{c}`")) for c in (group, *order)), F.col("_read")]
    spread = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = spread.withColumn("_at", F.monotonically_increasing_id()).drop("_read")
    spread = settle(spread.withColumn("_part", F.shiftright("_at", 33)))
    counts = spread.groupBy(F.col(f"`{group}`").alias("_group"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    starts = counts.select("_group", "_of", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = spread.join(starts, F.col(f"`{group}`").eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_at") - F.col("_first") + F.col("_before")).alias(place))
