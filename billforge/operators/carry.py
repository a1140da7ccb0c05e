"""The last value before a row, without a window over all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, by: list[str], order: list[str], value: Column, *, bucket: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that isn't null in an earlier row of the same ``by``.

    ``bucket`` cuts the order into stretches (the day of a time, a range of numbers)
    that grow with the first column of ``order``. A window runs in each stretch alone, and
    the stretches hand their last value on, so that a key with many rows is spread
    over as many tasks as it has stretches. Rows equal in ``order`` come in any order; nulls
    in ``by`` are a key, and rows without a bucket a stretch before all others.
    """
    r = rows.withColumn("_v", value).withColumn("_b", bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    ends = r.groupBy(*by, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    handed = ends.select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate([*by, "_b"])), F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    on = F.lit(True)
    for i, c in enumerate([*by, "_b"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_h{i}"))
    return r.join(handed, on).select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce("_in", "_carry").alias(name))
