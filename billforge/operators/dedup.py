"""First-wins duplicate detection by content hash and by business key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_duplicates(rows: DataFrame, keys: list[str], order: Column, *, first: str = "first_row", flag: str = "is_duplicate") -> DataFrame:
    """``rows`` with the smallest ``order`` of their key and whether they come later.

    A minimum per key is combined before it is shuffled and joined back, so that a
    key with many rows never meets in one sort; null keys equal one another.
    """
    ranked = rows.withColumn("_order", order)
    firsts = ranked.groupBy(*keys).agg(F.min("_order").alias(first))
    firsts = firsts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), first)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranked.join(firsts, on)
    return joined.withColumn(flag, F.col("_order") > F.col(first)).drop("_order", *(f"_k{i}" for i in range(len(keys))))
