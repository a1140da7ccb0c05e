"""First and last rows of the queue and of pages, and the place of a sheet's next row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claimed(jobs: DataFrame, order: list[str]) -> DataFrame:
    """The first waiting job by ``order`` as it is claimed; a tie must be broken by ``order`` itself. Empty where none waits."""
    return jobs.where("status = 'PENDING'").orderBy(*order).limit(1).withColumn("status", F.lit("PROCESSING"))


def latest(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def selected_period(periods: DataFrame, by: str) -> DataFrame:
    """Year, month and status of each ``by``'s newest active period, or of its newest where none is active."""
    best = F.max_by(F.struct("year", "month", "status"), F.struct(F.col("status") == "ACTIVE", "year", "month"))
    return periods.groupBy(by).agg(best.alias("p")).select(by, "p.*")


def next_row(rows: Column, first: str = "A", last: str = "M") -> list[Column]:
    """Columns next_row and range of a sheet with ``rows`` rows, its heading among them; the heading's row is never taken."""
    n = F.greatest(rows + 1, F.lit(2))
    return [n.alias("next_row"), F.concat(F.lit(first), n.cast("string"), F.lit(f":{last}"), n.cast("string")).alias("range")]
