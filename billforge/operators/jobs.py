"""The document queue: new files, retries, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_files(files: DataFrame, invoices: DataFrame, jobs: DataFrame, *, tenant: str, file: str, batch: str, order: list[str]) -> DataFrame:
    """The first ``batch`` (a column) files of each tenant for which that tenant has neither an invoice nor a job in any state."""
    key = [tenant, file]
    fresh = files.join(invoices, key, "left_anti").join(jobs, key, "left_anti")
    return fresh.withColumn("position", F.row_number().over(Window.partitionBy(tenant).orderBy(*order))).where(F.col("position") <= F.col(batch))


def after_attempt(jobs: DataFrame, ok: str = "ok") -> DataFrame:
    """State and attempts of running jobs after an attempt: completed, waiting again, or failed at the last one."""
    tried = F.col("attempts") + 1
    status = F.when(F.col(ok), "COMPLETED").when(tried >= F.col("max_attempts"), "FAILED").otherwise("PENDING")
    return jobs.withColumn("status", status).withColumn("attempts", F.when(F.col(ok), F.col("attempts")).otherwise(tried))


def run_status(processed: str, failed: str, error: str | None = None):
    """success, partial or failed from a run's counts (null: it left no summary) and its error message.

    An error or no summary is failed; failures beside anything processed are
    partial, failures alone failed.
    """
    broken = F.col(failed).isNull() | F.col(processed).isNull()
    if error:
        broken = broken | (F.coalesce(F.col(error), F.lit("")) != "")
    return F.when(broken, "failed").when(F.col(failed) == 0, "success").when(F.col(processed) > 0, "partial").otherwise("failed")


# What errors of an exhausted quota say.
QUOTA_ERROR = r"(?i)(quota|too many requests|429|rate limit|insufficient_quota|limit: 0)"


def is_quota_error(message: Column) -> Column:
    return F.coalesce(message.rlike(QUOTA_ERROR), F.lit(False))


def trimmed_error(message: Column, most: int = 300) -> Column:
    """A message as it is stored: its first ``most`` characters, with three points where more follow."""
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("..."))).otherwise(message)
