"""Accounting periods: majority month, active period, roll-forward."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.functions.keys import month_name, period_label
from billforge.operators.carry import last_before


def majority_month(periods: DataFrame, by: str) -> DataFrame:
    """The most frequent (year, month) of each ``by``; ties go to the earliest."""
    counts = periods.groupBy(by, "year", "month").agg(F.count(F.lit(1)).alias("n_periods"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n_periods")).alias("n"), "year", "month")).alias("b"))
    return best.select(by, F.col("b.year").alias("year"), F.col("b.month").alias("month"), (-F.col("b.n")).alias("n_periods"))


def active_period(periods: DataFrame, by: str) -> DataFrame:
    """The latest period of each ``by``, with its label."""
    last = periods.groupBy(by).agg(F.max(F.struct("year", "month")).alias("p"))
    return last.select(by, F.col("p.year").alias("year"), F.col("p.month").alias("month"), period_label(F.col("p.month"), F.col("p.year")).alias("label"))


def close_all(active: DataFrame, majority_year: str = "majority_year", majority_month_: str = "majority_month") -> DataFrame:
    """Close active periods that are the majority month and open the next; others are skipped.

    ``active`` has the majority month in two columns; the result tells the action and the next period.
    """
    same = (F.col("year") == F.col(majority_year)) & (F.col("month") == F.col(majority_month_))
    ahead = F.add_months(F.make_date("year", "month", F.lit(1)), 1)
    return active.withColumn("action", F.when(same, "close").otherwise("skip")).withColumn("next_year", F.when(same, F.year(ahead))).withColumn("next_month", F.when(same, F.month(ahead)))


def close_counts(closed: DataFrame, by: str) -> DataFrame:
    """by, n_to_close, n_to_skip and the label of the month to open ('Marzo 2024'), from close_all's rows with the majority month."""
    ahead = F.add_months(F.make_date("majority_year", "majority_month", F.lit(1)), 1)
    label = F.concat(month_name(F.month(ahead)), F.lit(" "), F.year(ahead).cast("string"))
    return closed.groupBy(by).agg(F.count_if(F.col("action") == "close").alias("n_to_close"), F.count_if(F.col("action") == "skip").alias("n_to_skip"), F.max(label).alias("next_label"))


def greedy_gate(ticks: DataFrame, by: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """``ticks`` with ``accepted``: the first of each ``by``, then each at least ``seconds`` after the last accepted one.

    Ticks of equal time come in the order of ``tie``. Each key's ticks pass in
    order, batch by batch, and only its last accepted time is kept. ``by`` and
    ``tie`` are longs; ticks without a time are not accepted.
    """
    out = T.StructType([*ticks.schema.fields, T.StructField("accepted", T.BooleanType())])
    gap = np.timedelta64(seconds, "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keys = batch.column(by).to_pylist()
            times = batch.column(ts).cast(pa.timestamp("us")).to_numpy(zero_copy_only=False)
            bounds = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            accepted = np.zeros(len(keys), bool)
            for begin, end in zip(bounds, bounds[1:], strict=False):
                if begin == end:
                    continue
                if keys[begin] != key:
                    key, last = keys[begin], None
                at = begin + int(np.isnat(times[begin:end]).sum())  # nulls are first
                while at < end:
                    at = at if last is None else at + int(np.searchsorted(times[at:end], last + gap))
                    if at < end:
                        accepted[at], last = True, times[at]
                        at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted)], names=[*batch.schema.names, "accepted"])

    return ticks.repartition(F.col(by)).sortWithinPartitions(by, ts, tie).mapInArrow(run, out)


def lag_gate(ticks: DataFrame, by: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """``ticks`` with ``gap_ok``: at least ``seconds`` since the tick before. A key's days are looked at apart and hand on their last tick."""
    out = last_before(ticks, [by], [ts, tie], F.col(ts).cast("double"), bucket=F.to_date(ts), name="_last")
    return out.withColumn("gap_ok", F.coalesce(F.col(ts).cast("double") - F.col("_last") >= seconds, F.lit(True))).drop("_last")
