"""The per-tenant interval gate of the scheduler as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK = "tick_id long, client_id long, at timestamp, interval_seconds long, n_files long"


class Gate(StatefulProcessor):
    """Lets a tenant's tick through where its interval has passed since the last one that found files.

    The state is that one's time. A timer takes it away when the watermark has
    passed the interval, as the gate is open from then on; so only tenants whose gate is closed hold state. Where an
    interval is made longer after the timer has fired, it counts from the next tick on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values(["at", "tick_id"])
        held = self.last.get() if self.last.exists() else None
        last, until = held if held else (None, None)
        was, passed = until, []
        for at, seconds, files in zip(ticks["at"], ticks["interval_seconds"], ticks["n_files"], strict=True):
            # the interval is the tick's own, so a changed setting counts at once
            through = last is None or (at - pd.Timestamp(last)).total_seconds() >= seconds
            passed.append(through)
            if through and files > 0:
                last, until = at.to_pydatetime(), (at + pd.Timedelta(seconds=seconds)).to_pydatetime()
        if until != was:
            if was is not None:
                self.handle.deleteTimer(int(pd.Timestamp(was).timestamp() * 1000))
            self.last.update((last, until))
            self.handle.registerTimer(int(pd.Timestamp(until).timestamp() * 1000))
        yield pd.DataFrame({"tick_id": ticks["tick_id"], "client_id": key[0], "accepted": passed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"tick_id": pd.Series(dtype="int64"), "client_id": pd.Series(dtype="int64"), "accepted": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def gated(ticks: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """tick_id, client_id and accepted of a stream of ticks (TICK). Ticks that come more than ``delay`` behind the latest are dropped."""
    return (
        ticks.withWatermark("at", delay)
        .groupBy("client_id")
        .transformWithStateInPandas(Gate(), "tick_id long, client_id long, accepted boolean", outputMode="Append", timeMode="EventTime")
    )


def run_gate(spark: SparkSession, ticks: str, place: str, *, delay: str = "1 hour") -> DataFrame:
    """tick_id, client_id and accepted of all ticks in the folder ``ticks`` so far.

    Reads what is new since the last call with the same ``place``, which keeps
    the progress, the gates and the results; so a restart goes on with closed gates. A batch
    that is done again overwrites its own results.
    """
    out = f"{place}/out"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _rocksdb(spark):
        stream = spark.readStream.schema(TICK).parquet(ticks)
        run = gated(stream, delay=delay).writeStream.foreachBatch(store).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("tick_id long, client_id long, accepted boolean, batch int").parquet(out).drop("batch")
