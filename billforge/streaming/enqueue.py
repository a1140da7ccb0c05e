"""Exactly-once enqueueing of files from a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def enqueue_once(spark: SparkSession, path: str, place: str) -> DataFrame:
    """Tenant and file of each event once: a file stream, run until it has read what is there.

    ``place`` keeps the stream's progress and the jobs, so a later call reads new
    events alone. Each batch leaves out the jobs that are stored already, also
    those that a batch cut short has written; no state is held between batches.
    """
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    kind, stored = "client_id bigint, file_id string", f"{place}/jobs"

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.distinct()
        try:
            fresh = fresh.join(session.read.schema(kind).parquet(stored), ["client_id", "file_id"], "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("append").parquet(stored)

    events = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)
    keys = events.select((F.col("user_id") % 25).alias("client_id"), F.col("event_type").alias("file_id"))
    run = keys.writeStream.foreachBatch(store).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(kind).parquet(stored)
