"""Tables written to the shared folder, and connected components over them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one under the warehouse, which all executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/billforge-shared-{spark.sparkContext.applicationId}"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most ``size`` bytes for the actions inside, so that rows with long binaries stay cheap to hold."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor recomputes nothing before it.

    The shuffles that led to it are removed then, as nothing reads them again; else
    they fill the disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/billforge-{uuid.uuid4().hex}"
    with small_batches(spark), _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def one_text(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id long, text and others) without rows that repeat a doc_id with another text than that of the least hash.

    Rows that repeat both stay. Only ids and hashes are shuffled, and where no id
    has two texts, the usual case, there is no join.
    """
    hashed = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_least"), F.max(F.xxhash64("text")).alias("_most"))
    mixed = cut(hashed.where("_least <> _most").select(F.col("doc_id").alias("_id"), "_least"))
    if mixed.isEmpty():
        return docs
    kept = docs.join(mixed, docs["doc_id"] == mixed["_id"], "left").where(F.col("_least").isNull() | (F.xxhash64("text") == F.col("_least")))
    return kept.select(docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b; long): node, component (its smallest node).

    Minimum labels spread along edges and jump to the label of their label, so
    the number of rounds grows with the logarithm of the longest path. Each round
    is written to the shared folder; an empty input gives an empty result.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component")
        )
        lower = cut(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = cut(
            lower.join(jump, "component", "left").select(
                "node", "was", F.coalesce("next", "component").alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels
