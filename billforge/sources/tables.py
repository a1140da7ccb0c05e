"""The domain's tables over the given star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the one named by ``spark.checkpoint.dir``; where that is unset, under the warehouse of a local session.

    On a cluster the setting is needed, as a warehouse that nobody has named is each machine's own folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/billforge-settled"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer parts, for steps that compute much on few rows; a table of many parts stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder and read back, so that it is computed once and a lost executor recomputes nothing before it."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clients(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("client_id"), F.col("n_name").alias("client_name"))


def consortiums(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("consortium_id"), F.col("c_name").alias("consortium_name"), F.col("c_nationkey").alias("client_id"))


def providers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("provider_name"), F.col("s_nationkey").alias("provider_client"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("consortium_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("provider_id"), "l_partkey",
        F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"), F.to_date("l_shipdate").alias("due_date"),
    )


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as invoices: amount, due date, accounting period, references."""
    return lines(spark, d).join(orders(spark, d), "l_orderkey")


def periods(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return orders.select(F.col("o_custkey").alias("consortium_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as metered calls: vendor is the event type, model a bucket of the property k."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", (F.col("user_id") % 25).alias("client_id"), F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"), F.round(F.col("value") * 100).cast("long").alias("tokens"),
        F.col("ts").cast("timestamp").alias("run_at"), k.alias("k"),
    )
