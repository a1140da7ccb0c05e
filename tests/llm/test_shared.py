import time

from pyspark.sql import functions as F

from billforge.llm.shared import cut, small_batches


def shuffles(spark):
    """Ids of the shuffles with files on disk."""
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {name.split("_")[1] for name in kept.replace("/", " ").split() if name.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k")
    before, was = shuffles(spark), spark.conf.get(key)
    table = cut(rows.mapInArrow(lambda batches: batches, rows.schema))
    for _ in range(50):
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6
    assert spark.conf.get(key) == was
    rows.write.format("noop").mode("overwrite").save()
    assert shuffles(spark) - before  # other queries keep theirs


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    with small_batches(spark, "3m"):
        assert spark.conf.get(key) == "3m"
    assert spark.conf.get(key) == was
