"""Snapshot merges: upsert, orphan removal, insert-if-absent and purge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: list[str], *, delete_orphans: bool = False, nulls: str = "keep") -> DataFrame:
    """Full outer merge of snapshots: source values win; null source values keep the target's, or win too.

    ``nulls`` is "keep" for patches and "win" for upserts, whose rows are whole.
    ``action`` tells insert, update or keep; with ``delete_orphans`` target rows without a source are gone.
    """
    values = [c for c in target.columns if c not in keys]
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    joined = t.join(s, keys, "right" if delete_orphans else "full")
    action = F.when(F.col("t._t").isNull(), "insert").when(F.col("s._s").isNotNull(), "update").otherwise("keep")
    if nulls not in ("keep", "win"):
        raise ValueError(f"nulls is keep or win, not {nulls}")

    def value(c: str):
        return F.coalesce(f"s.{c}", f"t.{c}") if nulls == "keep" else F.when(F.col("s._s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return joined.select(*keys, *(value(c).alias(c) for c in values), action.alias("action"))


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key isn't in the target; of rows with one key the first by ``order``."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), F.col(order)).alias("_r"))
    return first.select(*keys, "_r.*").join(target.select(*keys), keys, "left_anti")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")
