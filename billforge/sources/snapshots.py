"""Tables that are replaced together: versions in one folder, and a pointer to the one that readers see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_POINTER = "CURRENT"


class Snapshots:
    """Named tables under ``root``, a folder that the whole cluster sees.

    A version is a folder with all tables in it. It is written whole before the
    pointer, a file of one line, is replaced in one step, so readers see either all of the
    old tables or all of the new, also where a write fails half way. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def current(self) -> str | None:
        """The version that readers see, null before the first one."""
        fs, jvm = self._fs()
        if not fs.util().exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{_POINTER}")):
            return None
        return self.spark.read.text(f"{self.root}/{_POINTER}").first()[0]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}/{name}")

    def publish(self, tables: dict[str, DataFrame], *, partition: dict[str, list[str]] | None = None) -> str:
        """Write ``tables`` as the next version and turn readers to it; tables that aren't given keep what they had."""
        was, new = self.current(), uuid.uuid4().hex
        kept = [] if was is None else [n for n in self._names(was) if n not in tables]
        for name, df in {**tables, **{n: self.read(n) for n in kept}}.items():
            df.write.partitionBy(*(partition or {}).get(name, [])).parquet(f"{self.root}/{new}/{name}")
        fs, jvm = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        draft = f"{self.root}/draft-{new}"
        self.spark.range(1).select(F.lit(new)).coalesce(1).write.text(draft)
        part = next(f for f in self._list(draft) if f.startswith("part-"))
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        fs.rename(path(f"{draft}/{part}"), path(f"{self.root}/{_POINTER}"), rename)
        fs.delete(path(draft), True)
        return new

    def _list(self, folder: str) -> list[str]:
        fs, jvm = self._fs()
        found, out = fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)), []
        while found.hasNext():
            out.append(found.next().getPath().getName())
        return out

    def _names(self, version: str) -> list[str]:
        return self._list(f"{self.root}/{version}")

    def forget_old(self) -> None:
        """Remove the versions that no pointer names; readers that still use one fail."""
        fs, jvm = self._fs()
        now = self.current()
        for name in self._list(self.root):
            if name not in (now, _POINTER) and not name.startswith("."):
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


#: counters of a tenant's scheduler that a purge sets to zero
COUNTERS = ("total_input_tokens", "total_output_tokens", "total_tokens", "total_runs", "total_found", "total_processed", "total_skipped", "total_failed", "total_duplicates")


def purge(store: Snapshots, tenants: DataFrame, tenant: str = "client_id") -> dict[str, DataFrame]:
    """The tables jobs, invoices, usage, states and files of ``store`` without what ``tenants`` have processed.

    Their jobs, invoices and usage go, their counters are zero, and files of theirs
    with an invoice go back to 'pending' where they are 'scanned' or 'unassigned'. The caller publishes them together.
    """
    own = tenants.select(tenant).distinct()
    gone = {n: store.read(n).join(own, tenant, "left_anti") for n in ("jobs", "invoices", "usage")}
    mark = own.withColumn("_own", F.lit(True))
    states = store.read("states")
    zero = {c: F.when(F.col("_own"), F.lit(0).cast(states.schema[c].dataType)).otherwise(F.col(c)) for c in COUNTERS if c in states.columns}
    files, invoices = store.read("files"), store.read("invoices").join(own, tenant, "left_semi")
    had = invoices.select(tenant, "file_id").where("file_id is not null").distinct().withColumn("_own", F.lit(True))
    back = F.when(F.col("_own") & F.col("route").isin("scanned", "unassigned"), "pending").otherwise(F.col("route"))
    return {
        **gone, "states": states.join(mark, tenant, "left").withColumns(zero).select(states.columns),
        "files": files.join(had, [tenant, "file_id"], "left").withColumn("route", back).select(files.columns),
    }


def requeued(store: Snapshots, vendors: DataFrame, now, tenant: str = "client_id") -> dict[str, DataFrame]:
    """The tables jobs and invoices after the unassigned invoices that new ``vendors`` (tenant, tax_id) explain were queued again and deleted.

    An invoice with a file and without a vendor, whose tax id is one of theirs as given or without hyphens, goes; its file
    gets a waiting job unless it has one that waits or runs.
    """
    invoices, jobs = store.read("invoices"), store.read("jobs")
    ids = vendors.select(tenant, F.explode(F.array("tax_id", F.trim(F.replace("tax_id", F.lit("-"))))).alias("provider_tax_id")).distinct()
    hit = invoices.where("vendor_id is null and file_id is not null").join(ids, [tenant, "provider_tax_id"], "left_semi")
    waiting = jobs.where("status in ('PENDING', 'PROCESSING')").select(tenant, "file_id")
    new = hit.select(tenant, "file_id").distinct().join(waiting, [tenant, "file_id"], "left_anti")
    made = new.select(tenant, "file_id", F.lit("PENDING").alias("status"), F.lit(0).cast(jobs.schema["attempts"].dataType).alias("attempts"), now.alias("created_at"))
    return {"jobs": jobs.unionByName(made, allowMissingColumns=True), "invoices": invoices.join(hit.select(tenant, "invoice_id"), [tenant, "invoice_id"], "left_anti")}


def foldered(rows: DataFrame, place: str, *, by: list[str], files: int = 4) -> None:
    """Write ``rows`` into folders by the columns ``by`` (a route; a building and a period), replacing the folders that they fill and no other.

    The same rows written again change nothing. Blank and null names are the folder
    of Spark's default name; readers see the folder's columns again. Rows of one folder are
    spread by their hash over ``files`` files.
    """
    rows.repartition(*(F.col(c) for c in by), F.pmod(F.xxhash64(*rows.columns), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(place)
