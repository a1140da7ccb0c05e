"""Documents from a folder: listing, bytes, text by a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions.text import utility_company


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """tenant, file_id, name, modified_at, content and document_hash of the files in the tenants' folders below ``folder`` that match, the oldest first.

    A tenant's folder is the one right below ``folder``; files that lie in none have a
    null tenant. Of files of equal time the name and the path decide.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    inside = F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    tenant = F.when(F.size(F.split(inside, "/")) > 1, F.split(inside, "/")[0])
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(tenant.alias("tenant"), F.col("path").alias("file_id"), name.alias("name"), F.col("modificationTime").alias("modified_at"), "content", F.sha2("content", 256).alias("document_hash"))
    return out.where("file_id <> '' and name <> ''").orderBy("modified_at", "name", "file_id")


def extract_text(files: DataFrame, extractors: list[Callable[..., str | None]], *, pages: int | None = None) -> DataFrame:
    """``files`` with text from the first extractor that gives one, or the last error in ``error``.

    Extractors run in order for each file inside tasks; content is dropped. With ``pages`` each
    gets that number as well, and reads the first so many pages alone.
    """
    limit = () if pages is None else (pages,)
    kept = [c for c in files.columns if c != "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for content in frame["content"]:
                text, error = None, None
                for extract in extractors:
                    try:
                        text = extract(bytes(content), *limit)
                    except Exception as e:  # an extractor may fail in any way; the next one is asked
                        error = f"{type(e).__name__}: {e}"[:300]
                    if text:
                        error = None
                        break
                texts.append(text)
                errors.append(error)
            yield frame[kept].assign(text=pd.Series(texts, index=frame.index, dtype="object"), error=pd.Series(errors, index=frame.index, dtype="object"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema if f.name in kept)
    return files.mapInPandas(run, f"{schema}, text string, error string")


def texts_to_extract(files: DataFrame, extractors: list[Callable[..., str | None]], settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """extract_text's rows with ``company``, as the whole text tells it; bills of utilities have the text of their first page alone.

    Only these are read a second time, so the rows are parted before the extractors see them again.
    """
    first = settle(extract_text(files, extractors).withColumn("company", F.when(F.col("text").isNotNull(), utility_company(F.col("text")))))
    bills = files.join(first.where("company is not null").select("file_id"), "file_id", "left_semi")
    again = extract_text(bills, extractors, pages=1).select("file_id", F.col("text").alias("_page"), F.col("error").alias("_error"))
    out = first.join(again, "file_id", "left")
    bill = F.col("company").isNotNull()
    return out.withColumns({"text": F.when(bill, F.col("_page")).otherwise(F.col("text")), "error": F.when(bill, F.col("_error")).otherwise(F.col("error"))}).select(first.columns)


def route(rows: DataFrame) -> DataFrame:
    """``rows`` with the folder each document goes to: failed on an error, unassigned without a match, else scanned."""
    return rows.withColumn("route", F.when(F.col("error").isNotNull(), "failed").when(F.col("match_id").isNull(), "unassigned").otherwise("scanned"))
