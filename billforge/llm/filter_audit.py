"""Interaction audit of filters over sorted posting lists (operator 12).

For each part of the documents and each filter there are sorted lists of the failing
documents, in blocks by ranges of ids. What a filter removes after some others
is the difference of its list and the union of theirs; its size is counted in each
block and the sizes are added up. All orders of the filters follow from these sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billforge.llm.shared import cut

_WORDS = "filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"


def base_filters(docs: DataFrame, part: Column | str = "lang") -> DataFrame:
    """doc_id, part and ``A`` to ``E`` (true where the filter fails) of every row of ``docs`` (doc_id, text and the part's column).

    A: under 200 words; B: distinct words are under half; C: A-Z are over 3 % of the
    text; D: a symbol of ``#$%&*|``; E: a smaller id has the same text. A null text
    is an empty one, a null part an empty string. A null id is not smaller than
    another and has no smaller one.
    """
    part = F.col(part) if isinstance(part, str) else part
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    told = rows.select("doc_id", "part", "t", F.expr(_WORDS).alias("w"), F.sha2("t", 256).alias("hash"))
    told = cut(
        told.select(
            "doc_id", "part", "hash",
            (F.size("w") < 200).alias("A"),
            (100 * F.size(F.array_distinct("w")) < 50 * F.size("w")).alias("B"),
            F.expr("100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t)").alias("C"),
            F.col("t").rlike(r"[#$%&*|]").alias("D"),
        )
    )
    return _with_copies(told)


def _with_copies(told: DataFrame, salts: int = 16) -> DataFrame:
    """``told`` with E: its hash is that of a row with a smaller id. The rows of one hash are spread over ``salts`` tasks."""
    first = told.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = told.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(salts)), F.lit(0)).cast("int"))
    return salted.join(first, ["hash", "salt"], "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def postings(failing: DataFrame, filters: str, marks: list[str], *, block: int = 65536) -> DataFrame:
    """Blocks of at most ``block`` failing documents of one part, in order of their ids.

    ``failing`` has doc_id, part, a boolean for each letter of ``filters`` and for each
    of ``marks``. A block has part, doc_ids (sorted) and for each letter and mark the
    sorted list of its documents, as places in doc_ids, so that rows which repeat an
    id stay apart.
    """
    names = [*filters, *marks]
    lists = ", ".join(f"{c} array<int>" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = None, [], 0

        def made() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            flags = [np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)).astype(np.int32) for c in names]
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([f], pa.list_(pa.int32())) for f in flags)],
                names=["part", "doc_ids", *names],
            )

        for batch in batches:
            of = batch.column("part").to_pylist()
            i = 0
            while i < len(of):
                if held and (of[i] != part or n == block):
                    yield made()
                    held, n = [], 0
                part, j = of[i], i
                while j < len(of) and of[j] == part and n + j - i < block:
                    j += 1
                held.append(batch.slice(i, j - i))
                n, i = n + j - i, j
        if held:
            yield made()

    keys = [F.asc_nulls_first("part"), F.asc_nulls_first("doc_id"), "_read"]
    rows = failing.withColumn("_read", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("part", F.col("doc_id").cast("long").alias("doc_id"), *names)
    return ordered.mapInArrow(run, f"part string, doc_ids array<bigint>, {lists}")


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The sorted union of sorted lists: numpy's stable sort finds their runs and merges these, galloping."""
    merged = np.concatenate([np.zeros(0, np.int32), *lists])
    merged.sort(kind="stable")
    return merged[np.concatenate([[True], merged[1:] != merged[:-1]])] if len(merged) else merged


def held(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Which of the sorted ``needles`` the sorted list ``hay`` holds; each search goes on from the one before."""
    if not len(hay):
        return np.zeros(len(needles), bool)
    return hay[np.minimum(np.searchsorted(hay, needles), len(hay) - 1)] == needles


def removals(blocks: DataFrame, filters: str, marks: list[str]) -> DataFrame:
    """part, before (letters applied, sorted), letter, removed and, for each mark, how many of these have it; one row for each pair, part and task."""
    k = len(filters)
    befores = [[i for i in range(k) if m >> i & 1] for m in range(1 << k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                lists = [batch.column(c)[r].values.to_numpy() for c in filters]
                marked = [batch.column(c)[r].values.to_numpy() for c in marks]
                total = sums.setdefault(batch.column("part")[r].as_py(), np.zeros((1 << k, k, 1 + len(marks)), np.int64))
                for m, before in enumerate(befores):
                    gone = union([lists[i] for i in before])
                    for f in set(range(k)) - set(before):
                        left = lists[f][~held(lists[f], gone)]
                        total[m, f] += [len(left), *(int(held(left, x).sum()) for x in marked)]
        rows = [(part, "".join(filters[i] for i in before), filters[f], *total[m, f].tolist()) for part, total in sums.items() for m, before in enumerate(befores) for f in range(k) if f not in before]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "before", "letter", "removed", *marks])

    return blocks.mapInArrow(run, ", ".join(["part string, before string, letter string, removed long", *(f"{c} long" for c in marks)]))


def orders(parts: DataFrame, sums: DataFrame, filters: str, marks: list[str]) -> DataFrame:
    """For each of ``parts`` (part, n), each order of ``filters`` and each step what the filter does there.

    ``sums`` has part, before, letter and the sums of removals; what is not there is zero.
    """
    spark = parts.sparkSession
    steps = [("".join(o), i + 1, "".join(sorted(o[:i])), o[i]) for o in permutations(filters) for i in range(len(o))]
    plan = spark.createDataFrame(steps, "filter_order string, step int, before string, letter string")
    pairs = F.array(*(F.struct(F.lit(b).alias("before"), F.lit(x).alias("letter")) for b, x in sorted({s[2:] for s in steps})))
    full = parts.select("part", "n", F.explode(pairs).alias("p")).select("part", "n", "p.*").join(sums, ["part", "before", "letter"], "left").na.fill(0, ["removed", *marks])
    of = Window.partitionBy("part", "letter")
    others = F.length("before") == len(filters) - 1
    full = full.select("*", F.max(F.when(F.col("before") == "", F.col("removed"))).over(of).alias("fails"), F.max(F.when(others, F.col("removed"))).over(of).alias("unique_fails"))
    told = full.join(plan, ["before", "letter"])
    told = told.withColumn("shapley", F.sum("removed").over(of))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return told.select(
        "part", "filter_order", "step", (F.col("n") - F.sum("removed").over(so_far)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", *(F.col(c).alias(f"{c}_lost") for c in marks), "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, *, part: str = "lang", block: int = 65536) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of the filters A to E.

    ``labels`` (doc_id, quality, toxic) marks good and toxic documents; of repeated
    labels the largest counts, a null is none. Every row of ``docs`` is a document, also
    where it repeats an id. An empty table has no part and gives an empty result.
    """
    filters, marks = "ABCDE", ["good", "toxic"]
    judged = cut(base_filters(docs, part))
    marked = labels.groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))))
    failing = judged.where(" or ".join(filters)).join(marked, "doc_id", "left").na.fill(False, marks)
    sums = removals(cut(postings(cut(failing), filters, marks, block=block)), filters, marks)
    sums = sums.groupBy("part", "before", "letter").agg(*(F.sum(c).alias(c) for c in ("removed", *marks)))
    return orders(judged.groupBy("part").agg(F.count(F.lit(1)).alias("n")), sums, filters, marks)
