"""Merkle manifest of a dataset with proofs by leaf partition (operator 11).

Every row is a leaf. The leaves of a source form a tree of runs of sixteen, and
the subroots of all sources form the tree above them. Proofs are made by the
octopus method: a partition of leaves walks up the levels with the set of
coordinates that it knows, notes the siblings that it can't derive (the least
union for all of its leaves), gets these once, derives the shared interior nodes
and expands the proof of each leaf by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.llm.numbering import numbered
from billforge.llm.shared import cut

WIDTH = 16
_LEVELS = 3  # of a tree, built by one task for WIDTH ** _LEVELS nodes
_HEX = 64
_STEPS = "array<struct<before: string, after: string>>"
_UPPER = -1  # the tree of subroots


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Sha256 over the fields, each as its length in bytes, a colon and its value, or a dash for null."""

    def told(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(told(c) for c in (doc_id, source, lang, n_chars, text))), 256)


@dataclass
class Manifest:
    """``leaves`` (tree, place, n, digest and the rows' columns), ``nodes`` (tree, level, place, n, digest; from level 1) and ``sources`` (tree, source, n, subroot, above).

    ``n`` counts the tree's nodes of that level. ``above`` lists, for each level of the
    tree of subroots, what stands before and after the subroot or its ancestor.
    """

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def build_nodes(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes above ``leaves`` (tree, place, n, digest), where no tree has more than ``most`` leaves.

    A task builds three levels above each 4096 nodes, so rounds are few and no tree
    meets in one task.
    """
    spark = leaves.sparkSession
    schema = "tree long, level int, place long, n long, digest string"
    block = WIDTH**_LEVELS

    def grow(from_level: int):
        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("place").to_numpy(), kind="stable")
            tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
            start = int(table.column("place").to_numpy()[order[0]])
            nodes, out = table.column("digest").take(order).to_pylist(), []
            for level in range(from_level + 1, from_level + _LEVELS + 1):
                if n == 1:
                    break
                n, start = -(-n // WIDTH), start // WIDTH
                nodes = [digest(*nodes[i : i + WIDTH]) for i in range(0, len(nodes), WIDTH)]
                out += [(tree, level, start + i, n, h) for i, h in enumerate(nodes)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tree", "level", "place", "n", "digest"])

        return run

    level, below, built = 0, leaves.select("tree", "place", "n", "digest"), []
    while most > 1:
        groups = below.where("n > 1").groupBy("tree", F.floor(F.col("place") / block))
        built.append(cut(groups.applyInArrow(grow(level), schema)))
        level, most = level + _LEVELS, -(-most // block)
        below = built[-1].where(F.col("level") == level).select("tree", "place", "n", "digest")
    out = spark.createDataFrame([], schema)
    for nodes in built:
        out = out.union(nodes)
    return out


def missing_coordinates(places: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level of a tree of ``n`` leaves, the fewest nodes that proofs of the leaves at ``places`` need and can't derive."""
    known, out = np.unique(places), []
    while n > 1:
        parents = np.unique(known // WIDTH)
        children = (parents[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        out.append(np.setdiff1d(children[children < n], known, assume_unique=True))
        known, n = parents, -(-n // WIDTH)
    return out


def expand(places: np.ndarray, digests: list[str], n: int, fetched: dict[tuple[int, int], str]) -> Iterator[list[tuple[str, str]]]:
    """For each of the leaves, by level, the siblings before and after it or its ancestor.

    ``fetched`` has the nodes of missing_coordinates by level and place. Interior
    nodes are derived once, and leaves below the same node share its part.
    """
    level, known = 0, dict(zip(places.tolist(), digests, strict=True))
    steps: list[dict[int, tuple[str, str]]] = []
    while n > 1:
        above, step = {}, {}
        for parent in sorted({p // WIDTH for p in known}):
            run = range(parent * WIDTH, min(n, (parent + 1) * WIDTH))
            all_ = "".join(known.get(p) or fetched[level, p] for p in run)
            for k, p in enumerate(run):
                if p in known:
                    step[p] = all_[: k * _HEX], all_[(k + 1) * _HEX :]
            above[parent] = digest(all_)
        steps.append(step)
        level, known, n = level + 1, above, -(-n // WIDTH)
    for p in places.tolist():
        yield [step[p // WIDTH**k] for k, step in enumerate(steps)]


def _requests(leaves: DataFrame, size: int) -> DataFrame:
    """The nodes that each leaf partition (tree, part) must get, and which of their copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, part, n = row["tree"], row["part"], row["n"]
                for level, places in enumerate(missing_coordinates(np.array(row["places"], np.int64), n)):
                    copy = part % max(1, min(WIDTH ** (level + 1), n) // size)
                    same = ((tree, pa.int64()), (part, pa.int64()), (level, pa.int32()), (copy, pa.int64()))
                    tree_, part_, level_, copy_ = (pa.repeat(pa.scalar(v, t), len(places)) for v, t in same)
                    yield pa.RecordBatch.from_arrays([tree_, part_, level_, pa.array(places, pa.int64()), copy_], names=["tree", "part", "level", "place", "copy"])

    known = leaves.groupBy("tree", "part").agg(F.first("n").alias("n"), F.collect_list("place").alias("places"))
    return known.mapInArrow(run, "tree long, part long, level int, place long, copy long")


def _dealt(nodes: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """``nodes`` in copies, one for about each leaf partition below a node's parent, as all of these ask for it."""
    below = F.least(F.pow(F.lit(WIDTH), F.col("level") + 1), F.col("leaves"))
    last = F.greatest(F.lit(1), F.floor(below / size)).cast("long") - 1
    return nodes.join(sizes.select("tree", F.col("n").alias("leaves")), "tree").select("tree", "level", "place", "digest", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("copy"))


def paths(leaves: DataFrame, nodes: DataFrame, sizes: DataFrame, *, size: int = WIDTH**_LEVELS) -> DataFrame:
    """``leaves`` (tree, place, n, digest, others) with ``steps``, by level what stands before and after the leaf or its ancestor, and ``above`` and ``subroot``.

    ``leaves`` may be some of the trees' leaves only. A leaf partition is ``size``
    places of a tree. ``nodes`` (tree, level, place, digest) has the leaves as level 0,
    ``sizes`` (tree, n, above, subroot) a row for each tree; the last two go to each
    of its partitions.
    """
    own = leaves.withColumn("part", F.floor(F.col("place") / size))
    fetched = _requests(own, size).join(_dealt(nodes, sizes, size), ["tree", "level", "place", "copy"]).select("tree", "part", "level", "place", "digest", F.lit(None).cast(_STEPS).alias("above"))
    for_all = sizes.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("part"), F.lit(None).cast("int"), F.lit(None).cast("long"), "subroot", "above")
    columns = leaves.columns

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        if not mine.num_rows:  # none of the partition's leaves is asked for
            none = pa.array([], kind)
            return mine.select(columns).append_column("steps", none).append_column("above", none).append_column("subroot", pa.array([], pa.string()))
        got = {(f["level"], f["place"]): f["digest"] for f in theirs.select(["level", "place", "digest"]).to_pylist()}
        above = next((a for a in theirs.column("above").to_pylist() if a is not None), [])
        places, n = mine.column("place").to_numpy(), mine.column("n")[0].as_py()
        steps = [[{"before": a, "after": b} for a, b in path] for path in expand(places, mine.column("digest").to_pylist(), n, got)]
        same = pa.repeat(pa.scalar(above, kind), mine.num_rows)
        return mine.select(columns).append_column("steps", pa.array(steps, kind)).append_column("above", same).append_column("subroot", pa.repeat(pa.scalar(got.get((None, None)), pa.string()), mine.num_rows))

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in leaves.schema), *(T.StructField(c, T._parse_datatype_string(_STEPS)) for c in ("steps", "above")), T.StructField("subroot", T.StringType())])
    return own.groupBy("tree", "part").cogroup(fetched.union(for_all).groupBy("tree", "part")).applyInArrow(run, schema)


def folded(digest: Column, steps: Column) -> Column:
    """The root over a leaf's digest and its siblings."""
    return F.aggregate(steps, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame, **columns: Column) -> Manifest:
    """Leaves, nodes and sources of ``docs`` (doc_id, source, lang, n_chars, text); further ``columns`` go with the leaves.

    Leaves of a source are ordered by doc_id, null first, then by digest; equal rows
    are leaves of their own. A null source is a source, and the first one. An empty
    table has no leaf and no source, and its root is null.
    """
    leaf = leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    rows = cut(docs.select("doc_id", F.col("source").alias("_source"), leaf.alias("digest"), *(c.alias(k) for k, c in columns.items())))
    placed = numbered(rows, "_source", ["doc_id", "digest"])
    counts = placed.groupBy(F.col("_source").alias("source")).agg((F.max("place") + 1).alias("n"))
    trees = cut(numbered(cut(counts.withColumn("_all", F.lit(0))), "_all", ["source"]).select(F.col("place").alias("tree"), "source", "n"))
    leaves = cut(placed.join(trees, placed["_source"].eqNullSafe(trees["source"])).drop("_source", "source"))
    largest, n_trees = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    nodes = build_nodes(leaves, largest)
    tops = nodes.where("n = 1").select("tree", "digest").union(leaves.where("n = 1").select("tree", "digest"))
    subroots = cut(trees.join(tops, "tree").select(F.lit(_UPPER).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("n"), "digest", F.col("n").alias("n_leaves"), "source"))
    upper = build_nodes(subroots, n_trees)
    one = upper.where("n = 1").select("digest").union(subroots.where("n = 1").select("digest")).first()
    own = F.lit(_UPPER).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.array().cast(_STEPS).alias("above"), F.lit(None).cast("string").alias("subroot")
    above = paths(subroots, with_leaves(upper, subroots), leaves.sparkSession.range(min(1, n_trees)).select(*own))
    sources = cut(above.select(F.col("place").alias("tree"), "source", F.col("n_leaves").alias("n"), F.col("digest").alias("subroot"), F.col("steps").alias("above")))
    return Manifest(leaves, nodes, sources, one[0] if one else None)


def with_leaves(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``nodes`` and the leaves below them, as level 0."""
    return nodes.select("tree", "level", "place", "digest").union(leaves.select("tree", F.lit(0).alias("level"), "place", "digest"))


def proofs(made: Manifest, leaves: DataFrame | None = None, *, size: int = WIDTH**_LEVELS) -> DataFrame:
    """The proof of each of the manifest's ``leaves`` (default: all): its columns, steps, above and subroot."""
    return paths(made.leaves if leaves is None else leaves, with_leaves(made.nodes, made.leaves), made.sources, size=size)


def audit(docs: DataFrame, *, size: int = WIDTH**_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    Rows whose id's crc32 is divisible by five are read back with their text's A-Z
    lower-cased; the others, and rows without an id, as they are. Null fields and
    repeated rows: see manifest.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    told = F.when(altered, leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.translate("text", upper, upper.lower())))
    made = manifest(docs, altered=told)
    proof = F.aggregate(F.concat("steps", "above"), F.lit(""), lambda a, s: F.concat(a, s["before"], s["after"]))
    back = folded(folded(F.coalesce("altered", "digest"), F.col("steps")), F.col("above"))
    root = F.lit(made.root).cast("string")
    out = proofs(made, size=size).select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
