"""Ordered logs of single edits, replayed over rows with an id and a second unique key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = 65536  # numbers of a log in one stretch
_NONE = (False, None, None)  # the state of an id or a key that isn't there: live, holder of a key, key of an id


def _stretch(rows: list[tuple], states: dict) -> tuple[list[tuple], list[tuple]]:
    """Refused edits (seq, reason) of one stretch in order, and each id ('i', id) and key ('k', key) it asks for: kind, name, state before, state after, whether it was set.

    ``states`` has the states before the stretch of those that are there; it is changed.
    """
    first: dict = {}
    wrote: set = set()
    refused = []

    def put(kind: str, name: object, state: tuple) -> None:
        states[kind, name] = state
        wrote.add((kind, name))

    def see(kind: str, name: object, otherwise: tuple = _NONE) -> tuple:
        at = (kind, name)
        if at not in first:
            first[at] = states.setdefault(at, otherwise)
        return states[at]

    for seq, own, op, key in rows:
        live, _, had = see("i", own)
        holder = see("k", key)[1] if key is not None and op != "delete" else None
        if not live and op in ("patch", "delete"):
            refused.append((seq, "not found"))
        elif live and op == "create":
            refused.append((seq, "exists"))
        elif holder is not None and holder != own:
            refused.append((seq, "duplicate"))
        else:
            key = None if op == "delete" else had if op == "patch" and key is None else key
            if had is not None and had != key and see("k", had, (True, own, None))[1] == own:
                put("k", had, _NONE)
            if key is not None:
                see("k", key, (True, own, None) if key == had else _NONE)
                put("k", key, (True, own, None))
            put("i", own, _NONE if op == "delete" else (True, None, key))
    return refused, [(*at, was, states[at], at in wrote) for at, was in first.items()]


def _walked(rows: DataFrame) -> DataFrame:
    """``_stretch`` of every tenant's stretches: refused edits ('e'), and ids and keys with their states.

    ``rows`` are edits with the next stretch that has their id and, without seq, the keys of ids ('i') and the
    holders of keys ('k') before a stretch. Stretches are dealt out over all tasks, a task holds one at a time.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    state = [("live", T.BooleanType()), ("holder", kinds["id"]), ("held", kinds["key"])]
    fields = [("tenant", kinds["tenant"]), ("_w", T.LongType()), ("kind", T.StringType()), ("seq", T.LongType()), ("reason", T.StringType()), ("id", kinds["id"]), ("key", kinds["key"])]
    fields += [(f"{at}_{c}", t) for at in ("was", "is") for c, t in state] + [("wrote", T.BooleanType()), ("until", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, mine, todo, states, after = None, None, [], {}, {}

        def told() -> pa.RecordBatch:
            refused, seen = _stretch(todo, states)
            n, k = len(refused), len(seen)
            columns = [
                [mine[0]] * (n + k), [mine[1]] * (n + k), ["e"] * n + [x[0] for x in seen], [x[0] for x in refused] + [None] * k, [x[1] for x in refused] + [None] * k,
                [None] * n + [x[1] if x[0] == "i" else None for x in seen], [None] * n + [x[1] if x[0] == "k" else None for x in seen],
                *([None] * n + [x[at][c] for x in seen] for at in (2, 3) for c in range(3)), [None] * n + [x[4] for x in seen], [None] * n + [after.get(x[3][1]) for x in seen],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=[name for name, _ in fields])

        for batch in batches:
            tenants, ids, keys = (batch.column(c).type for c in ("tenant", "id", "key"))
            schema = [tenants, pa.int64(), pa.string(), pa.int64(), pa.string(), ids, keys, *[pa.bool_(), ids, keys] * 2, pa.bool_(), pa.int64()]
            for tenant, w, seq, own, op, key, then in zip(*(batch.column(c).to_pylist() for c in ("tenant", "_w", "seq", "id", "op", "key", "_next")), strict=True):
                if mine != (tenant, w):
                    if todo:
                        yield told()
                    mine, todo, states, after = (tenant, w), [], {}, {}
                if op == "i":
                    states[op, own] = (True, None, key)
                elif op == "k":
                    states[op, key] = (True, own, None)
                else:
                    todo.append((seq, own, op, key))
                    after[own] = then
        if todo:
            yield told()

    by = [F.col("tenant"), F.col("_w")]
    return rows.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_first("seq")).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def _handed_on(walked: DataFrame) -> DataFrame:
    """The states that stretches used of ids and keys (``was``) and those that the stretches before left (``left``): tenant, _w, kind, id, key, same, left_holder, left_held.

    What a stretch sets it hands on, the rest passes through it; so does a key whose holder
    has no edit there, whatever the stretch, walked from another state, has set.
    """
    seen = walked.where("kind <> 'e'")
    names, state = ["tenant", "kind", "id", "key"], ["holder", "held"]
    schema = seen.select("tenant", "_w", "kind", "id", "key", F.lit(True).alias("same"), F.lit(True).alias("live"), *(F.col(f"was_{c}").alias(f"left_{c}") for c in state)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, left, until = None, _NONE, None
        for batch in batches:
            same, lefts = [], []
            columns = [batch.column(c).to_pylist() for c in (*names, "_w", "was_live", "was_holder", "was_held", "is_live", "is_holder", "is_held", "wrote", "until")]
            for tenant, kind, own, key, w, a, b, c, live, holder, held, wrote, then in zip(*columns, strict=True):
                if mine != (tenant, kind, own, key):
                    mine, left, until = (tenant, kind, own, key), _NONE, None
                same.append((a, b, c) == left)
                lefts.append(left)
                if wrote and (left[1] is None or (until is not None and until <= w)):
                    left, until = (live, holder, held), then
            ends = [pa.array(x, t) for x, t in zip(([x[c] for x in lefts] for c in range(3)), (pa.bool_(), batch.column("id").type, batch.column("key").type), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tenant", "_w", "kind", "id", "key")), pa.array(same, pa.bool_()), *ends], names=schema.names)

    return seen.repartition(*names).sortWithinPartitions(*names, "_w").mapInArrow(run, schema)


def replay(log: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``log`` with ``ok`` and, where not, ``reason``: 'not found', 'exists' or 'duplicate'.

    ``log`` has tenant, seq (long, unique in a tenant; a stored row is a 'save' with a seq
    below all edits), id, op, key and any values. In the order of seq:

    * 'create' needs an id that isn't there, 'patch' (a null key keeps the row's) and 'delete' one that is;
    * 'save' makes or overwrites the row of its id;
    * a key that another id of the tenant has at that time refuses the edit; a null key is none.

    Whether an edit holds depends on the edits before it. A tenant's order is cut into stretches of
    bounded length. Each is walked from what the stretches before it left of the ids and keys it asks for: from nothing first,
    then again those that another state reaches, until still. The first wrong stretch of a round is right in the next, so the end is
    the one right answer; rounds are as many as changed verdicts reach on from stretch to stretch.
    """
    given = settle(log.withColumn("_w", F.floor(F.col("seq") / _CHUNK)))
    has = given.select("tenant", "id", "_w").distinct()
    has = has.select("tenant", F.col("id").alias("_i"), F.col("_w").alias("_in"), F.lead("_w").over(Window.partitionBy("tenant", "id").orderBy("_w")).alias("_next"))  # one row for each stretch
    has = has.withColumnRenamed("tenant", "_t")
    edits = given.join(has, F.col("tenant").eqNullSafe(F.col("_t")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("_w") == F.col("_in")))
    edits = settle(edits.select("tenant", "_w", "seq", "id", "op", "key", "_next"))
    walked = settle(_walked(edits))
    while True:
        seen = settle(_handed_on(walked))
        stale = settle(seen.where("not same").select(F.col("tenant").alias("_t"), F.col("_w").alias("_at")).distinct())
        if stale.isEmpty():
            break
        on = F.col("tenant").eqNullSafe(F.col("_t")) & (F.col("_w") == F.col("_at"))
        at = {"seq": F.lit(None).cast("long"), "_next": F.lit(None).cast("long"), "op": F.col("kind"), "id": F.coalesce("id", "left_holder"), "key": F.coalesce("key", "left_held")}
        states = seen.where("live").withColumns(at).select(edits.columns)
        again = _walked(edits.unionByName(states).join(stale, on, "left_semi"))
        walked = settle(walked.join(stale, on, "left_anti").unionByName(again))
    refused = walked.where("kind = 'e'").select(F.col("tenant").alias("_t"), F.col("seq").alias("_s"), "reason")
    out = given.join(refused, F.col("tenant").eqNullSafe(F.col("_t")) & (F.col("seq") == F.col("_s")), "left")
    return settle(out.select(*log.columns, F.col("reason").isNull().alias("ok"), "reason"))


def snapshot(replayed: DataFrame, values: list[str]) -> DataFrame:
    """tenant, id, key and ``values`` of the rows that are there after the edits.

    A save overwrites all values, a patch those that it gives (nulls are not given).
    """
    r = replayed.where("ok")
    whole = r.where("op in ('create', 'save', 'delete')").groupBy("tenant", "id").agg(F.max_by(F.struct("op", "seq"), "seq").alias("w")).where("w.op <> 'delete'").select("tenant", "id", F.col("w.seq").alias("_since"))
    since = r.join(whole, ["tenant", "id"]).where(F.col("seq") >= F.col("_since"))
    return since.groupBy("tenant", "id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("key", *values)))


def receipts(log: DataFrame, tenant: str, invoice: str, order: str) -> DataFrame:
    """tenant, invoice, file_id and file_url after an ordered log of receipts set (file_id given) and cleared (null); a missing url is the file's page."""
    last = log.groupBy(tenant, invoice).agg(F.max_by(F.struct("file_id", "file_url"), order).alias("l"))
    page = F.concat(F.lit("https://drive.google.com/file/d/"), "l.file_id", F.lit("/view"))
    return last.select(tenant, invoice, "l.file_id", F.when(F.col("l.file_id").isNotNull(), F.coalesce("l.file_url", page)).alias("file_url"))
