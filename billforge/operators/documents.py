"""The way of a document from its text and an extractor's answer to a stored invoice, as one plan.

Documents of a tenant come in the order of their ids, and each sees what the ones before
it have stored: an invoice by its content hash (its fields are taken then, and resolved
anew) or by its business key. A store under two unique keys refuses a second row with
the same key, so what is stored depends on the order. Instead of a loop over documents the
store is computed as intervals: from which document on which record stands under a
hash. Each interval depends on earlier ones only, so that taking the last round's intervals
for the conflicts of the next ends with the one right store, the rounds being as many as
conflicts follow one another. Copies of a document meet in aggregates alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions import keys as K
from billforge.functions import text as X
from billforge.operators.assign import Directory, Settle, assign
from billforge.operators.extract import parse_answer
from billforge.operators.match import by_sorting

_FIELDS = ("boleta_number", "provider", "consortium", "provider_tax_id", "detail", "observation", "due_date", "amount", "alias", "client_number", "payment_method", "all_tax_ids")
_PLACED = ("building_id", "building_rule", "vendor_id", "vendor_rule", "service_id", "fill_vendor", "period")


def refined_building(building: Column, text: Column) -> Column:
    """The building's name, or that of the text's labelled line where the name is missing, generic or shorter; bills of utilities keep theirs."""
    told = X.building_from_lines(X.plain_lines(text))
    own = X.js_trim(F.regexp_replace(building, f"{X.JS_SPACE}+", " "))
    better = X.is_generic_building(own) | (F.length(told) > F.length(own))
    return F.when(~X.is_utility_bill(text) & told.isNotNull() & better, told).otherwise(building)


def _refined(building: Column, line: Column) -> Column:
    """refined_building where ``line`` is the text's labelled line, null in bills of utilities."""
    own = X.js_trim(F.regexp_replace(building, f"{X.JS_SPACE}+", " "))
    return F.when(line.isNotNull() & (X.is_generic_building(own) | (F.length(line) > F.length(own))), line).otherwise(building)


@dataclass
class Processed:
    """``documents``: every document's outcome; ``invoices``: the store at the end, one row for each tenant and content hash that is in it."""

    documents: DataFrame
    invoices: DataFrame


def _record_id() -> Column:
    """Equal records of one content are one: two hashes over tenant, content and fields."""
    told = [F.coalesce(F.to_json(F.struct(*_FIELDS)), F.lit("")), F.col("content_hash"), F.col("client_id").cast("string")]
    return F.sha2(F.concat_ws("\n", *told), 256)


def _resolved(raw: DataFrame, d: Directory, settle: Settle) -> DataFrame:
    """Records (record, client_id, content_hash, company, line and the fields) with their place, raw_key, parts and the fields as they are stored."""
    placed = assign(raw.withColumnRenamed("record", "doc_id"), d, settle).withColumnRenamed("doc_id", "record")
    key = K.business_key(F.col("boleta_number"), F.col("provider_tax_id"), F.col("due_date"), K.two_decimals(F.col("amount")))
    out = by_sorting(raw.withColumn("raw_key", key), placed, "record")
    out = out.withColumns({c: F.when(F.col("assigned"), F.coalesce(new, c)).otherwise(F.col(c)) for c, new in (("consortium", "new_consortium"), ("provider", "new_provider"), ("provider_tax_id", "new_tax_id"))})
    out = out.withColumn("alias", F.when(F.col("assigned"), F.nullif(F.col("new_alias"), F.lit(""))).otherwise(F.col("alias")))
    parts = K.stored_key(K.business_key(F.col("boleta_number"), F.col("provider_tax_id"), F.col("due_date"), K.two_decimals(F.col("amount"))), F.col("content_hash"))
    return out.select("record", "client_id", "content_hash", "company", "line", "assigned", "raw_key", F.when(F.col("assigned"), parts).alias("parts"), *_PLACED, *_FIELDS)


def _taken(records: DataFrame) -> DataFrame:
    """What a copy finds in the store instead of an answer: due dates as dates or null, no client number, tax ids or way to pay."""
    gone = {"client_number": F.lit(None).cast("string"), "payment_method": F.lit(None).cast("string"), "all_tax_ids": F.lit(None).cast("array<string>")}
    out = records.withColumns({"due_date": K.parsed_date(F.col("due_date")).cast("string"), "consortium": _refined(F.col("consortium"), F.col("line")), **gone})
    return out.withColumnRenamed("record", "of").withColumn("record", _record_id()).select("of", "record", "client_id", "content_hash", "company", "line", *_FIELDS)


def records_of(first: DataFrame, repeated: DataFrame, d: Directory, settle: Settle) -> DataFrame:
    """All records that documents can come to: those of answers (``first``), and from each that is stored what a copy makes of it (``next``).

    ``repeated`` (client_id, content_hash) are the contents of two documents or more.
    Each round resolves the records that are new; a record that becomes itself ends its chain.
    """
    new = settle(_resolved(first, d, settle))
    every, links = new, None
    while True:
        taken = settle(_taken(by_sorting(new.where("assigned"), repeated, ["client_id", "content_hash"], "left_semi")))
        mine = taken.select(F.col("of").alias("record"), F.col("record").alias("next"))
        links = mine if links is None else links.union(mine)
        fresh = settle(by_sorting(taken.drop("of").dropDuplicates(["record"]), every.select("record"), "record", "left_anti"))
        if fresh.isEmpty():
            return settle(by_sorting(every, links, "record", "left"))
        new = settle(_resolved(fresh, d, settle))
        every = every.unionByName(new)


def _free(asked: DataFrame, store: DataFrame | None) -> DataFrame:
    """The rows of ``asked`` (client_id, content_hash, doc_id, parts) whose key no other content's interval in ``store`` has at that document."""
    if store is None:
        return asked
    s = store.select(F.col("client_id").alias("_c"), F.col("content_hash").alias("_h"), F.col("parts").alias("_p"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    at = (F.col("_since") < F.col("doc_id")) & (F.col("_until").isNull() | (F.col("doc_id") <= F.col("_until")))
    return by_sorting(asked, s, (F.col("client_id") == F.col("_c")) & (F.col("parts") == F.col("_p")) & (F.col("content_hash") != F.col("_h")) & at, "left_anti")


def _intervals(docs: DataFrame, records: DataFrame, store: DataFrame | None, settle: Settle) -> DataFrame:
    """client_id, content_hash, since, until (null: to the end), record and parts of what is stored, where ``store`` tells which keys are taken.

    ``docs`` has doc_id, client_id, content_hash and record. A content's first
    document with a free key makes its row; a later copy turns it into the next record
    where that one's key is free. A row stands from the document after ``since``.
    """
    r = records.select("record", "assigned", "parts", "next")
    own = ["client_id", "content_hash"]
    first = _free(by_sorting(docs, r.where("assigned").select("record", "parts"), "record").select(*own, "doc_id", "record", "parts"), store)
    now = settle(first.groupBy(*own).agg(F.min_by(F.struct("record", "parts"), "doc_id").alias("s"), F.min("doc_id").alias("since")).select(*own, "since", "s.record", "s.parts"))
    out = None
    while True:
        after = r.where("assigned").select(F.col("record").alias("next"), F.col("parts").alias("next_parts"))
        moves = by_sorting(by_sorting(now, r.select("record", "next"), "record").where("next <> record"), after, "next")
        asked = by_sorting(docs.select(*own, "doc_id"), moves.select(*own, "since", "next", "next_parts", F.col("parts").alias("was")), own).where("doc_id > since").withColumnRenamed("next_parts", "parts")
        free = asked.where("parts = was").unionByName(_free(asked.where("parts <> was"), store))
        moved = settle(free.groupBy(*own).agg(F.min("doc_id").alias("until"), F.first("next").alias("next"), F.first("parts").alias("next_parts")))
        done = by_sorting(now, moved.select(*own, "until"), own, "left").select(*own, "since", "until", "record", "parts")
        out = done if out is None else out.union(done)
        if moved.isEmpty():
            return settle(out)
        now = moved.select(*own, F.col("until").alias("since"), F.col("next").alias("record"), F.col("next_parts").alias("parts"))


def stored(docs: DataFrame, records: DataFrame, settle: Settle) -> DataFrame:
    """The store as intervals (see _intervals): contents whose keys no other content can have at once, the others in rounds until still, each taking the conflicts from the one before."""
    own = ["client_id", "content_hash"]
    keys = records.where("assigned").groupBy("client_id", "parts").agg(F.min("content_hash").alias("_a"), F.max("content_hash").alias("_b")).where("_a <> _b").select("client_id", "parts")
    contested = settle(by_sorting(records.where("assigned"), keys, ["client_id", "parts"], "left_semi").select(*own).distinct())
    alone = _intervals(by_sorting(docs, contested, own, "left_anti"), records, None, settle)
    if contested.isEmpty():
        return alone
    rivals = settle(by_sorting(docs, contested, own, "left_semi"))
    store = _intervals(rivals, records, None, settle)
    columns = [*own, "since", "until", "record"]
    while True:
        new = _intervals(rivals, records, store, settle)
        was, now = store.select(*columns), new.select(*columns)
        if now.exceptAll(was).isEmpty() and was.exceptAll(now).isEmpty():
            return alone.union(new)
        store = new


def process(docs: DataFrame, directory: Directory, settle: Settle, *, sheet_keys: DataFrame | None = None) -> Processed:
    """What becomes of every document of ``docs`` (doc_id, client_id, text, answer), and the invoices stored in the end.

    ``sheet_keys`` (client_id, business_key) are those of the tenant's sheet. In the order of doc_id:

    * a null text is 'failed'; a broken answer leaves a record that only says so (observation OCR_ONLY);
    * a document whose content is stored takes the stored fields and is a duplicate ('hash'), else it is one where an
      invoice with its key is stored ('stored key') or the sheet or a document before it that went
      into the sheet has its key ('sheet key'); keys that are looked up have the fields as extracted, stored ones the
      directory's names and tax ids;
    * one without a building or a vendor is 'unassigned' and stored nowhere;
    * others are 'scanned' and ``saved``, unless another content's invoice has their stored key.

    Documents are told apart by doc_id within a tenant. Links of services found by label take effect in the next run.
    """
    own = parse_answer(docs.where("text is not null"), "answer")
    own = own.withColumn("observation", F.when(F.col("route") == "failed", "OCR_ONLY").otherwise(F.col("observation")))
    line = F.when(~X.is_utility_bill(F.col("text")), X.building_from_lines(X.plain_lines(F.col("text"))))
    own = own.withColumns({"content_hash": F.sha2(F.col("text").cast("binary"), 256), "company": X.utility_company(F.col("text")), "line": line})
    own = own.withColumn("consortium", F.when(F.col("route") == "failed", F.col("consortium")).otherwise(_refined(F.col("consortium"), F.col("line"))))
    own = settle(own.withColumn("record", _record_id()).select("doc_id", "client_id", "content_hash", "company", "line", "record", *_FIELDS))
    d = directory.settled(settle)
    first = own.drop("doc_id").dropDuplicates(["record"])
    repeated = settle(own.groupBy("client_id", "content_hash").count().where("count > 1").select("client_id", "content_hash"))
    records = records_of(first, repeated, d, settle)
    told = own.select("doc_id", "client_id", "content_hash", "record")
    store = stored(told, records, settle)

    s = store.select("client_id", "content_hash", "since", "until", F.col("record").alias("held"), F.col("parts").alias("held_parts"))
    at = (F.col("doc_id") > F.col("since")) & (F.col("until").isNull() | (F.col("doc_id") <= F.col("until")))
    seen = by_sorting(told.alias("d"), s.alias("s"), (F.col("d.client_id") == F.col("s.client_id")) & (F.col("d.content_hash") == F.col("s.content_hash")) & at, "left")
    seen = seen.select("doc_id", "d.client_id", "d.content_hash", "d.record", "held", "held_parts", "until")
    seen = by_sorting(seen, records.select(F.col("record").alias("held"), "next"), "held", "left").withColumn("record", F.coalesce("next", "record"))
    seen = settle(by_sorting(seen, records.drop("client_id", "content_hash", "next"), "record"))
    looked = seen.where("held is null and raw_key is not null").select("client_id", "content_hash", "doc_id", F.col("raw_key").alias("parts"))
    by_key = by_sorting(looked, _free(looked, store).select("client_id", "doc_id"), ["client_id", "doc_id"], "left_anti").select("client_id", "doc_id", F.lit(True).alias("has_key"))
    in_sheet = seen.where("assigned and raw_key is not null").groupBy("client_id", "raw_key").agg(F.min("doc_id").alias("first_in_sheet"))
    created = store.groupBy("client_id", "content_hash").agg(F.min("since").alias("created"))
    out = by_sorting(by_sorting(by_sorting(seen, by_key, ["client_id", "doc_id"], "left"), in_sheet, ["client_id", "raw_key"], "left"), created, ["client_id", "content_hash"], "left")
    before = F.lit(False)
    if sheet_keys is not None:
        keys = sheet_keys.select("client_id", F.col("business_key").alias("raw_key"), F.lit(True).alias("had")).distinct()
        out, before = by_sorting(out, keys, ["client_id", "raw_key"], "left"), F.coalesce("had", F.lit(False))
    by = F.when(F.col("held").isNotNull(), "hash").when(F.col("has_key"), "stored key").when(before | (F.col("first_in_sheet") < F.col("doc_id")), "sheet key")
    again = F.col("held").isNotNull()
    saved = F.when(again, (F.col("parts") == F.col("held_parts")) | F.coalesce(F.col("doc_id") == F.col("until"), F.lit(False))).otherwise(F.coalesce(F.col("doc_id") == F.col("created"), F.lit(False)))
    stays = F.col("assigned")
    out = out.select(
        "doc_id", "client_id", F.when(stays, "scanned").otherwise("unassigned").alias("route"), F.when(stays, by.isNotNull()).alias("is_duplicate"), F.when(stays, by).alias("duplicate_by"),
        (stays & saved).alias("saved"), "content_hash", F.col("raw_key").alias("business_key"), F.when(stays, F.col("parts")).alias("stored_key"), "company", "record", *_PLACED, *_FIELDS,
    )
    out = settle(out)
    last = out.where("saved").groupBy("client_id", "content_hash").agg(F.max_by(F.struct("doc_id", "is_duplicate"), "doc_id").alias("l"))
    final = by_sorting(by_sorting(store.where("until is null"), records.drop("client_id", "content_hash", "parts", "next", "raw_key", "assigned", "line"), "record"), last, ["client_id", "content_hash"])
    invoices = final.select("client_id", "content_hash", F.col("parts").alias("stored_key"), F.col("l.doc_id").alias("last_doc_id"), "l.is_duplicate", *_PLACED, *_FIELDS)
    failed = docs.where("text is null").select("doc_id", "client_id", F.lit("failed").alias("route"))
    return Processed(out.drop("record").unionByName(failed, allowMissingColumns=True), invoices)
