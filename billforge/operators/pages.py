"""What the pages of a tenant ask for: scoping, vendors of a scan, wrong buildings, manual invoices, links of buildings and vendors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from billforge.functions import keys as K
from billforge.functions import shown as S
from billforge.functions.text import js_trim
from billforge.operators import match


def scoped(rows: DataFrame, tenant: str, session: dict, *, change: bool = False) -> DataFrame:
    """``rows`` of the session's tenant; an ADMIN sees all, and a VIEWER may not change any."""
    if change and session["role"] == "VIEWER":
        raise PermissionError("a VIEWER may not change rows")
    return rows if session["role"] == "ADMIN" else rows.where(F.col(tenant) == F.lit(session["client_id"]))


def shown_name(c: Column) -> Column:
    """A vendor's name as pages compare it: lower case, points, commas and dashes as spaces, legal forms kept."""
    return js_trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[.,\-_]", " "), r"\s+", " "))


def vendor_of_scan(scans: DataFrame, vendors: DataFrame, tenant: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, match_id and rule of scans (doc_id, tenant, provider, provider_tax_id) that name a vendor (match_id,
    tenant, cuit, name, payment_alias): by a tax id of ten digits or more, else by name or payment alias of three
    characters or more. Of several vendors the smallest id.
    """
    digits = K.digits(F.coalesce("provider_tax_id", F.lit("")))
    asked = scans.select("doc_id", tenant, shown_name(F.col("provider")).alias("name"), F.when(F.length(digits) >= 10, F.array(digits)).otherwise(F.array().cast("array<string>")).alias("tax_ids"))
    known = vendors.select("match_id", tenant, K.digits(F.coalesce("cuit", F.lit(""))).alias("tax_id"))
    names = vendors.select("match_id", tenant, F.explode(F.array("name", "payment_alias")).alias("name")).withColumn("name", shown_name(F.col("name")))
    rules = [(0, lambda x: match.by_tax_id(x, known, tenant)), (1, lambda x: match.by_name(x.where(F.length("name") >= 3), names, tenant))]
    return match.in_turn(asked, rules, settle)


def building_mismatch(scans: DataFrame, buildings: DataFrame, tenant: str) -> DataFrame:
    """``scans`` with mismatch and found: whether the name read (raw, as ``name`` normalised) is another than the
    ``selected`` one (normalised), and then the raw name of the tenant's building of that name, or else the name read.

    ``buildings`` has the tenant, name (normalised) and raw_name; of several the first raw name. Blank names never mismatch.
    """
    known = buildings.where("name <> ''").groupBy(tenant, "name").agg(F.min("raw_name").alias("_known"))
    other = F.coalesce((F.col("name") != "") & (F.col("selected") != "") & (F.col("name") != F.col("selected")), F.lit(False))
    out = scans.join(known, [tenant, "name"], "left").withColumn("mismatch", other)
    return out.withColumn("found", F.when(F.col("mismatch"), F.coalesce("_known", js_trim(F.col("raw"))))).drop("_known")


def manual_invoices(rows: DataFrame, clock: Column) -> DataFrame:
    """Invoices typed in by hand (client_id, consortium_id, number, amount, due, tax_id) with their hash and the parts of
    their key as this way writes them: number in capitals, tax id in digits, the date as given, two decimals.
    """
    shown = F.regexp_replace(F.col("amount").cast("string"), r"\.0$", "")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("number", "tax_id", "due")}
    return rows.withColumns(
        {
            "document_hash": S.manual_hash(F.col("client_id"), F.col("consortium_id"), F.col("number"), shown, clock),
            "number_norm": js_trim(F.upper(text["number"])),
            "tax_id_norm": K.digits(text["tax_id"]),
            "due_norm": text["due"],
            "amount_norm": F.coalesce(K.two_decimals(F.col("amount").cast("double")), F.lit("")),
            "is_manual": F.lit(True),
        }
    )


def linked_vendors(links: DataFrame, vendors: DataFrame, asked: DataFrame) -> DataFrame:
    """The vendors with the tax id asked for that are linked with the building asked for: ``asked`` has client_id, consortium_id and cuit."""
    known = vendors.select("client_id", "cuit", "provider_id", "provider_name")
    return asked.join(known, ["client_id", "cuit"]).join(links.select("consortium_id", "provider_id").distinct(), ["consortium_id", "provider_id"], "left_semi")


def updated(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with the ``columns`` of the row of ``source`` that has its key (of several, the least); rows without one stay."""
    one = source.groupBy(key).agg(F.min(F.struct(*columns)).alias("_s"))
    out = target.join(one, key, "left")
    return out.select(*(F.when(F.col("_s").isNull(), F.col(c)).otherwise(F.col(f"_s.{c}")).alias(c) if c in columns else c for c in target.columns))


def page_with_total(rows: DataFrame, order: list, settle: Callable[[DataFrame], DataFrame], *, page: int = 1, size: int = 50) -> tuple[DataFrame, int]:
    """One page of ``rows`` in order, as ``settle`` has written it, and how many rows there are.

    The page is 1 at least and its size from 1 to 100. The rows are counted in the
    pass that finds the page's; only as many rows as the pages up to this one hold are sorted.
    ``rows`` come from tables: of made-up rows, whose number Spark knows, it may sort all, after a pass that samples them, and so count twice.
    """
    page, size = max(1, page), min(100, max(1, size))
    seen = Observation()
    out = settle(rows.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order).offset((page - 1) * size).limit(size))
    return out.orderBy(*order), seen.get["total"]


def ordered_by(rows: DataFrame, related: DataFrame, key: str, order: list) -> DataFrame:
    """``rows`` with the columns of ``related``, in an order that may name these; a row without its related one stays, its cells null."""
    return rows.join(related, key, "left").orderBy(*order)


def with_children(rows: DataFrame, children: DataFrame, key: str, newest: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the list of their children as structs of the columns ``newest``, the largest first; without children it is empty.

    A parent's children are one list, so they must be few, as months are.
    """
    listed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*newest)), asc=False).alias(name))
    out = rows.join(listed, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


def search(fields: list[str], exact: list[str], text: str) -> Column:
    """Rows with ``text`` in one of ``fields``, whatever its case, or in one of ``exact`` as it is in lower case; nulls hold nothing, an empty text finds all."""
    q = text.lower()
    out = F.lit(q == "")
    for c in fields:
        out = out | F.coalesce(F.lower(c).contains(q), F.lit(False))
    for c in exact:
        out = out | F.coalesce(F.col(c).contains(q), F.lit(False))
    return out


def found_totals(rows: DataFrame, by: str) -> DataFrame:
    """by, n_found, total (missing amounts count as 0) and n_duplicates of ``rows`` (amount, is_duplicate)."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_found"), F.sum(F.coalesce("amount", F.lit(0))).cast("double").alias("total"), F.count_if("is_duplicate").alias("n_duplicates"))
