"""The building, vendor, service and period of extracted documents, as one plan over a tenant's directory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions import address as A
from billforge.functions import keys as K
from billforge.functions import text as X
from billforge.operators import match
from billforge.operators.match import by_sorting

Settle = Callable[[DataFrame], DataFrame]


@dataclass
class Directory:
    """A tenant's master data, all with ``client_id``.

    * buildings: building_id, canonical_name, raw_name, tax_id, match_names (packed with bars);
    * vendors: vendor_id, canonical_name, tax_id, match_names, payment_alias;
    * services: service_id, building_id, provider (a company's label), vendor_id (or null), client_number;
    * periods: building_id, year, month of each building's active period.
    """

    buildings: DataFrame
    vendors: DataFrame
    services: DataFrame
    periods: DataFrame

    def settled(self, settle: Settle) -> Directory:
        """The same with names and tax ids normalised, written once."""
        b = self.buildings.select("*", K.digits(F.col("tax_id")).alias("digits"), A.packed_list(F.col("match_names")).alias("aliases"), A.tokens(A.match_text(F.col("canonical_name"))).alias("words"))
        aliases = F.transform("aliases", lambda a: F.struct(a.alias("raw"), A.building_name(a).alias("name"), A.match_text(a).alias("text")))
        v = self.vendors.select("*", K.digits(F.col("tax_id")).alias("digits"), K.provider_name(F.col("canonical_name")).alias("name"))
        names = F.transform(A.packed_list(F.col("match_names")), K.provider_name)
        return Directory(settle(b.withColumn("aliases", aliases)), settle(v.withColumn("names", F.array_union(F.array("name"), names))), self.services, self.periods)


def building_rules(d: Directory) -> list[tuple[int, match.Rule]]:
    """Tax ids in the document's order, the canonical name, contained words, an alias; on what settled() has made."""
    b = d.buildings.withColumnRenamed("building_id", "match_id")
    aliases = b.select("client_id", "match_id", F.posexplode("aliases").alias("at", "a")).select("client_id", "match_id", F.concat_ws(" ", "match_id", "at").alias("alias_id"), "a.name", "a.text", A.tokens(F.col("a.text")).alias("words"))
    by_id = b.where("digits <> ''").select("client_id", "match_id", F.col("digits").alias("tax_id"))
    named = b.select("client_id", "match_id", F.col("canonical_name").alias("name"), "words")
    return [
        (0, lambda x: match.by_tax_id(x, by_id, "client_id")),
        (1, lambda x: match.by_name(x.where("told"), named, "client_id")),
        (2, lambda x: match.by_words(x.where("told"), named, "client_id")),
        (3, lambda x: match.by_alias(x.where("told"), aliases, "client_id")),
    ]


def vendor_rules(d: Directory) -> list[tuple[int, match.Rule]]:
    """Tax ids but for the building's, the document's own tax id unless it is the building's, a name or other name, part of a name."""
    v = d.vendors.withColumnRenamed("vendor_id", "match_id")
    by_id = v.where("digits <> ''").select("client_id", "match_id", F.col("digits").alias("tax_id"))
    named = v.select("client_id", "match_id", "name")
    names = v.select("client_id", "match_id", F.explode("names").alias("name"))
    own = F.when(F.length("own_id") >= 10, F.filter(F.array("own_id"), lambda x: x != F.col("building_tax_id")))
    return [
        (0, lambda x: match.by_tax_id(x.withColumn("tax_ids", F.filter("tax_ids", lambda t: t != F.col("building_tax_id"))), by_id, "client_id")),
        (1, lambda x: match.by_tax_id(x.withColumn("tax_ids", own), by_id, "client_id")),
        (2, lambda x: match.by_name(x.where(F.length("name") >= 3), names, "client_id")),
        (3, lambda x: match.by_part_of_name(x, named, "client_id")),
    ]


def vendor_of_company(docs: DataFrame, d: Directory) -> DataFrame:
    """doc_id and company_vendor: the vendor whose tax id a utility's bill bears, the first in the bill's order."""
    by_id = d.vendors.where("digits <> ''").select("client_id", F.col("vendor_id").alias("match_id"), F.col("digits").alias("tax_id"))
    return match.by_tax_id(docs.where("company is not null"), by_id, "client_id").withColumnRenamed("match_id", "company_vendor")


def services_of(docs: DataFrame, d: Directory) -> DataFrame:
    """doc_id, service_id, service_building and fill_vendor of bills of known companies by their client number.

    With the company's vendor first, then with its label; of several services the
    smallest id. ``fill_vendor`` is the vendor that a service without one gets, for the next run.
    """
    asked = docs.where("company <> 'GENERIC_LSP' and number is not null").select("client_id", "doc_id", "company", "company_vendor", "number")
    s = d.services.select("client_id", "service_id", F.col("building_id").alias("service_building"), F.col("provider").alias("company"), F.col("vendor_id").alias("company_vendor"), F.col("client_number").alias("number"))
    best = F.min(F.struct("service_id", "service_building", F.col("known").alias("known"))).alias("s")
    by_vendor = s.where("company_vendor is not null").withColumn("known", F.col("company_vendor")).drop("company").groupBy("client_id", "company_vendor", "number").agg(best)
    by_label = s.withColumn("known", F.col("company_vendor")).groupBy("client_id", "company", "number").agg(best.alias("t"))
    out = by_sorting(by_sorting(asked, by_vendor, ["client_id", "company_vendor", "number"], "left"), by_label, ["client_id", "company", "number"], "left")
    out = out.withColumn("s", F.coalesce("s", "t")).where("s is not null")
    return out.select("doc_id", "s.service_id", "s.service_building", F.when(F.col("s.known").isNull(), F.col("company_vendor")).alias("fill_vendor"))


def assign(docs: DataFrame, d: Directory, settle: Settle) -> DataFrame:
    """building_id, building_rule, vendor_id, vendor_rule, service_id, fill_vendor, period, assigned, and new_consortium, new_provider, new_tax_id, new_alias of every row.

    ``docs`` has doc_id (unique), client_id, company, consortium, provider,
    provider_tax_id, client_number and all_tax_ids; ``d`` is settled. A bill whose service
    is known takes its building, also where no vendor bears its tax id; the others need
    a building and then a vendor, and a row without either is not assigned. Of a
    building that is found without a vendor the ids stay in the row.
    """
    told = X.js_trim(F.col("consortium"))
    # names are normalised once, however many rows bear them
    said = F.coalesce(told, F.lit(""))
    names = settle(docs.select(said.alias("said")).distinct().select("said", A.building_name(F.col("said")).alias("building_name"), A.match_text(F.col("said")).alias("text")))
    docs = by_sorting(docs.withColumn("said", said), names, "said")
    rows = settle(
        docs.select(
            "doc_id", "client_id", "company", "provider_tax_id", K.client_number(F.col("client_number")).alias("number"), K.usable_tax_ids(F.coalesce("all_tax_ids", F.array().cast("array<string>"))).alias("tax_ids"),
            (F.col("said") != "").alias("told"), "building_name", "text",
            K.digits(F.col("provider_tax_id")).alias("own_id"), K.provider_name(X.js_trim(F.col("provider"))).alias("vendor_name"),
        )
    )
    company = rows.select("doc_id", "client_id", "company", "number", "tax_ids")
    quick = by_sorting(company, vendor_of_company(company, d), "doc_id", "left")
    quick = settle(by_sorting(services_of(quick, d), quick.select("doc_id", "company_vendor"), "doc_id"))
    slow = settle(by_sorting(rows, quick.select("doc_id"), "doc_id", "left_anti"))
    found = match.in_turn(slow.withColumnRenamed("building_name", "name"), building_rules(d), settle)
    placed = by_sorting(slow, found.select("doc_id", F.col("match_id").alias("building_id"), F.col("rule").alias("building_rule")), "doc_id")
    of = d.buildings.select("building_id", F.col("digits").alias("building_tax_id"))
    placed = settle(by_sorting(placed, of, "building_id").withColumnRenamed("vendor_name", "name"))
    vendor = match.in_turn(placed, vendor_rules(d), settle)
    slow = by_sorting(placed.select("doc_id", "building_id", "building_rule"), vendor.select("doc_id", F.col("match_id").alias("vendor_id"), F.col("rule").alias("vendor_rule")), "doc_id", "left")
    slow = slow.withColumns({"service_id": F.lit(None).cast(dict(d.services.dtypes)["service_id"]), "fill_vendor": F.lit(None).cast(dict(d.services.dtypes)["vendor_id"]), "assigned": F.col("vendor_id").isNotNull()})
    quick = quick.select("doc_id", F.col("service_building").alias("building_id"), F.lit(None).cast("int").alias("building_rule"), F.col("company_vendor").alias("vendor_id"), F.lit(None).cast("int").alias("vendor_rule"), "service_id", "fill_vendor", F.lit(True).alias("assigned"))
    names = d.buildings.select("building_id", F.col("raw_name").alias("new_consortium"))
    vendors = d.vendors.select("vendor_id", F.col("canonical_name").alias("vendor_told"), F.col("tax_id").alias("vendor_tax_id"), F.col("payment_alias").alias("new_alias"))
    active = d.periods.select("building_id", K.period_label(F.col("month"), F.col("year")).alias("period"))
    out = by_sorting(by_sorting(by_sorting(slow.unionByName(quick), names, "building_id", "left"), vendors, "vendor_id", "left"), active, "building_id", "left")
    out = by_sorting(rows.select("doc_id", "company", "provider_tax_id"), out, "doc_id", "left")
    by_company: Column = F.when(F.col("service_id").isNotNull(), F.coalesce(X.company_name(F.col("company")), F.col("company")))
    return out.select(
        "doc_id", "building_id", "building_rule", "vendor_id", "vendor_rule", "service_id", "fill_vendor", "period", F.coalesce("assigned", F.lit(False)).alias("assigned"),
        "new_consortium", F.coalesce("vendor_told", by_company).alias("new_provider"), F.coalesce("vendor_tax_id", "provider_tax_id").alias("new_tax_id"), "new_alias",
    )
