"""The building directory of a tenant's sheet: reading, full replacement, orphans, services, imports with row errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions.text import js_trim
from billforge.operators.periods import majority_month

# The tabs of a directory, their columns from A on, and how a cell is read. 'key' and 'code' are
# trimmed, in capitals and needed, 'number' is trimmed and needed, 'text' is trimmed and null where blank.
TABS = {
    "_Consorcios": {"canonical_name": "key", "cuit": "text", "match_names": "text", "payment_alias": "text"},
    "_Proveedores": {"canonical_name": "key", "cuit": "text", "match_names": "text", "payment_alias": "text"},
    "_Rubros": {"name": "key", "description": "text"},
    "_Coeficientes": {"name": "key", "code": "code"},
    "_LspServices": {"consortium_name": "key", "provider": "code", "client_number": "number", "description": "text"},
}
# Headings that name a column of an import of buildings, and of one of vendors.
HEADINGS = {
    "name": ("Nombre", "nombre", "NOMBRE", "canonicalName", "Canonical Name"),
    "cuit": ("CUIT", "cuit", "Cuit"),
    "match_names": ("Aliases", "aliases", "Alias", "alias", "Nombres alternativos"),
    "payment_alias": ("Alias de pago", "alias de pago", "PaymentAlias", "paymentAlias"),
}
VENDOR_HEADINGS = {
    "name": ("Nombre", "nombre", "NOMBRE", "canonicalName", "Razón Social", "Razon Social"),
    "cuit": ("CUIT", "cuit", "Cuit"),
    "match_names": ("Alias", "alias", "ALIAS", "Nombres alternativos"),
    "payment_alias": ("Alias de pago", "alias de pago", "PaymentAlias", "paymentAlias"),
}
LEAST_DIGITS = 10  # of a tax id that is looked for


def missing_tabs(existing: DataFrame, title: str) -> DataFrame:
    """The tabs of a directory that ``existing`` titles lack."""
    spark = existing.sparkSession
    return spark.createDataFrame([(t,) for t in TABS], f"{title} string").join(existing.select(title).distinct(), title, "left_anti")


def read_tab(sheet: DataFrame, tab: str) -> DataFrame:
    """Rows of a tab whose needed cells are not blank; the cells are columns a, b, c and d, all other columns stay."""
    fields = dict(zip("abcd", TABS[tab].items(), strict=False))
    out = sheet.select(*(c for c in sheet.columns if c not in fields), *(js_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, (n, _) in fields.items()))
    for name, kind in fields.values():
        cell = F.upper(name) if kind in ("key", "code") else F.nullif(F.col(name), F.lit("")) if kind == "text" else F.col(name)
        out = out.withColumn(name, cell)
        if kind != "text":
            out = out.where(F.col(name) != "")
    return out


def replaced(target: DataFrame, source: DataFrame, synced: DataFrame, tenant: str) -> DataFrame:
    """``target`` where each ``synced`` tenant has the rows of ``source`` alone, and others what they had."""
    return target.join(synced.select(tenant).distinct(), tenant, "left_anti").unionByName(source.join(synced.select(tenant).distinct(), tenant, "left_semi"))


def orphans(rows: DataFrame, sheet: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the sheet names no more."""
    return rows.join(sheet.select(*keys).distinct(), keys, "left_anti")


def set_null(rows: DataFrame, ref: str, gone: DataFrame, id_: str) -> DataFrame:
    """``rows`` with a null ``ref`` where the row it names is gone."""
    g = gone.select(F.col(id_).alias("_id")).distinct().withColumn("_gone", F.lit(True))
    joined = rows.join(g, rows[ref] == g["_id"], "left")
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == ref else c for c in rows.columns))


def first_periods(buildings: DataFrame, active: DataFrame, *, tenant: str, building: str, now: tuple[int, int]) -> DataFrame:
    """tenant, building, year and month of the periods to open: for each building without an active one its tenant's most frequent month, or ``now``."""
    mode = majority_month(active.select(tenant, "year", "month"), tenant).select(tenant, F.col("year").alias("_y"), F.col("month").alias("_m"))
    new = buildings.select(tenant, building).join(active.select(building), building, "left_anti").join(mode, tenant, "left")
    return new.select(tenant, building, F.coalesce("_y", F.lit(now[0])).cast("long").alias("year"), F.coalesce("_m", F.lit(now[1])).cast("long").alias("month"))


def services(sheet: DataFrame, buildings: DataFrame, vendors: DataFrame, tenant: str) -> DataFrame:
    """Rows of the services tab with consortium_id and provider_id; where the building is unknown, ``warning`` says so and the row is to be left out.

    Of vendors with one name in capitals the largest id stands; an unknown vendor
    is null. Service numbers lose leading zeros unless nothing else is there.
    """
    b = buildings.groupBy(tenant, F.col("consortium_name")).agg(F.max("consortium_id").alias("consortium_id"))
    v = vendors.groupBy(tenant, F.upper("provider_name").alias("provider")).agg(F.max("provider_id").alias("provider_id"))
    out = sheet.join(b, [tenant, "consortium_name"], "left").join(v, [tenant, "provider"], "left")
    said = F.concat(F.lit('LspService ignorado: consorcio "'), "consortium_name", F.lit('" no encontrado para proveedor '), "provider", F.lit(" nro "), "client_number")
    bare = F.regexp_replace("client_number", "^0+", "")
    known = F.col("consortium_id").isNotNull()
    return out.withColumn("warning", F.when(~known, said)).withColumn("client_number", F.when(bare != "", bare).otherwise(F.col("client_number")))


def picked(rows: DataFrame, field: str, headings: dict[str, tuple[str, ...]] = HEADINGS) -> Column:
    """The cell under the first heading of ``field`` that the table has, blank where it is null; null where it has none."""
    name = next((h for h in headings[field] if h in rows.columns), None)
    return F.lit(None).cast("string") if name is None else js_trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))


def import_buildings(rows: DataFrame, existing: DataFrame, *, tenant: str, row: str) -> DataFrame:
    """Each row of an import with its outcome: 'error' with a message for a blank name, 'skipped' where the tenant has
    the name already or an earlier row (by ``row``, from 0) brings it, else 'imported'. Row numbers count the heading.
    """
    read = rows.select(tenant, (F.col(row) + 2).cast("long").alias("row_number"), *(F.nullif(picked(rows, f), F.lit("")).alias(f) for f in HEADINGS))
    first = read.where("name is not null").groupBy(tenant, "name").agg(F.min("row_number").alias("_first"))
    have = existing.select(tenant, "name").distinct().withColumn("_have", F.lit(True))
    out = read.join(first, [tenant, "name"], "left").join(have, [tenant, "name"], "left")
    outcome = F.when(F.col("name").isNull(), "error").when(F.col("_have") | (F.col("_first") < F.col("row_number")), "skipped").otherwise("imported")
    said = F.concat(F.lit("Fila "), F.col("row_number").cast("string"), F.lit(': columna "Nombre" vacía — omitida'))
    return out.select(tenant, "row_number", *HEADINGS, outcome.alias("outcome"), F.when(F.col("name").isNull(), said).alias("message"))


def _bearers(cells: DataFrame, asked: DataFrame, tenant: str) -> DataFrame:
    """tenant, asked and cuit of all pairs of distinct tax ids looked for and cells that contain them.

    Both meet at the first ten digits looked for, so that a cell meets those alone
    that hold its pieces of ten characters.
    """
    at = F.sequence(F.lit(1), F.greatest(F.length("cuit") - LEAST_DIGITS + 1, F.lit(1)))
    pieces = F.array_distinct(F.transform(at, lambda i: F.substring("cuit", i, F.lit(LEAST_DIGITS))))
    held = cells.where(F.length("cuit") >= LEAST_DIGITS).select(tenant, "cuit", F.explode(pieces).alias("piece"))
    met = asked.withColumn("piece", F.substring("asked", 1, LEAST_DIGITS)).join(held, [tenant, "piece"])
    return met.where(F.col("cuit").contains(F.col("asked"))).select(tenant, "asked", "cuit")


def import_vendors(rows: DataFrame, existing: DataFrame, settle: Callable[[DataFrame], DataFrame], *, tenant: str, row: str) -> DataFrame:
    """Each row of an import with its outcome: 'error' with a message for a blank name, else 'skipped' where a vendor has its
    name, or a tax id that contains the row's digits (ten or more), else 'imported'.

    A row's vendors are the tenant's ``existing`` (tenant, name, cuit) and what rows
    before it (by ``row``, from 0) have brought; a skipped row brings nothing. So a
    row's outcome depends on those of earlier rows. Rounds settle them: of each
    name and each tax id the first imported row of the last round decides, and as it is an
    earlier one, each round settles at least the next row that another depends on; rows that
    share a name or a tax id meet in minima alone. ``row`` is unique within a tenant.
    """
    read = rows.select(tenant, F.col(row).cast("long").alias("at"), *(F.nullif(picked(rows, f, VENDOR_HEADINGS), F.lit("")).alias(f) for f in VENDOR_HEADINGS))
    read = settle(read.withColumn("digits", F.regexp_replace(F.coalesce("cuit", F.lit("")), "[^0-9]", "")))
    known = existing.select(tenant, "name", "cuit", F.lit(-1).cast("long").alias("at"))
    named = read.where("name is not null").select(tenant, "at", "name", "cuit", F.when(F.length("digits") >= LEAST_DIGITS, F.col("digits")).alias("asked"))
    cells = known.select(tenant, "cuit").union(named.select(tenant, "cuit")).where("cuit is not null").distinct()
    bearers = settle(_bearers(cells, named.where("asked is not null").select(tenant, "asked").distinct(), tenant))

    def chosen(imported: DataFrame) -> DataFrame:
        """The rows that nothing before them in ``imported`` (tenant, at, name, cuit) forbids."""
        by_name = imported.groupBy(tenant, "name").agg(F.min("at").alias("_n"))
        by_cell = imported.where("cuit is not null").groupBy(tenant, "cuit").agg(F.min("at").alias("_c"))
        by_tax = bearers.join(by_cell, [tenant, "cuit"]).groupBy(tenant, "asked").agg(F.min("_c").alias("_t"))
        told = named.join(by_name, [tenant, "name"], "left").join(by_tax, [tenant, "asked"], "left")
        free = F.coalesce(F.col("_n") >= F.col("at"), F.lit(True)) & F.coalesce(F.col("_t") >= F.col("at"), F.lit(True))
        return told.where(free).select(tenant, "at", "name", "cuit")

    held = known.select(tenant, "at", "name", "cuit")
    last = settle(chosen(held))
    while True:
        new = settle(chosen(held.union(last)))
        if new.select(tenant, "at").exceptAll(last.select(tenant, "at")).isEmpty() and last.select(tenant, "at").exceptAll(new.select(tenant, "at")).isEmpty():
            break
        last = new
    out = read.join(new.select(tenant, "at", F.lit(True).alias("_in")), [tenant, "at"], "left")
    outcome = F.when(F.col("name").isNull(), "error").when(F.col("_in"), "imported").otherwise("skipped")
    number = F.col("at") + 2
    said = F.concat(F.lit("Fila "), number.cast("string"), F.lit(': columna "Nombre" vacía — omitida'))
    return out.select(tenant, number.alias("row_number"), *VENDOR_HEADINGS, outcome.alias("outcome"), F.when(F.col("name").isNull(), said).alias("message"))
