"""The sync of a tenant's directory from its sheet, whole: what the sheet names is merged, replaced or removed, and what refers to it follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.operators import directory

_CELLS = ("cuit", "match_names", "payment_alias")


def _last_rows(cells: DataFrame, title: str, tenant: str) -> DataFrame:
    """A tab's rows; of those with one key the last, as it overwrites the ones before."""
    key, *rest = directory.TABS[title]
    rows = directory.read_tab(cells, title)
    return rows.groupBy(tenant, key).agg(F.max_by(F.struct(*rest), "row").alias("_r")).select(tenant, key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def merged(stored: DataFrame, tab: DataFrame, synced: DataFrame, tenant: str, id_: str, new_id: Column) -> DataFrame:
    """``stored`` (tenant, id, canonical_name, the cells, maybe raw_name) after a tab's rows went over it, with ``orphan``: rows that the tab doesn't name.

    Cells of the tab win, nulls too; a new row's id is ``new_id`` (of tenant and
    canonical_name), its raw name its canonical one. Tenants that aren't synced keep theirs.
    """
    s, t = stored.withColumn("_s", F.lit(True)).alias("s"), tab.withColumn("_t", F.lit(True)).alias("t")
    out = s.join(t, [tenant, "canonical_name"], "full").join(synced.withColumn("_on", F.lit(True)), tenant, "left")
    raw = [F.coalesce("s.raw_name", "canonical_name").alias("raw_name")] if "raw_name" in stored.columns else []
    cells = [F.when(F.col("t._t"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in _CELLS]
    orphan = F.col("_on").isNotNull() & F.col("t._t").isNull()
    return out.where("_s or _on").select(tenant, F.coalesce(F.col(f"s.{id_}"), new_id).alias(id_), "canonical_name", *raw, *cells, orphan.alias("orphan"))


def sync(stored: dict[str, DataFrame], tabs: dict[str, DataFrame], synced: DataFrame, settle: Callable[[DataFrame], DataFrame], *, now: tuple[int, int], new_id: Column, tenant: str = "client_id") -> dict[str, DataFrame]:
    """The tables buildings, vendors, rubros, coeficientes, services, periods and invoices after the sheets of the ``synced`` tenants were read, and warnings.

    ``tabs`` are cells by tab's title (tenant, row, a, b, c, d); ``stored`` has these tables:
    buildings and vendors as merged() takes them, periods (tenant, building_id, year, month, status), the
    catalogs with the tabs' fields, services, and invoices with building_id, vendor_id, rubro, coeficiente and service.

    * catalogs and services are replaced, so invoices lose what they named of them;
    * buildings and vendors are merged by name, and those that the sheet names no more are removed with their
      periods; invoices lose them;
    * a building without an active period gets the tenant's most frequent month, counted with those that
      are then removed, or ``now``;
    * services name buildings and vendors as they are after that; unknown buildings are warnings.

    Where a sheet has a name twice, its last row stands. The caller publishes the tables together.
    """
    own = synced.select(tenant).distinct()
    read = {t: _last_rows(tabs[t].join(own, tenant, "left_semi"), t, tenant) for t in ("_Consorcios", "_Proveedores", "_Rubros", "_Coeficientes")}
    buildings = settle(merged(stored["buildings"], read["_Consorcios"], own, tenant, "building_id", new_id))
    vendors = settle(merged(stored["vendors"], read["_Proveedores"], own, tenant, "vendor_id", new_id))
    active = stored["periods"].where("status = 'ACTIVE'")
    opened = directory.first_periods(buildings.join(own, tenant, "left_semi"), active, tenant=tenant, building="building_id", now=now).withColumn("status", F.lit("ACTIVE"))
    gone, gone_v = buildings.where("orphan").select("building_id"), vendors.where("orphan").select("vendor_id")
    periods = stored["periods"].unionByName(opened).join(gone, "building_id", "left_anti")
    kept, kept_v = buildings.where("not orphan").drop("orphan"), vendors.where("not orphan").drop("orphan")
    named = kept.select(tenant, F.col("building_id").alias("consortium_id"), F.col("canonical_name").alias("consortium_name"))
    known = kept_v.select(tenant, F.col("vendor_id").alias("provider_id"), F.col("canonical_name").alias("provider_name"))
    told = settle(directory.services(directory.read_tab(tabs["_LspServices"], "_LspServices").join(own, tenant, "left_semi"), named, known, tenant))
    services = told.where("warning is null").select(tenant, F.col("consortium_id").alias("building_id"), "provider", F.col("provider_id").alias("vendor_id"), "client_number", "description")
    invoices = directory.set_null(directory.set_null(stored["invoices"], "building_id", gone, "building_id"), "vendor_id", gone_v, "vendor_id")
    invoices = invoices.join(own.withColumn("_on", F.lit(True)), tenant, "left").withColumns({c: F.when(F.col("_on").isNull(), F.col(c)) for c in ("rubro", "coeficiente", "service")})
    return {
        "buildings": kept, "vendors": kept_v, "periods": periods, "services": directory.replaced(stored["services"], services, own, tenant),
        "rubros": directory.replaced(stored["rubros"], read["_Rubros"], own, tenant), "coeficientes": directory.replaced(stored["coeficientes"], read["_Coeficientes"], own, tenant),
        "invoices": invoices.select(stored["invoices"].columns), "warnings": told.where("warning is not null").select(tenant, "warning"),
    }


def created_buildings(rows: DataFrame, existing: DataFrame, active: DataFrame, *, now: tuple[int, int], tenant: str = "client_id") -> tuple[DataFrame, DataFrame]:
    """The buildings of ``rows`` (tenant, building_id, canonical_name, raw_name, cuit, cutoff_day) as they are made, and their first periods.

    A missing raw name is the canonical one, a missing day the fifth. A name that the
    tenant has already is refused; names are unique in ``rows``. Periods have the tenant's most frequent active month, or ``now``.
    """
    new = rows.join(existing.select(tenant, "canonical_name"), [tenant, "canonical_name"], "left_anti")
    new = new.withColumns({"raw_name": F.coalesce("raw_name", "canonical_name"), "cutoff_day": F.coalesce("cutoff_day", F.lit(5))})
    return new, directory.first_periods(new, active, tenant=tenant, building="building_id", now=now).withColumn("status", F.lit("ACTIVE"))
