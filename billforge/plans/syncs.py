"""Registered queries of whole syncs, new buildings and tenants, nested rows and counts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions import text as X
from billforge.operators import edits, pages, periods, sync
from billforge.plans.queries import _ACT, _INV, _PER, query
from billforge.sources import tables as T

@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, upper(c_name) AS name, c_acctbal FROM customer), v AS (SELECT s_nationkey AS n, s_suppkey AS k, upper(s_name) AS name FROM supplier),
 sb AS (SELECT * FROM c WHERE k % 5 <> 0), tb AS (SELECT * FROM c WHERE k % 7 <> 3 AND n < 20), sv AS (SELECT * FROM v WHERE k % 5 <> 0), tv AS (SELECT * FROM v WHERE k % 7 <> 3 AND n < 20),
 b AS (SELECT coalesce(sb.n, tb.n) AS n, coalesce('b' || sb.k, 'new ' || tb.n || ' ' || tb.name) AS id, coalesce(sb.name, tb.name) AS name, CASE WHEN tb.k IS NOT NULL THEN CASE WHEN tb.k % 2 = 0 THEN '33-' || tb.k END ELSE 'old' END AS cuit, coalesce(sb.n, tb.n) < 20 AND tb.k IS NULL AS orphan,
  CASE WHEN sb.k IS NOT NULL THEN 'Raw ' || sb.k ELSE tb.name END AS raw FROM sb FULL JOIN tb ON sb.n = tb.n AND sb.name = tb.name),
 p AS (SELECT coalesce(sv.n, tv.n) AS n, coalesce('v' || sv.k, 'new ' || tv.n || ' ' || tv.name) AS id, coalesce(sv.name, tv.name) AS name, coalesce(sv.n, tv.n) < 20 AND tv.k IS NULL AS orphan FROM sv FULL JOIN tv ON sv.n = tv.n AND sv.name = tv.name),
 act AS (SELECT n, 'b' || k AS id, 1992 + k % 3 AS y, 1 + k % 2 AS m FROM sb WHERE k % 4 > 0), mo AS (SELECT n, y, m FROM (SELECT n, y, m, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, y, m) AS r FROM act GROUP BY 1, 2, 3) WHERE r = 1),
 per AS (SELECT act.n, act.id, y, m FROM act WHERE id NOT IN (SELECT id FROM b WHERE orphan) UNION ALL SELECT b.n, b.id, coalesce(mo.y, 2024), coalesce(mo.m, 5) FROM b LEFT JOIN mo ON mo.n = b.n WHERE b.n < 20 AND NOT orphan AND b.id NOT IN (SELECT id FROM act)),
 l AS (SELECT c.n, c.name, p.name AS provider, lpad(CAST(c.k AS VARCHAR), 6, '0') AS num FROM c JOIN v AS p ON p.k = c.k % 50 WHERE c.n < 20),
 s AS (SELECT l.n, b.id AS b, l.provider, p.id AS v, CASE WHEN ltrim(num, '0') = '' THEN num ELSE ltrim(num, '0') END AS num FROM l JOIN b ON b.n = l.n AND b.name = l.name AND NOT b.orphan LEFT JOIN p ON p.n = l.n AND p.name = l.provider AND NOT p.orphan),
 i AS (SELECT o_orderkey AS k, c_nationkey AS n, 'b' || o_custkey AS b, 'v' || o_orderkey % 100 AS v FROM orders JOIN customer ON c_custkey = o_custkey)
 SELECT 'building' AS name, CAST(n AS BIGINT) AS client_id, id, concat_ws('/', name, raw, coalesce(cuit, '')) AS told FROM b WHERE NOT orphan UNION ALL SELECT 'vendor', n, id, name FROM p WHERE NOT orphan UNION ALL SELECT 'period', n, id, y || '-' || m FROM per
 UNION ALL SELECT 'service', n, b, provider || '/' || coalesce(v, '') || '/' || num FROM s UNION ALL SELECT 'service', n, 'kept', 'OLD//7' FROM (SELECT DISTINCT n FROM c WHERE n >= 20)
 UNION ALL SELECT 'rubro', n, 'R' || n, CASE WHEN n < 20 THEN 'said' ELSE 'old' END FROM (SELECT DISTINCT n FROM c)
 UNION ALL SELECT 'coeficiente', n, CASE WHEN n < 20 THEN 'A' ELSE 'OLD' END, CASE WHEN n < 20 THEN 'C' || n ELSE 'OLD' END FROM (SELECT DISTINCT n FROM c)
 UNION ALL SELECT 'invoice', n, CAST(k AS VARCHAR), coalesce(CASE WHEN b NOT IN (SELECT id FROM b WHERE orphan) THEN b END, '') || '/' || coalesce(CASE WHEN v NOT IN (SELECT id FROM p WHERE orphan) THEN v END, '') || '/' || CASE WHEN n < 20 THEN '' ELSE 'r' END FROM i
 UNION ALL SELECT 'warning', l.n, '', 'LspService ignorado: consorcio "' || l.name || '" no encontrado para proveedor ' || l.provider || ' nro ' || num FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.n = l.n AND b.name = l.name AND NOT b.orphan)""")
def q_directory_sync(spark: SparkSession, d: str) -> DataFrame:
    """All tables of the directory after the sheets of twenty tenants were read."""
    c, v = T.read(spark, d, "customer"), T.read(spark, d, "supplier")
    ck, sk = F.col("c_custkey"), F.col("s_suppkey")
    cn, sn = F.col("c_nationkey").cast("long").alias("client_id"), F.col("s_nationkey").cast("long").alias("client_id")
    null, old = F.lit(None).cast("string"), F.lit("old")
    buildings = c.where(ck % 5 != 0).select(cn, F.concat(F.lit("b"), ck.cast("string")).alias("building_id"), F.upper("c_name").alias("canonical_name"), F.concat(F.lit("Raw "), ck.cast("string")).alias("raw_name"), old.alias("cuit"), null.alias("match_names"), null.alias("payment_alias"))
    vendors = v.where(sk % 5 != 0).select(sn, F.concat(F.lit("v"), sk.cast("string")).alias("vendor_id"), F.upper("s_name").alias("canonical_name"), old.alias("cuit"), null.alias("match_names"), null.alias("payment_alias"))
    orders = T.read(spark, d, "orders").join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    clients = c.select(cn).distinct()
    stored = {
        "buildings": T.settled(buildings), "vendors": vendors,
        "periods": c.where((ck % 5 != 0) & (ck % 4 > 0)).select(cn, F.concat(F.lit("b"), ck.cast("string")).alias("building_id"), (1992 + ck % 3).alias("year"), (1 + ck % 2).alias("month"), F.lit("ACTIVE").alias("status")),
        "rubros": clients.select("client_id", F.concat(F.lit("R"), "client_id").alias("name"), old.alias("description")), "coeficientes": clients.select("client_id", F.lit("OLD").alias("name"), F.lit("OLD").alias("code")),
        "services": clients.select("client_id", F.lit("kept").alias("building_id"), F.lit("OLD").alias("provider"), null.alias("vendor_id"), F.lit("7").alias("client_number"), null.alias("description")),
        "invoices": orders.select(cn, F.col("o_orderkey").cast("string").alias("invoice_id"), F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("building_id"), F.concat(F.lit("v"), (F.col("o_orderkey") % 100).cast("string")).alias("vendor_id"), F.lit("r").alias("rubro"), F.lit("c").alias("coeficiente"), F.lit("s").alias("service")),
    }

    def tab(rows: DataFrame, tenant, row, *cells) -> DataFrame:
        return rows.select(tenant, row.alias("row"), *(x.alias(n) for n, x in zip("abcd", (*cells, null, null, null), strict=False)))

    pairs = c.join(v.select(sk.alias("_s"), "s_name"), F.col("_s") == ck % 50)
    tabs = {
        "_Consorcios": tab(c.where(ck % 7 != 3), cn, ck, F.concat(F.lit(" "), F.lower("c_name")), F.when(ck % 2 == 0, F.concat(F.lit("33-"), ck.cast("string"))).otherwise(" ")),
        "_Proveedores": tab(v.where(sk % 7 != 3), sn, sk, F.lower("s_name")),
        "_Rubros": tab(clients, F.col("client_id"), F.lit(1), F.concat(F.lit("r"), "client_id"), F.lit(" said")), "_Coeficientes": tab(clients, F.col("client_id"), F.lit(1), F.lit("a"), F.concat(F.lit("c"), "client_id")),
        "_LspServices": tab(pairs, cn, ck, F.col("c_name"), F.col("s_name"), F.lpad(ck.cast("string"), 6, "0")),
    }
    new_id = F.concat_ws(" ", F.lit("new"), F.col("client_id").cast("string"), "canonical_name")
    out = sync.sync(stored, tabs, clients.where("client_id < 20"), T.settled, now=(2024, 5), new_id=new_id)
    blank = lambda x: F.coalesce(x, F.lit(""))
    told = {
        "buildings": ("building_id", F.concat_ws("/", "canonical_name", "raw_name", blank("cuit"))), "vendors": ("vendor_id", F.col("canonical_name")), "periods": ("building_id", F.concat_ws("-", "year", "month")),
        "services": ("building_id", F.concat_ws("/", "provider", blank("vendor_id"), "client_number")), "rubros": ("name", F.col("description")), "coeficientes": ("name", F.col("code")),
        "invoices": ("invoice_id", F.concat_ws("/", blank("building_id"), blank("vendor_id"), blank("rubro"))), "warnings": (None, F.col("warning")),
    }
    rows = None
    for name, (id_, text) in told.items():
        part = out[name].select(F.lit(name.removesuffix("s") if name != "coeficientes" else "coeficiente").alias("name"), "client_id", (F.col(id_) if id_ else F.lit("")).alias("id"), text.alias("told"))
        rows = part if rows is None else rows.union(part)
    return rows


@query(f"""WITH {_PER}, {_ACT}, a AS (SELECT act.year, act.month, c_nationkey AS n FROM act JOIN customer ON c_custkey = consortium_id), mo AS (SELECT n, year, month FROM (SELECT n, year, month, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, year, month) AS r FROM a GROUP BY n, year, month) WHERE r = 1),
 r AS (SELECT s_suppkey AS k, s_nationkey % 30 AS n, CASE WHEN s_suppkey % 4 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' bis' END AS raw FROM supplier)
 SELECT r.k AS building_id, CAST(r.n AS BIGINT) AS client_id, name, coalesce(raw, name) AS raw_name, CAST(CASE WHEN r.k % 2 = 0 THEN 10 ELSE 5 END AS BIGINT) AS cutoff_day, CAST(coalesce(mo.year, 2024) AS BIGINT) AS year, CAST(coalesce(mo.month, 5) AS BIGINT) AS month
 FROM r LEFT JOIN mo ON mo.n = r.n WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = r.n AND c_name = name)""")
def q_new_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Buildings made one by one, with their first period."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.col("s_name"))
    new = T.read(spark, d, "supplier").select((-k - 1).alias("building_id"), (F.col("s_nationkey") % 30).alias("client_id"), name.alias("canonical_name"), F.when(k % 3 == 0, F.concat("s_name", F.lit(" bis"))).alias("raw_name"), F.when(k % 2 == 0, 10).alias("cutoff_day"))
    have = T.consortiums(spark, d).withColumnRenamed("consortium_name", "canonical_name")
    active = periods.active_period(T.periods(spark, d), "consortium_id").join(have, "consortium_id").select("client_id", F.col("consortium_id").alias("building_id"), "year", "month")
    made, first = sync.created_buildings(new, have, active, now=(2024, 5))
    out = made.join(first.select("building_id", "year", "month"), "building_id")
    return out.select((-F.col("building_id") - 1).alias("building_id"), F.col("client_id").cast("long").alias("client_id"), F.col("canonical_name").alias("name"), "raw_name", F.col("cutoff_day").cast("long").alias("cutoff_day"), F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


@query("""WITH r AS (SELECT o_orderkey AS k, 'user' || o_custkey || '@x.org' AS mail, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1440 + 1 ELSE 60 END AS mins FROM orders),
 h AS (SELECT DISTINCT 'user' || c_custkey || '@x.org' AS mail FROM customer WHERE c_acctbal > 5000)
 SELECT k AS client_id, mail AS email, true AS enabled, CAST(mins AS BIGINT) AS interval_minutes FROM r WHERE n = 1 AND mail NOT IN (SELECT mail FROM h)""")
def q_new_tenants(spark: SparkSession, d: str) -> DataFrame:
    """Requests for new tenants in order: e-mails are unique whatever their case, and each tenant that is made gets its scheduler's row."""
    k = F.col("o_orderkey")
    asked = T.read(spark, d, "orders").select(k.alias("seq"), k.alias("id"), F.concat(F.when(k % 2 == 0, "USER").otherwise("user"), F.col("o_custkey").cast("string"), F.lit("@X.org")).alias("email"), F.when(k % 3 == 0, k % 1440 + 1).alias("interval_minutes"), F.lit("create").alias("op"))
    have = T.read(spark, d, "customer").where("c_acctbal > 5000").select((F.col("c_custkey") - 1_000_000_000).alias("seq"), (-F.col("c_custkey") - 1).alias("id"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email"), F.lit(None).cast("long").alias("interval_minutes"), F.lit("save").alias("op"))
    log = asked.union(have).select(F.lit("all").alias("tenant"), "seq", "id", "op", F.lower("email").alias("key"), "interval_minutes")
    made = edits.replay(log, T.settled).where("ok and op = 'create'")
    return made.select(F.col("id").alias("client_id"), F.col("key").alias("email"), F.lit(True).alias("enabled"), F.coalesce("interval_minutes", F.lit(60)).cast("long").alias("interval_minutes"))


@query(f"""WITH {_PER}, {_INV}, i AS (SELECT consortium_id, count(*) AS n FROM inv GROUP BY 1), p AS (SELECT consortium_id, string_agg(year || '-' || lpad(CAST(month AS VARCHAR), 2, '0'), ',' ORDER BY year DESC, month DESC) AS l FROM per GROUP BY 1)
 SELECT c_custkey AS consortium_id, c_name AS consortium_name, coalesce(l, '') AS periods, coalesce(n, 0) AS n_invoices FROM customer LEFT JOIN p ON p.consortium_id = c_custkey LEFT JOIN i ON i.consortium_id = c_custkey""")
def q_buildings_nested(spark: SparkSession, d: str) -> DataFrame:
    """Each building with its periods, newest first, and how many invoices it has."""
    out = pages.with_children(T.consortiums(spark, d), T.periods(spark, d), "consortium_id", ["year", "month"], "periods")
    n = T.invoices(spark, d).groupBy("consortium_id").agg(F.count(F.lit(1)).alias("n_invoices"))
    told = F.array_join(F.transform("periods", lambda p: F.concat(p["year"].cast("string"), F.lit("-"), F.lpad(p["month"].cast("string"), 2, "0"))), ",")
    return out.join(n, "consortium_id", "left").select("consortium_id", "consortium_name", told.alias("periods"), F.coalesce("n_invoices", F.lit(0)).alias("n_invoices"))


@query(f"""WITH {_PER}, {_ACT}, a AS (SELECT act.*, c_nationkey AS n FROM act JOIN customer ON c_custkey = consortium_id), mo AS (SELECT n, year AS y, month AS m FROM (SELECT n, year, month, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, year, month) AS r FROM a GROUP BY n, year, month) WHERE r = 1)
 SELECT CAST(a.n AS BIGINT) AS client_id, count(*) FILTER (WHERE year = y AND month = m) AS n_to_close, count(*) FILTER (WHERE NOT (year = y AND month = m)) AS n_to_skip,
  any_value(CASE WHEN m = 12 THEN 'Enero ' || (y + 1) ELSE list_extract(['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre'], m + 1) || ' ' || y END) AS next_label FROM a JOIN mo ON mo.n = a.n GROUP BY 1""")
def q_close_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many periods of each tenant a general close would close and skip, and the month it would open."""
    active = periods.active_period(T.periods(spark, d), "consortium_id").join(T.consortiums(spark, d).select("consortium_id", "client_id"), "consortium_id")
    mode = periods.majority_month(active, "client_id").select("client_id", F.col("year").alias("majority_year"), F.col("month").alias("majority_month"))
    return periods.close_counts(periods.close_all(active.join(mode, "client_id")), "client_id").withColumn("client_id", F.col("client_id").cast("long"))


@query(f"""WITH {_INV}, d AS (SELECT *, 'B-' || l_orderkey % 500 AS number, 'Prov ' || provider_id AS provider, count(*) OVER (PARTITION BY consortium_id, l_orderkey % 500, amount) > 1 AS dup FROM inv)
 SELECT consortium_id, count(*) AS n_found, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS total, count(*) FILTER (WHERE dup) AS n_duplicates FROM d WHERE contains(lower(number), 'b-12') OR contains(lower(provider), 'v 12') GROUP BY 1""")
def q_found_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a search finds of each building's invoices: their number, their total and how many are duplicates."""
    inv = T.invoices(spark, d).withColumns({"number": F.concat(F.lit("B-"), (F.col("l_orderkey") % 500).cast("string")), "provider": F.concat(F.lit("Prov "), F.col("provider_id").cast("string"))})
    keys = inv.groupBy("consortium_id", "number", "amount").agg(F.count(F.lit(1)).alias("same"))
    rows = inv.join(keys, ["consortium_id", "number", "amount"]).withColumn("is_duplicate", F.col("same") > 1)
    return pages.found_totals(rows.where(pages.search(["number", "provider"], [], "B-12") | pages.search(["number", "provider"], [], "V 12")), "consortium_id")


@query(r"""WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Razón Social: Consorcio de Propietarios' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '30-1/2' || chr(10) || 'Total 5' || chr(10) WHEN 1 THEN 'CUIT 7' || chr(10) || 'ESQUINA ' || doc_id || chr(10) ELSE '' END
   WHEN doc_id % 3 = 0 THEN 'Social:' || chr(10) || 'RAZON  SOCIAL: Raz. ' || source || chr(10) WHEN doc_id % 3 = 1 THEN 'social 5' || chr(10) ELSE 'RAZON SOCIAL: ' || source || chr(10) END || coalesce(text, '') AS t FROM documents),
 l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[\t\x0B\f\r \x{00A0}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM h),
 s AS (SELECT doc_id, ls, i, trim(regexp_replace(regexp_replace(ls[i], '^[^:]*:', ''), '(?i)^raz.{0,2}n\s*social\s*:\s*', '')) AS v FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l) WHERE contains(lower(ls[i]), 'social') AND contains(ls[i], ':')),
 f AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i FROM s WHERE v <> '' GROUP BY 1),
 n AS (SELECT f.doc_id, v, list_extract(list_filter(ls[f.i + 1:f.i + 7], lambda x: NOT regexp_matches(x, '(?i)^(cuit|iva|fecha|cae|comprobante|subtotal|total|domicilio|condici[oó]n|ingresos|inicio|punto de venta|c[oó]digo|regimen|otros impuestos|hys)([^A-Za-z0-9_]|$)')
   AND NOT regexp_matches(replace(x, ' ', ''), '^[0-9./-]+$') AND regexp_matches(x, '[A-Za-zÁÉÍÓÚáéíóúÑñ]')), 1) AS more FROM f JOIN l USING (doc_id))
 SELECT l.doc_id, CASE WHEN regexp_matches(lower(trim(regexp_replace(v, '[.,:; ]+', ' ', 'g'))), '^(cons|consorcio)( de)? prop(ietarios)?$') THEN concat_ws(' ', v, more) ELSE v END AS building FROM l LEFT JOIN n ON n.doc_id = l.doc_id""")
def q_label_lines(spark: SparkSession, d: str) -> DataFrame:
    """The business that each text names in a labelled line; a generic name gets the next telling line."""
    i = F.col("doc_id")
    generic = F.concat(F.lit("Razón Social: Consorcio de Propietarios\n"), F.when(i % 3 == 0, "30-1/2\nTotal 5\n").when(i % 3 == 1, F.concat(F.lit("CUIT 7\nESQUINA "), i.cast("string"), F.lit("\n"))).otherwise(""))
    own = F.when(i % 3 == 0, F.concat(F.lit("Social:\nRAZON  SOCIAL: Raz. "), "source", F.lit("\n"))).when(i % 3 == 1, "social 5\n").otherwise(F.concat(F.lit("RAZON SOCIAL: "), "source", F.lit("\n")))
    docs = T.read(spark, d, "documents").select("doc_id", X.plain_lines(F.concat(F.when(i % 2 == 0, generic).otherwise(own), F.coalesce("text", F.lit("")))).alias("lines"))
    return docs.select("doc_id", X.building_from_lines(F.col("lines")).alias("building"))
