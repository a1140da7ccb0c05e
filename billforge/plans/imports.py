"""Registered queries of imports, saves under two keys and edits one by one, each beside SQL that walks the rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions import text as X
from billforge.operators import directory, edits
from billforge.operators.numbering import numbered
from billforge.plans.queries import query
from billforge.sources import tables as T

# Customers in three tenants as rows of a sheet of vendors; every tenth supplier is a vendor already.
_NAMES, _TAX = 97, 41


@query(rf"""WITH RECURSIVE f AS (SELECT c_nationkey % 3 AS client_id, row_number() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_custkey) - 1 AS pos, CASE WHEN c_custkey % 50 <> 0 THEN 'Proveedor ' || c_custkey * 7 % {_NAMES} END AS name,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '30-' || lpad(CAST(c_custkey % {_TAX} AS VARCHAR), 8, '0') || '-1' WHEN 5 THEN '12345' WHEN 4 THEN '30' || lpad(CAST(c_custkey % {_TAX} AS VARCHAR), 8, '0') || '1' || CAST(c_custkey % 4 AS VARCHAR)
   ELSE '30' || lpad(CAST(c_custkey % {_TAX} AS VARCHAR), 8, '0') || '1' END AS cuit FROM customer),
 d AS (SELECT *, regexp_replace(coalesce(cuit, ''), '[^0-9]', '', 'g') AS digits FROM f),
 e AS (SELECT s_nationkey % 3 AS client_id, list(struct_pack(name := 'Proveedor ' || s_suppkey, cuit := '30' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1')) AS have FROM supplier WHERE s_suppkey % 10 = 0 GROUP BY 1),
 w AS (SELECT client_id, CAST(-1 AS BIGINT) AS pos, coalesce(have, CAST([] AS STRUCT(name VARCHAR, cuit VARCHAR)[])) AS have, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT client_id FROM d) LEFT JOIN e USING (client_id)
  UNION ALL SELECT client_id, pos, CASE WHEN outcome = 'imported' THEN list_append(have, struct_pack(name := name, cuit := cuit)) ELSE have END, outcome FROM (
   SELECT w.client_id, d.pos, have, name, cuit, CASE WHEN name IS NULL THEN 'error' WHEN len(list_filter(have, lambda v: v.name = d.name OR (length(digits) >= 10 AND contains(v.cuit, digits)))) > 0 THEN 'skipped' ELSE 'imported' END AS outcome
   FROM w JOIN d ON d.client_id = w.client_id AND d.pos = w.pos + 1) AS x)
 SELECT CAST(d.client_id AS INTEGER) AS client_id, d.pos + 2 AS row_number, name, cuit, w.outcome, CASE WHEN name IS NULL THEN 'Fila ' || (d.pos + 2) || ': columna "Nombre" vacía — omitida' END AS message FROM d JOIN w ON w.client_id = d.client_id AND w.pos = d.pos""")
def q_import_vendors(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of vendors read in order: what each row becomes, given those before it."""
    k = F.col("c_custkey")
    tax = F.concat(F.lit("30"), F.lpad((k % _TAX).cast("string"), 8, "0"), F.lit("1"))
    dashed = F.concat(F.lit("30-"), F.lpad((k % _TAX).cast("string"), 8, "0"), F.lit("-1"))
    cuit = F.when(k % 6 == 0, "").when(k % 6 == 1, dashed).when(k % 6 == 5, " 12345 ").when(k % 6 == 4, F.concat(tax, (k % 4).cast("string"))).otherwise(tax)
    sheet = T.read(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("client_id"), k.alias("key"), F.when(k % 50 != 0, F.concat(F.lit(" Proveedor "), (k * 7 % _NAMES).cast("string"))).alias("Razón Social"), cuit.alias("CUIT"))
    sheet = numbered(T.settled(sheet), "client_id", ["key"], T.settled, place="row")
    s = F.col("s_suppkey")
    have = T.read(spark, d, "supplier").where(s % 10 == 0).select((F.col("s_nationkey") % 3).alias("client_id"), F.concat(F.lit("Proveedor "), s.cast("string")).alias("name"), F.concat(F.lit("30"), F.lpad(s.cast("string"), 8, "0"), F.lit("1")).alias("cuit"))
    out = directory.import_vendors(sheet, have, T.settled, tenant="client_id", row="row")
    return out.select("client_id", "row_number", "name", "cuit", "outcome", "message")


# --- edits in order ---------------------------------------------------------------------------------------

_STATE = "CAST([] AS STRUCT(id BIGINT, k VARCHAR, v VARCHAR)[])"


def _walk(log: str, out: str) -> str:
    """SQL that walks ``log`` (tenant, seq, id, op, k, v) in order with a list of live rows; the state ends in ``w``."""
    return f"""WITH RECURSIVE {log}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS n FROM log),
 w AS (SELECT tenant, CAST(0 AS BIGINT) AS n, {_STATE} AS st, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT tenant FROM n)
  UNION ALL SELECT tenant, n, CASE WHEN reason IS NOT NULL THEN st WHEN op = 'delete' THEN list_filter(st, lambda r: r.id <> id) WHEN op = 'create' OR NOT live THEN list_append(st, struct_pack(id := id, k := k, v := v))
    WHEN op = 'save' THEN list_transform(st, lambda r: CASE WHEN r.id = id THEN struct_pack(id := id, k := k, v := v) ELSE r END) ELSE list_transform(st, lambda r: CASE WHEN r.id = id THEN struct_pack(id := id, k := coalesce(k, r.k), v := coalesce(v, r.v)) ELSE r END) END, seq, reason FROM (
   SELECT *, CASE WHEN op IN ('patch', 'delete') AND NOT live THEN 'not found' WHEN op = 'create' AND live THEN 'exists' WHEN op <> 'delete' AND k IS NOT NULL AND len(list_filter(st, lambda r: r.id <> id AND r.k = k)) > 0 THEN 'duplicate' END AS reason FROM (
    SELECT n.*, st, len(list_filter(st, lambda r: r.id = n.id)) > 0 AS live FROM w JOIN n ON n.tenant = w.tenant AND n.n = w.n + 1) AS x) AS y)
 {out}"""


_EDITS_SQL = """log AS (SELECT o_custkey % 25 AS tenant, o_orderkey AS seq, CASE WHEN o_orderkey % 7 < 4 THEN o_orderkey ELSE o_orderkey - 25 * (o_orderkey % 3 + 1) END AS id, CASE WHEN o_orderkey % 7 < 4 THEN 'create' WHEN o_orderkey % 7 < 6 THEN 'patch' ELSE 'delete' END AS op,
  CASE WHEN o_orderkey % 7 < 5 THEN 'RUBRO ' || o_orderkey // 4 % 90 END AS k, CASE WHEN o_orderkey % 7 IN (1, 5) THEN o_orderpriority END AS v FROM orders)"""


def _catalog_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as edits of a catalog: entries made, renamed, described and deleted, names in any case and with blanks."""
    o, kind = F.col("o_orderkey"), F.col("o_orderkey") % 7
    name = F.concat(F.lit("  rubro "), (F.floor(o / 4) % 90).cast("string"), F.lit(" "))
    log = T.read(spark, d, "orders").select(
        (F.col("o_custkey") % 25).alias("tenant"), o.alias("seq"), F.when(kind < 4, o).otherwise(o - 25 * (o % 3 + 1)).alias("id"), F.when(kind < 4, "create").when(kind < 6, "patch").otherwise("delete").alias("op"),
        F.when(kind < 5, F.upper(X.js_trim(name))).alias("key"), F.when(kind.isin(1, 5), X.js_trim(F.concat(F.lit(" "), "o_orderpriority"))).alias("description"),
    )
    return log


@query(_walk(_EDITS_SQL, "SELECT tenant, seq, reason FROM w WHERE n > 0"))
def q_catalog_edits(spark: SparkSession, d: str) -> DataFrame:
    """Each edit of a tenant's catalog in order, and why it is refused, if it is."""
    return edits.replay(_catalog_log(spark, d), T.settled).select("tenant", "seq", "reason")


@query(_walk(_EDITS_SQL, ", e AS (SELECT tenant, unnest(st) AS r FROM w WHERE (tenant, n) IN (SELECT tenant, max(n) FROM w GROUP BY 1)) SELECT tenant, r.id AS id, r.k AS name, r.v AS description FROM e"))
def q_catalog_after(spark: SparkSession, d: str) -> DataFrame:
    """The catalogs after all edits."""
    out = edits.snapshot(edits.replay(_catalog_log(spark, d), T.settled), ["description"])
    return out.select("tenant", "id", F.col("key").alias("name"), "description")


_SAVES_SQL = """log AS (SELECT o_custkey % 20 AS tenant, o_orderkey AS seq, o_custkey % 60 AS id, 'save' AS op, CASE WHEN o_orderkey % 11 > 0 THEN 'k' || CAST(floor(o_totalprice) AS BIGINT) % 70 END AS k, o_orderstatus AS v FROM orders
  UNION ALL SELECT c_nationkey % 20, c_custkey - 1000000000, 100 + c_custkey, 'save', 'k' || c_custkey, 'S' FROM customer)"""


@query(_walk(_SAVES_SQL, "SELECT tenant, seq, reason FROM w WHERE n > 0 AND seq > 0"))
def q_save_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """Invoices saved one after the other under a content's and a business key: which of them the second key refuses."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    key = F.when(o % 11 > 0, F.concat(F.lit("k"), (F.floor("o_totalprice") % 70).cast("string")))
    log = T.read(spark, d, "orders").select((F.col("o_custkey") % 20).cast("int").alias("tenant"), o.alias("seq"), (F.col("o_custkey") % 60).alias("id"), F.lit("save").alias("op"), key.alias("key"))
    stored = T.read(spark, d, "customer").select((F.col("c_nationkey") % 20).alias("tenant"), (c - 1000000000).alias("seq"), (100 + c).alias("id"), F.lit("save").alias("op"), F.concat(F.lit("k"), c.cast("string")).alias("key"))
    return edits.replay(log.union(stored), T.settled).where("seq > 0").select(F.col("tenant").cast("long").alias("tenant"), "seq", "reason")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey // 5 AS invoice, CASE WHEN o_orderstatus <> 'F' THEN 'file' || o_orderkey END AS f, CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.org/' || o_orderkey END AS u FROM orders)
 SELECT o_custkey % 25 AS client_id, invoice, arg_max(struct_pack(f := f), o_orderkey).f AS file_id, CASE WHEN arg_max(struct_pack(f := f), o_orderkey).f IS NOT NULL THEN coalesce(arg_max(struct_pack(u := u), o_orderkey).u, 'https://drive.google.com/file/d/' || arg_max(struct_pack(f := f), o_orderkey).f || '/view') END AS file_url FROM l GROUP BY 1, 2""")
def q_receipts(spark: SparkSession, d: str) -> DataFrame:
    """What receipt each invoice has after a log of receipts set and cleared."""
    o = F.col("o_orderkey")
    log = T.read(spark, d, "orders").select(
        (F.col("o_custkey") % 25).alias("client_id"), F.floor(o / 5).alias("invoice"), o.alias("seq"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("file"), o.cast("string"))).alias("file_id"),
        F.when(o % 2 == 0, F.concat(F.lit("https://example.org/"), o.cast("string"))).alias("file_url"),
    )
    return edits.receipts(log, "client_id", "invoice", "seq")
