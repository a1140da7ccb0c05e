"""The registered query of a document's whole way to an invoice, beside SQL that walks the documents one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions import address as A
from billforge.functions import keys as K
from billforge.functions import text as X
from billforge.operators import documents
from billforge.operators.assign import Directory
from billforge.plans.queries import _TRADES, _sql_any, name_sql, query
from billforge.sources import tables as T

# Five tenants. Buildings are customers, vendors are suppliers, and of a document its length tells the building, the kind
# of bill and the business key, its id how the answer names them; so copies agree on what the store compares.
_FORMS = (" S.R.L.", " S.A.", "")
_FIELDS = "consortium, provider, tax_id, number, due, amount, client_number, tax_ids"


def _master_sql() -> str:
    trade = f"list_extract({list(_TRADES)}, CAST(s_suppkey % {len(_TRADES)} AS INTEGER) + 1)"
    form = f"list_extract({list(_FORMS)}, CAST(s_suppkey % {len(_FORMS)} AS INTEGER) + 1)"
    return f"""b AS (SELECT c_custkey AS building_id, c_nationkey % 5 AS client_id, 'CUSTOMER# ' || c_custkey AS canonical, CASE WHEN c_custkey % 3 = 0 THEN 'Edificio ' ELSE '' END || c_name AS raw_name,
  '33' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '5' AS digits, 'Torre ' || c_custkey AS alias, ['CUSTOMER', CAST(c_custkey AS VARCHAR)] AS words FROM customer),
 v AS (SELECT s_suppkey AS vendor_id, s_nationkey % 5 AS client_id, {trade} || ' ' || s_suppkey || {form} AS canonical, lower({trade}) || ' ' || s_suppkey AS name, 'obra ' || s_suppkey * 7 AS other,
  '30' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1' AS digits, CASE WHEN s_suppkey % 2 = 0 THEN '30-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '-1' ELSE '30' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1' END AS tax_id,
  CASE WHEN s_acctbal > 0 THEN 'PAGO.' || s_suppkey END AS payment_alias FROM supplier),
 s AS (SELECT c_custkey AS service_id, c_nationkey % 5 AS client_id, c_custkey AS building_id, CASE WHEN c_custkey % 4 = 0 THEN 'EDENOR' ELSE 'EDESUR' END AS provider, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 + 1 END AS vendor_id,
  CAST(c_custkey * 10 AS VARCHAR) AS client_number FROM customer WHERE c_custkey % 2 = 0),
 per AS (SELECT o_custkey AS building_id, arg_max(lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '/' || year(o_orderdate), o_orderdate) AS period FROM orders GROUP BY 1)"""


def _documents_sql() -> str:
    trade = f"list_extract({list(_TRADES)}, CAST(vn % {len(_TRADES)} AS INTEGER) + 1)"
    name = "c_name"
    return rf"""w AS (SELECT doc_id, n_chars, text, c_custkey, c_name, CASE WHEN doc_id % 11 = 0 THEN (c_nationkey + 1) % 5 ELSE c_nationkey % 5 END AS client_id, n_chars % 10 + 1 AS vn,
  CASE n_chars % 6 WHEN 0 THEN 'EDESUR' || chr(10) WHEN 1 THEN 'Razón Social: ' || c_name || chr(10) ELSE '' END || text AS body FROM documents JOIN customer ON c_custkey = 1 + n_chars % 90),
 o AS (SELECT *, sha256(body) AS h, upper(substr(body, 1, 4000)) AS u FROM w WHERE text IS NOT NULL),
 k AS (SELECT *, CASE WHEN NOT {_sql_any((*X.UTILITY_WORDS, "AGUAS+ARGENTINAS"))} THEN NULL {' '.join(f"WHEN {_sql_any(x)} THEN '{n}'" for n, x in X.COMPANY_WORDS)} ELSE 'GENERIC_LSP' END AS company FROM o),
 l AS (SELECT *, CASE WHEN company IS NULL AND n_chars % 6 = 1 THEN c_name END AS line, doc_id % 13 = 0 AS broken FROM k),
 a AS (SELECT doc_id, client_id, h, company, line, CASE WHEN broken THEN NULL WHEN doc_id % 4 = 0 THEN {name} WHEN doc_id % 4 = 1 THEN 'CONSORCIO DE PROPIETARIOS ' || c_name WHEN doc_id % 4 = 2 THEN 'Consorcio de Propietarios' ELSE 'Torre ' || c_custkey END AS told,
  CASE WHEN broken THEN NULL WHEN doc_id % 3 = 0 THEN {trade} || ' ' || vn WHEN doc_id % 3 = 1 THEN 'Obra ' || vn * 7 ELSE 'para ' || {trade} || ' urgente' END AS provider,
  CASE WHEN NOT broken AND doc_id % 2 = 0 THEN '30-' || lpad(CAST(vn AS VARCHAR), 8, '0') || '-1' END AS tax_id, CASE WHEN NOT broken THEN CAST(n_chars % 8 AS VARCHAR) END AS number,
  CASE WHEN broken THEN NULL WHEN n_chars % 5 = 0 THEN 'pronto' ELSE '2024-05-0' || (n_chars % 2 + 1) END AS due, CASE WHEN NOT broken THEN CAST(n_chars % 4 + 0.5 AS DECIMAL(14,2)) END AS amount,
  CASE WHEN NOT broken THEN CAST(c_custkey * 10 AS VARCHAR) END AS client_number,
  CASE WHEN NOT broken AND doc_id % 9 = 0 THEN ['33' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '5', '30' || lpad(CAST(vn AS VARCHAR), 8, '0') || '1'] ELSE [] END AS tax_ids, broken FROM l),
 in1 AS (SELECT doc_id, client_id, h, company, line, CASE WHEN broken THEN NULL ELSE {_refined_sql('told')} END AS consortium, {_FIELDS.removeprefix('consortium, ')} FROM a)"""


def _refined_sql(own: str) -> str:
    return f"CASE WHEN line IS NOT NULL AND (coalesce({own}, '') = '' OR lower({own}) = 'consorcio de propietarios' OR length(line) > length({own})) THEN line ELSE {own} END"


def _key_sql(tax: str) -> str:
    return f"nullif(coalesce(number, '') || '|' || lower(coalesce({tax}, '')) || '|' || coalesce(due, '') || '|' || coalesce(printf('%.2f', CAST(amount AS DOUBLE)), ''), '|||')"


def _generation_sql(g: int) -> str:
    """``rec{g}``: each document's record of generation ``g`` with its place, from ``in{g}``; and what a copy takes of it, ``in{g + 1}``."""
    plain = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(provider, '')), '\\b({K.LEGAL_FORMS})\\b', ' ', 'g'), '[.,_-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return rf"""x{g} AS MATERIALIZED (SELECT i.*, name, match_text, {plain} AS pn, regexp_replace(coalesce(tax_id, ''), '[^0-9]', '', 'g') AS own FROM in{g} AS i LEFT JOIN named ON raw = consortium),
 t{g} AS (SELECT doc_id, client_id, unnest(tax_ids) AS t, generate_subscripts(tax_ids, 1) AS pos FROM x{g}),
 cv{g} AS (SELECT t.doc_id, arg_min(vendor_id, pos * 1000000 + vendor_id) AS cv FROM t{g} AS t JOIN v ON v.client_id = t.client_id AND v.digits = t.t GROUP BY 1),
 q{g} AS (SELECT x.*, cv FROM x{g} AS x LEFT JOIN cv{g} USING (doc_id) WHERE company IS NOT NULL AND company <> 'GENERIC_LSP' AND client_number IS NOT NULL),
 qs{g} AS (SELECT q.doc_id, cv, min(s.service_id) FILTER (WHERE s.vendor_id = cv) AS by_v, min(s.service_id) FILTER (WHERE s.provider = company) AS by_l FROM q{g} AS q JOIN s ON s.client_id = q.client_id AND s.client_number = q.client_number GROUP BY 1, 2),
 f{g} AS (SELECT doc_id, cv AS vendor_id, s.service_id, s.building_id FROM qs{g} JOIN s ON s.service_id = coalesce(by_v, by_l)),
 u{g} AS MATERIALIZED (SELECT DISTINCT client_id, name, match_text FROM x{g} WHERE consortium IS NOT NULL),
 bn{g} AS MATERIALIZED (SELECT u.client_id, u.name, u.match_text, coalesce(min(building_id) FILTER (WHERE canonical = u.name), min(building_id) FILTER (WHERE list_bool_and(list_transform(words, lambda y: contains(u.match_text, y)))),
  min(building_id) FILTER (WHERE upper(alias) = u.name OR list_bool_and(list_transform(string_split(upper(alias), ' '), lambda y: contains(u.match_text, y)))
   OR (u.name <> '' AND list_bool_and(list_transform(string_split(trim(regexp_replace(regexp_replace(u.name, '[^A-ZÁÉÍÓÚÑ0-9]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda y: contains(upper(alias), y)))))) AS building_id
  FROM u{g} AS u JOIN b USING (client_id) GROUP BY 1, 2, 3),
 bt{g} AS (SELECT t.doc_id, arg_min(building_id, pos * 1000000 + building_id) AS building_id FROM t{g} AS t JOIN b ON b.client_id = t.client_id AND b.digits = t.t GROUP BY 1),
 p{g} AS MATERIALIZED (SELECT x.*, coalesce(bt.building_id, bn.building_id) AS building_id FROM x{g} AS x LEFT JOIN bt{g} AS bt USING (doc_id) LEFT JOIN bn{g} AS bn ON bn.client_id = x.client_id AND bn.name = x.name AND bn.match_text = x.match_text
  WHERE x.doc_id NOT IN (SELECT doc_id FROM f{g})),
 pb{g} AS MATERIALIZED (SELECT p.*, b.digits AS bd FROM p{g} AS p JOIN b USING (building_id)),
 vt{g} AS (SELECT t.doc_id, arg_min(vendor_id, pos * 1000000 + vendor_id) AS v0 FROM t{g} AS t JOIN pb{g} AS p USING (doc_id) JOIN v ON v.client_id = t.client_id AND v.digits = t.t AND t.t <> p.bd GROUP BY 1),
 vn{g} AS (SELECT p.doc_id, min(vendor_id) FILTER (WHERE v.digits = own AND own <> bd) AS v1, min(vendor_id) FILTER (WHERE length(pn) >= 3 AND (v.name = pn OR v.other = pn)) AS v2,
  min(vendor_id) FILTER (WHERE length(pn) >= 5 AND (contains(v.name, pn) OR contains(pn, substr(v.name, 1, 5)))) AS v3 FROM pb{g} AS p JOIN v USING (client_id) GROUP BY 1),
 z{g} AS (SELECT p.doc_id, p.building_id, coalesce(v0, v1, v2, v3) AS vendor_id, NULL AS service_id, coalesce(v0, v1, v2, v3) IS NOT NULL AS assigned FROM pb{g} AS p LEFT JOIN vt{g} USING (doc_id) LEFT JOIN vn{g} USING (doc_id)
  UNION ALL SELECT doc_id, building_id, vendor_id, service_id, true FROM f{g}),
 rec{g} AS MATERIALIZED (SELECT {g} AS g, x.doc_id, x.client_id, x.h, x.company, x.line, coalesce(assigned, false) AS assigned, z.building_id, z.vendor_id, z.service_id, per.period, {_key_sql('x.tax_id')} AS raw_key,
  CASE WHEN assigned THEN coalesce({_key_sql('coalesce(v.tax_id, x.tax_id)')}, '__hash__' || x.h) END AS parts, CASE WHEN assigned THEN b.raw_name ELSE x.consortium END AS consortium,
  CASE WHEN assigned THEN coalesce(v.canonical, CASE company WHEN 'EDESUR' THEN 'EDESUR S.A.' WHEN 'EDENOR' THEN 'EDENOR S.A.' ELSE company END) ELSE x.provider END AS provider, CASE WHEN assigned THEN coalesce(v.tax_id, x.tax_id) ELSE x.tax_id END AS tax_id,
  number, due, amount, CASE WHEN assigned THEN payment_alias END AS alias FROM x{g} AS x LEFT JOIN z{g} AS z USING (doc_id) LEFT JOIN b ON b.building_id = z.building_id LEFT JOIN v ON v.vendor_id = z.vendor_id LEFT JOIN per ON per.building_id = z.building_id),
 in{g + 1} AS (SELECT doc_id, client_id, h, company, line, {_refined_sql('consortium')} AS consortium, provider, tax_id, number, CASE WHEN due LIKE '2024%' THEN due END AS due, amount, NULL AS client_number, CAST([] AS VARCHAR[]) AS tax_ids FROM rec{g} WHERE assigned)"""


_GENERATIONS = 4
_SQL = rf"""WITH RECURSIVE {_master_sql()}, {_documents_sql()},
 raw AS (SELECT DISTINCT raw AS p_partkey, 0 AS client_id, raw FROM (SELECT consortium AS raw FROM in1 UNION ALL SELECT line FROM in1 UNION ALL SELECT raw_name FROM b) WHERE raw IS NOT NULL),
 {name_sql("name_")},
 {', '.join(_generation_sql(g) for g in range(1, _GENERATIONS + 1))},
 rec AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM rec{g}' for g in range(1, _GENERATIONS + 1))}),
 sheet AS (SELECT c_nationkey % 5 AS client_id, list((c_custkey % 8) || '||2024-05-01|' || (c_custkey % 4) || '.50') AS had FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
 nth AS MATERIALIZED (SELECT doc_id, client_id, h, row_number() OVER (PARTITION BY client_id ORDER BY doc_id) AS n FROM in1),
 walk AS (SELECT client_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(h VARCHAR, parts VARCHAR, doc BIGINT, g INTEGER)[]) AS st, CAST(coalesce(had, []) AS VARCHAR[]) AS keys, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS INTEGER) AS g,
   CAST(NULL AS VARCHAR) AS how, false AS saved FROM (SELECT DISTINCT client_id FROM nth) LEFT JOIN sheet USING (client_id)
  UNION ALL SELECT client_id, n, CASE WHEN NOT saves THEN st WHEN mine IS NULL THEN list_append(st, struct_pack(h := h, parts := parts, doc := src, g := g)) ELSE list_transform(st, lambda e: CASE WHEN e.h = h THEN struct_pack(h := h, parts := parts, doc := src, g := g) ELSE e END) END,
   CASE WHEN assigned AND raw_key IS NOT NULL THEN list_append(keys, raw_key) ELSE keys END, doc_id, src, g,
   CASE WHEN mine IS NOT NULL THEN 'hash' WHEN raw_key IS NOT NULL AND len(list_filter(st, lambda e: e.parts = raw_key)) > 0 THEN 'stored key' WHEN list_contains(keys, raw_key) THEN 'sheet key' END, saves FROM (
   SELECT y.*, r.assigned, r.raw_key, r.parts, r.assigned AND len(list_filter(st, lambda e: e.h <> y.h AND e.parts = r.parts)) = 0 AS saves FROM (
    SELECT *, coalesce(mine.doc, doc_id) AS src, CAST(least(coalesce(mine.g, 0) + 1, {_GENERATIONS}) AS INTEGER) AS g FROM (
     SELECT walk.client_id, nth.n, st, keys, nth.doc_id, nth.h, list_extract(list_filter(st, lambda e: e.h = nth.h), 1) AS mine FROM walk JOIN nth ON nth.client_id = walk.client_id AND nth.n = walk.n + 1) AS m) AS y
    JOIN rec AS r ON r.doc_id = y.src AND r.client_id = y.client_id AND r.g = y.g) AS z)
 SELECT k.doc_id, CASE WHEN r.assigned THEN 'scanned' ELSE 'unassigned' END AS route, r.building_id, r.vendor_id, r.service_id, r.period, CASE WHEN r.assigned THEN k.how IS NOT NULL END AS is_duplicate, CASE WHEN r.assigned THEN k.how END AS duplicate_by, k.saved,
  r.raw_key AS business_key, r.parts AS stored_key, r.company, r.consortium, r.provider, r.tax_id AS provider_tax_id, r.alias, CAST(r.amount AS DOUBLE) AS amount
 FROM walk AS k JOIN rec AS r ON r.doc_id = k.src AND r.client_id = k.client_id AND r.g = k.g
 UNION ALL SELECT doc_id, 'failed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM w WHERE text IS NULL"""


def directory(spark: SparkSession, d: str) -> Directory:
    """Customers as buildings and services, suppliers as vendors, months of orders as periods."""
    c, k = T.read(spark, d, "customer"), F.col("c_custkey")
    tenant = (F.col("c_nationkey") % 5).alias("client_id")

    def tax(kind: str, key: F.Column, last: str) -> F.Column:
        return F.concat(F.lit(f"{kind}-"), F.lpad(key.cast("string"), 8, "0"), F.lit(f"-{last}"))

    buildings = c.select(
        k.alias("building_id"), tenant, A.building_name(F.col("c_name")).alias("canonical_name"), F.concat(F.when(k % 3 == 0, "Edificio ").otherwise(""), "c_name").alias("raw_name"),
        tax("33", k, "5").alias("tax_id"), F.concat(F.lit(" Torre "), k.cast("string"), F.lit(" | ")).alias("match_names"),
    )
    s = F.col("s_suppkey")
    trade = F.element_at(F.array(*(F.lit(t) for t in _TRADES)), (s % len(_TRADES)).cast("int") + 1)
    form = F.element_at(F.array(*(F.lit(f) for f in _FORMS)), (s % len(_FORMS)).cast("int") + 1)
    vendors = T.read(spark, d, "supplier").select(
        s.alias("vendor_id"), (F.col("s_nationkey") % 5).alias("client_id"), F.concat(trade, F.lit(" "), s.cast("string"), form).alias("canonical_name"), F.when(s % 2 == 0, tax("30", s, "1")).otherwise(K.digits(tax("30", s, "1"))).alias("tax_id"),
        F.concat(F.lit("|Obra "), (s * 7).cast("string")).alias("match_names"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("PAGO."), s.cast("string"))).alias("payment_alias"),
    )
    services = c.where("c_custkey % 2 = 0").select(k.alias("service_id"), tenant, k.alias("building_id"), F.when(k % 4 == 0, "EDENOR").otherwise("EDESUR").alias("provider"), F.when(k % 3 == 0, k % 10 + 1).alias("vendor_id"), (k * 10).cast("string").alias("client_number"))
    last = T.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("building_id")).agg(F.max("o_orderdate").alias("at"))
    return Directory(buildings, vendors, services, last.select("building_id", F.year("at").alias("year"), F.month("at").alias("month")))


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a text, a tenant and an extractor's answer."""
    i, n = F.col("doc_id"), F.col("n_chars")
    few = T.read(spark, d, "customer").where("c_custkey between -88 and 90")  # all that 1 + n % 90 can be
    docs = T.read(spark, d, "documents").join(few, F.col("c_custkey") == 1 + n % 90)
    v, k = n % 10 + 1, F.col("c_custkey")
    trade = F.element_at(F.array(*(F.lit(t) for t in _TRADES)), (v % len(_TRADES)).cast("int") + 1)
    vendor_tax = F.concat(F.lit("30"), F.lpad(v.cast("string"), 8, "0"), F.lit("1"))
    body = F.concat(F.when(n % 6 == 0, "EDESUR\n").when(n % 6 == 1, F.concat(F.lit("Razón Social: "), "c_name", F.lit("\n"))).otherwise(""), "text")
    building = F.when(i % 4 == 0, F.col("c_name")).when(i % 4 == 1, F.concat(F.lit("CONSORCIO DE PROPIETARIOS "), "c_name")).when(i % 4 == 2, "Consorcio de Propietarios").otherwise(F.concat(F.lit("Torre "), k.cast("string")))
    provider = F.when(i % 3 == 0, F.concat(trade, F.lit(" "), v.cast("string"))).when(i % 3 == 1, F.concat(F.lit("Obra "), (v * 7).cast("string"))).otherwise(F.concat(F.lit("para "), trade, F.lit(" urgente")))
    fields = F.struct(
        (n % 8).cast("string").alias("boletaNumber"), building.alias("consortium"), provider.alias("provider"), F.when(i % 2 == 0, vendor_tax).alias("providerTaxId"),
        F.when(n % 5 == 0, "pronto").otherwise(F.concat(F.lit("2024-05-0"), (n % 2 + 1).cast("string"))).alias("dueDate"), (n % 4 + 0.5).alias("amount"), F.concat(F.lit("000"), (k * 10).cast("string")).alias("clientNumber"),
        F.when(i % 9 == 0, F.array(F.concat(F.lit("33"), F.lpad(k.cast("string"), 8, "0"), F.lit("5")), vendor_tax)).alias("allTaxIds"),
    )
    answer = F.when(i % 13 == 0, "no answer").otherwise(F.to_json(fields))
    return docs.select("doc_id", F.when(i % 11 == 0, (F.col("c_nationkey") + 1) % 5).otherwise(F.col("c_nationkey") % 5).alias("client_id"), body.alias("text"), answer.alias("answer"))


@query(_SQL)
def q_document_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every document from its text and an answer to a stored invoice, an unassigned file or a failure, in the order of ids."""
    c = F.col("c_custkey")
    sheet = T.read(spark, d, "customer").where("c_acctbal > 9000").select((F.col("c_nationkey") % 5).alias("client_id"), F.concat((c % 8).cast("string"), F.lit("||2024-05-01|"), (c % 4).cast("string"), F.lit(".50")).alias("business_key"))
    out = documents.process(T.spread(answered(spark, d)), directory(spark, d), T.settled, sheet_keys=sheet).documents
    return out.select("doc_id", "route", "building_id", "vendor_id", "service_id", "period", "is_duplicate", "duplicate_by", "saved", "business_key", "stored_key", "company", "consortium", "provider", "provider_tax_id", "alias", "amount")
