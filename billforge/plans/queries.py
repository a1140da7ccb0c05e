"""The registered queries of the reference's operators, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions import address as A
from billforge.functions import keys as K
from billforge.functions import shown as S
from billforge.functions import text as X
from billforge.operators import assign, dedup, jobs, match, merge, periods, sheets, usage
from billforge.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_INV = """inv AS (SELECT l_orderkey, l_linenumber, l_suppkey AS provider_id, l_partkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount,
 CAST(l_shipdate AS DATE) AS due_date, o_custkey AS consortium_id, year(o_orderdate) AS year, month(o_orderdate) AS month
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_PER = "per AS (SELECT DISTINCT o_custkey AS consortium_id, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders)"
_USE = """use_ AS (SELECT event_id, user_id % 25 AS client_id, event_type AS provider, CAST(props->>'$.k' AS INTEGER) AS k,
 'm' || CAST(CAST(props->>'$.k' AS INTEGER) % 5 AS VARCHAR) AS model, CAST(round(value * 100) AS BIGINT) AS tokens, ts AS run_at FROM events)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- reads -----------------------------------------------------------------------------------------


@query(f"""WITH {_INV} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line_number, coalesce(n_name, 'unknown') AS client_name,
 coalesce(c_name, 'unknown') AS consortium_name, coalesce(s_name, 'unknown') AS provider_name, CAST(amount AS DOUBLE) AS amount,
 CAST(due_date AS VARCHAR) AS due_date, lpad(CAST(month AS VARCHAR), 2, '0') || '/' || CAST(year AS VARCHAR) AS period
 FROM inv LEFT JOIN customer ON consortium_id = c_custkey LEFT JOIN supplier ON provider_id = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey
 ORDER BY inv.due_date DESC, l_orderkey, l_linenumber, provider_id, l_partkey, inv.amount LIMIT 50 OFFSET 50""")
def q_invoice_list_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 of the newest invoices with the names of what they refer to."""
    order = (F.desc("due_date"), "l_orderkey", "l_linenumber", "provider_id", "l_partkey", "amount")
    # every sort column is the line's, so only the page's lines meet their orders in full
    keys = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    top = T.lines(spark, d).join(keys, "l_orderkey", "left_semi").orderBy(*order).offset(50).limit(50)
    page = top.join(T.orders(spark, d), "l_orderkey")
    page = page.join(T.consortiums(spark, d), "consortium_id", "left").join(T.providers(spark, d), "provider_id", "left").join(T.clients(spark, d), "client_id", "left").orderBy(*order)
    named = (F.coalesce(c, F.lit("unknown")).alias(c) for c in ("client_name", "consortium_name", "provider_name"))
    return page.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_number"), *named, F.col("amount").cast("double").alias("amount"), F.col("due_date").cast("string").alias("due_date"), K.period_label(F.col("month"), F.col("year")).alias("period"))


@query(f"""WITH {_INV} SELECT consortium_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, count(*) AS n_invoices,
 CAST(sum(amount) AS DOUBLE) AS total, CAST(min(due_date) AS VARCHAR) AS first_due FROM inv WHERE year >= 1997 GROUP BY ALL""")
def q_invoice_by_period(spark: SparkSession, d: str) -> DataFrame:
    out = T.invoices(spark, d).where("year >= 1997").groupBy("consortium_id", "year", "month")
    out = out.agg(F.count(F.lit(1)).alias("n_invoices"), F.sum("amount").cast("double").alias("total"), F.min("due_date").cast("string").alias("first_due"))
    return _longs(out, "year", "month")


@query("""SELECT CAST(c_nationkey AS BIGINT) AS client_id, count(*) AS n_found, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(c_name), '0007') OR contains(lower(c_mktsegment), 'urgent') GROUP BY ALL""")
def q_invoice_search(spark: SparkSession, d: str) -> DataFrame:
    """Free-text search over several columns, and the total of what it finds."""
    rows = T.read(spark, d, "orders").join(T.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hit = F.lower("o_orderpriority").contains("urgent") | F.lower("c_name").contains("0007") | F.lower("c_mktsegment").contains("urgent")
    return rows.where(hit).groupBy(F.col("c_nationkey").cast("long").alias("client_id")).agg(F.count(F.lit(1)).alias("n_found"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"))


@query(f"""WITH {_PER}, {_INV}, p AS (SELECT consortium_id, count(*) AS n FROM per GROUP BY 1), i AS (SELECT consortium_id, count(*) AS n FROM inv GROUP BY 1)
 SELECT c_custkey AS consortium_id, c_name AS consortium_name, coalesce(p.n, 0) AS n_periods, coalesce(i.n, 0) AS n_invoices
 FROM customer LEFT JOIN p ON p.consortium_id = c_custkey LEFT JOIN i ON i.consortium_id = c_custkey""")
def q_consortium_overview(spark: SparkSession, d: str) -> DataFrame:
    p = T.periods(spark, d).groupBy("consortium_id").agg(F.count(F.lit(1)).alias("n_periods"))
    i = T.invoices(spark, d).groupBy("consortium_id").agg(F.count(F.lit(1)).alias("n_invoices"))
    out = T.consortiums(spark, d).join(p, "consortium_id", "left").join(i, "consortium_id", "left")
    return out.select("consortium_id", "consortium_name", F.coalesce("n_periods", F.lit(0)).alias("n_periods"), F.coalesce("n_invoices", F.lit(0)).alias("n_invoices"))


@query(f"""WITH {_USE}, c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), u AS (SELECT client_id, count(*) AS n, sum(tokens) AS t FROM use_ GROUP BY 1)
 SELECT CAST(n_nationkey AS BIGINT) AS client_id, n_name AS client_name, coalesce(c.n, 0) AS n_consortiums, coalesce(u.n, 0) AS n_calls, CAST(coalesce(u.t, 0) AS BIGINT) AS tokens
 FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN u ON u.client_id = n_nationkey""")
def q_client_audit(spark: SparkSession, d: str) -> DataFrame:
    c = T.consortiums(spark, d).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_consortiums"))
    u = T.usage(spark, d).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"))
    out = T.clients(spark, d).join(c, "client_id", "left").join(u, "client_id", "left")
    return _longs(out.select("client_id", "client_name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_consortiums", "n_calls", "tokens"))), "client_id")


# --- queue -----------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents AS d
 WHERE NOT EXISTS (SELECT 1 FROM labels AS l JOIN documents AS k ON k.doc_id = l.doc_id WHERE k.source = d.source AND l.doc_id = d.doc_id AND l.quality IN (0, 1)))
 SELECT doc_id, source, CAST(position AS BIGINT) AS position FROM f WHERE position <= 10""")
def q_enqueue_new_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label (an invoice or a job), ten of each source."""
    labels = T.read(spark, d, "labels").join(T.read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    files = T.read(spark, d, "documents").select("doc_id", "source", F.lit(10).alias("batch"))
    out = jobs.new_files(files, labels.where("quality = 1").select("source", "doc_id"), labels.where("quality = 0").select("source", "doc_id"), tenant="source", file="doc_id", batch="batch", order=["doc_id"])
    return _longs(out.select("doc_id", "source", "position"), "position")


@query("""WITH hit AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3) AND l_linestatus = 'O')
 SELECT o_orderkey AS order_key, o_custkey AS consortium_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM hit) AND o_orderstatus <> 'P'""")
def q_requeue_on_provider(spark: SparkSession, d: str) -> DataFrame:
    """Unassigned invoices of new providers, without those that have an open job."""
    new = T.read(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    hit = T.read(spark, d, "lineitem").where("l_linestatus = 'O'").join(new, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("order_key"))
    orders = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("consortium_id"), "o_orderstatus")
    waiting = orders.where("o_orderstatus = 'P'").select("order_key")
    return orders.join(hit, "order_key", "left_semi").join(waiting, "order_key", "left_anti").select("order_key", "consortium_id")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS client_id, false AS running, 0::BIGINT AS total_runs, 'unknown' AS quota_status FROM nation
 WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9970)""")
def q_default_states(spark: SparkSession, d: str) -> DataFrame:
    """A default scheduler row for each tenant without one."""
    have = T.read(spark, d, "customer").where("c_acctbal > 9970").select(F.col("c_nationkey").alias("client_id"))
    return _longs(merge.without(T.clients(spark, d), have, ["client_id"]).select("client_id", F.lit(False).alias("running"), F.lit(0).cast("long").alias("total_runs"), F.lit("unknown").alias("quota_status")), "client_id")


@query("SELECT c_custkey AS consortium_id, c_name AS consortium_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Buildings that no recent order refers to."""
    recent = T.read(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'").select(F.col("o_custkey").alias("consortium_id"))
    return merge.without(T.consortiums(spark, d), recent, ["consortium_id"]).select("consortium_id", "consortium_name")


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'COMPLETED' WHEN k % 4 + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status,
 CAST(CASE WHEN k % 3 = 0 THEN k % 4 ELSE k % 4 + 1 END AS BIGINT) AS attempts FROM (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events) AS e""")
def q_retry_state(spark: SparkSession, d: str) -> DataFrame:
    """State of jobs after an attempt; k tells the attempts so far and whether this one worked."""
    running = T.usage(spark, d).select("event_id", (F.col("k") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), (F.col("k") % 3 == 0).alias("ok"))
    return _longs(jobs.after_attempt(running).select("event_id", "status", "attempts"), "attempts")


# --- duplicates ------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS document_hash, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_doc_id,
 doc_id > min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS is_duplicate FROM documents""")
def q_dup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("document_hash"))
    return dedup.mark_duplicates(docs, ["document_hash"], F.col("doc_id"), first="first_doc_id")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
  CAST(l_orderkey % 50 AS VARCHAR) || '|' || '30-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '-' || CAST(l_suppkey % 10 AS VARCHAR) || '|' ||
  strftime(l_shipdate, '%Y-%m') || '-01|' || printf('%.2f', round(l_quantity)) AS business_key FROM lineitem)
 SELECT business_key, count(*) AS n_rows, min(l_orderkey) AS first_order, count(*) - 1 AS n_duplicates FROM k GROUP BY 1""")
def q_dup_by_business_key(spark: SparkSession, d: str) -> DataFrame:
    """Four-part keys of lines, and how many rows share each."""
    line = T.read(spark, d, "lineitem")
    tax = F.concat(F.lit(" 30"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0"), (F.col("l_suppkey") % 10).cast("string"))
    key = K.business_key((F.col("l_orderkey") % 50).cast("string"), K.tax_id(tax), F.date_format(F.trunc("l_shipdate", "month"), "yyyy-MM-dd"), F.round("l_quantity").cast("long").cast("string"))
    rows = T.spread(line.select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")).select("l_orderkey", key.alias("business_key"))
    return rows.groupBy("business_key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("l_orderkey").alias("first_order"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))


# --- scalars ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT CAST(l_extendedprice AS DECIMAL(14,2)) AS a, l_linenumber % 3 AS f FROM lineitem),
 t AS (SELECT a, f, CASE f WHEN 0 THEN '$ ' || translate(format('{:,.2f}', CAST(a AS DOUBLE)), ',.', '.,') WHEN 1 THEN format('{:,.2f}', CAST(a AS DOUBLE)) ELSE printf('%.2f', CAST(a AS DOUBLE)) END AS raw FROM p)
 SELECT raw, printf('%.2f', CAST(a AS DOUBLE)) AS key_amount,
 CAST(printf('%.2f', CAST(regexp_extract(replace(regexp_replace(raw, '[^0-9.,-]', '', 'g'), ',', '.'), '^[0-9]+\\.?[0-9]*') AS DOUBLE)) AS DOUBLE) AS extracted_amount FROM t""")
def q_amount_norm(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written in three forms, read back by both parsers."""
    a = T.read(spark, d, "lineitem").select(F.col("l_extendedprice").cast("decimal(14,2)").cast("double").alias("a"), (F.col("l_linenumber") % 3).alias("f")).distinct()
    raw = F.when(F.col("f") == 0, K.pesos(F.col("a"))).when(F.col("f") == 1, F.format_number("a", 2)).otherwise(K.two_decimals(F.col("a")))
    a = a.select(raw.alias("raw"))
    return a.select("raw", K.business_amount(F.col("raw")).alias("key_amount"), K.extracted_amount(F.col("raw")).alias("extracted_amount"))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y')
  WHEN 2 THEN ' ' || strftime(o_orderdate, '%b %-d, %Y') ELSE 'Vence ' || strftime(o_orderdate, '%Y') END AS raw, o_orderdate FROM orders)
 SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 = 3 THEN lower(raw) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS due_date, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed FROM o""")
def q_due_date_norm(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "M/d/yyyy")).when(k == 2, F.concat(F.lit(" "), F.date_format(t, "MMM d, yyyy")))
    o = o.select("o_orderkey", raw.otherwise(F.concat(F.lit("Vence "), F.date_format(t, "yyyy"))).alias("raw"))
    return o.select("o_orderkey", "raw", K.business_date(F.col("raw")).alias("due_date"), K.parsed_date(F.col("raw")).cast("string").alias("parsed"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '30-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '-7' WHEN 1 THEN '30' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '7' ELSE ' CUIT ' || CAST(s_suppkey AS VARCHAR) || ' ' END AS raw FROM supplier)
 SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN trim(raw) ELSE '30-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '-7' END AS tax_id, regexp_replace(raw, '[^0-9]', '', 'g') AS digits, length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 10 AS usable FROM s""")
def q_tax_id_norm(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    eight = F.lpad(k.cast("string"), 8, "0")
    raw = F.when(k % 3 == 0, F.concat(F.lit("30-"), eight, F.lit("-7"))).when(k % 3 == 1, F.concat(F.lit("30"), eight, F.lit("7"))).otherwise(F.concat(F.lit(" CUIT "), k.cast("string"), F.lit(" ")))
    s = T.read(spark, d, "supplier").select("s_suppkey", raw.alias("raw"))
    return s.select("s_suppkey", K.tax_id(F.col("raw")).alias("tax_id"), K.digits(F.col("raw")).alias("digits"), (F.size(K.usable_tax_ids(F.array("raw"))) > 0).alias("usable"))


_FORMS = (" S.R.L.", " S.A.", " SAS", " LTDA. SUR", " S.H.", "")


@query(f"""WITH s AS (SELECT s_suppkey, s_name || list_extract({list(_FORMS)}, CAST(s_suppkey % {len(_FORMS)} AS INTEGER) + 1) AS raw FROM supplier)
 SELECT s_suppkey, raw, trim(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\b({K.LEGAL_FORMS})\\b', ' ', 'g'), '[.,_-]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM s""")
def q_provider_name_norm(spark: SparkSession, d: str) -> DataFrame:
    form = F.element_at(F.array(*(F.lit(f) for f in _FORMS)), (F.col("s_suppkey") % len(_FORMS)).cast("int") + 1)
    s = T.read(spark, d, "supplier").select("s_suppkey", F.concat("s_name", form).alias("raw"))
    return s.select("s_suppkey", "raw", K.provider_name(F.col("raw")).alias("name"))


# Parts as raw addresses: prefix, street from the part's name, zero-padded number, tail.
_PRE = ("CONSORCIO DE PROPIETARIOS AV ", "CONS. PROPIET. ", "GRAL. ", "CALLE ", "Almte. ")
_TAIL = (" 3 B", " PB A", " C1414AWF CAPITAL FEDERAL", " 018", "")
_RAW_SQL = f"""raw AS (SELECT p_partkey, p_partkey % 25 AS client_id, list_extract({list(_PRE)}, CAST(p_partkey % 5 AS INTEGER) + 1) || p_name || ' 00' || CAST(p_size * 10 + p_partkey % 7 AS VARCHAR)
 || list_extract({list(_TAIL)}, CAST(p_partkey % 3 + p_partkey % 2 AS INTEGER) + 1) AS raw FROM part)"""


def _raw_addresses(spark: SparkSession, d: str, *more: str) -> DataFrame:
    k = F.col("p_partkey")

    def pick(values: tuple[str, ...], at) -> F.Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), at.cast("int") + 1)

    raw = F.concat(pick(_PRE, k % 5), "p_name", F.lit(" 00"), (F.col("p_size") * 10 + k % 7).cast("string"), pick(_TAIL, k % 3 + k % 2))
    return T.spread(T.read(spark, d, "part").select("p_partkey", (k % 25).alias("client_id"), raw.alias("raw"), *more))


def _sql_subs(expr: str, steps: list[tuple[str, str]]) -> str:
    for p, by in steps:
        expr = f"regexp_replace({expr}, '(?i){p}', '{by}', 'g')".replace("$1", "\\1")
    return expr


def _sql_expanded(expr: str) -> str:
    return "trim(" + _sql_subs(expr, [*A.abbreviation_patterns(), ("\\s+", " ")]) + ")"


def name_sql(p: str = "") -> str:
    """Table ``named``: the rows of ``raw`` (p_partkey, client_id, raw) with name and match_text; ``p`` begins the names of the tables between."""
    return f"""{p}b AS (SELECT *, trim({_sql_subs('trim(raw)', [(x, '') for x in A.PREFIXES])}) AS bare FROM raw),
 {p}e AS (SELECT *, {_sql_subs(_sql_expanded("CASE WHEN bare <> '' THEN bare ELSE trim(raw) END"), [(A.LEADING_ZEROS, '$1')])} AS ex FROM {p}b),
 {p}p AS (SELECT *, trim({_sql_subs('ex', [(x, '') for x in A.POSTAL])}) AS po FROM {p}e),
 {p}f AS (SELECT *, {_sql_subs('trim(' + _sql_subs('po', [(x, '') for x in A.FLOOR]) + ')', [(A.SUFFIX, '$1')])} AS fl FROM {p}p),
 {p}k AS (SELECT *, trim({_sql_subs('fl', [(A.STREET_KIND, '')])}) AS kl FROM {p}f),
 {p}t AS (SELECT *, trim({_sql_subs('kl', [(A.NOISE, '')])}) AS told FROM {p}k),
 {p}g AS (SELECT *, trim(regexp_replace(regexp_extract(told, '^(.*?)([0-9][0-9/-]*)', 1), '\\s+', ' ', 'g')) AS street, regexp_extract(told, '^(.*?)([0-9]+)[0-9/-]*', 2) AS num FROM {p}t),
 named AS (SELECT p_partkey, client_id, raw, upper(CASE WHEN street <> '' AND num <> '' THEN street || ' ' || num ELSE trim(regexp_replace(CASE WHEN kl <> '' THEN kl ELSE fl END, '\\s+', ' ', 'g')) END) AS name,
  trim(regexp_replace(regexp_replace(upper({_sql_subs(_sql_expanded('raw'), [(A.LEADING_ZEROS, '$1')])}), '[^A-ZÁÉÍÓÚÑ0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS match_text FROM {p}g)"""


_NAME_SQL = name_sql()


@query(f"WITH {_RAW_SQL}, {_NAME_SQL} SELECT p_partkey, raw, name, match_text FROM named")
def q_address_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw_addresses(spark, d)
    return raw.select("p_partkey", "raw", A.building_name(F.col("raw")).alias("name"), A.match_text(F.col("raw")).alias("match_text"))


# Parts of two types are the directory: those of type ECONOMY name buildings, those of type SMALL are buildings by aliases: their own raw name and that of the tenant's next part.
_DIM_SQL = """num AS (SELECT named.*, p_type, p_size FROM named JOIN part USING (p_partkey)),
 dim AS (SELECT p_partkey AS building_id, client_id, name AS canonical, list_filter(string_split(%s, ' '), lambda w: w <> '') AS words, '30' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '7' AS cuit FROM num WHERE p_type = 'ECONOMY'),
 al AS (SELECT p_partkey AS building_id, client_id, name AS a_name, match_text AS a_text FROM num WHERE p_type = 'SMALL'
  UNION ALL SELECT s.p_partkey, s.client_id, n.name, n.match_text FROM num AS s JOIN num AS n ON n.p_partkey = s.p_partkey + 25 WHERE s.p_type = 'SMALL'),
 tax AS (SELECT p_partkey, client_id, i, '30' || lpad(CAST(p_partkey + 25 * i AS VARCHAR), 8, '0') || '7' AS cuit FROM num, range(1, 3) AS r(i) WHERE p_size <= 10)""" % (
    "trim(regexp_replace(regexp_replace(upper(" + _sql_subs(_sql_expanded("name"), [(A.LEADING_ZEROS, "$1")]) + "), '[^A-ZÁÉÍÓÚÑ0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
_ALL_WORDS = "len(words) > 0 AND list_bool_and(list_transform(words, lambda w: contains(match_text, w)))"
_R0_SQL = "SELECT p_partkey, min_by(building_id, i * 1000000000 + building_id) AS building_id FROM tax JOIN dim ON dim.client_id = tax.client_id AND dim.cuit = tax.cuit GROUP BY 1"
_R1_SQL = "SELECT p_partkey, min(building_id) AS building_id FROM named JOIN dim ON dim.client_id = named.client_id AND name = canonical AND name <> '' GROUP BY 1"
_R2_SQL = f"SELECT p_partkey, min(building_id) AS building_id, count(*) AS n_matches FROM named JOIN dim ON dim.client_id = named.client_id AND {_ALL_WORDS} GROUP BY 1"
_R3_SQL = r"""SELECT named.p_partkey, min(building_id) AS building_id FROM (SELECT *, trim(regexp_replace(regexp_replace(name, '[^A-ZÁÉÍÓÚÑ0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM named) AS named JOIN al ON al.client_id = named.client_id AND (name = a_name AND name <> ''
 OR (a_text <> '' AND list_bool_and(list_transform(string_split(a_text, ' '), lambda w: contains(match_text, w)))) OR (clean <> '' AND list_bool_and(list_transform(string_split(clean, ' '), lambda w: contains(a_text, w))))) GROUP BY 1"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their names normalised, written once: doc_id, client_id, raw, name, text, tax_ids, kind."""
    raw = _raw_addresses(spark, d, "p_type", "p_size")
    ids = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: _cuit(F.col("p_partkey") + 25 * i))
    return T.settled(
        raw.select(
            F.col("p_partkey").alias("doc_id"), F.col("client_id"), "raw", A.building_name(F.col("raw")).alias("name"), A.match_text(F.col("raw")).alias("text"),
            F.when(F.col("p_size") <= 10, ids).otherwise(F.array().cast("array<string>")).alias("tax_ids"), F.col("p_type").alias("kind"),
        )
    )


def _cuit(k: F.Column) -> F.Column:
    return K.digits(F.concat(F.lit("30-"), F.lpad(k.cast("string"), 8, "0"), F.lit("-7")))


def _buildings(named: DataFrame) -> DataFrame:
    """The directory: match_id, name, words as the substring match reads them, tax id."""
    return named.where("kind = 'ECONOMY'").select(F.col("doc_id").alias("match_id"), "client_id", "name", A.tokens(A.match_text(F.col("name"))).alias("words"), _cuit(F.col("doc_id")).alias("tax_id"))


def _aliases(named: DataFrame) -> DataFrame:
    """Aliases, one row each, read from names packed with bars."""
    more = named.select((F.col("doc_id") - 25).alias("match_id"), F.col("raw").alias("second"))
    small = named.where("kind = 'SMALL'").select(F.col("doc_id").alias("match_id"), "client_id", "raw")
    packed = match.by_sorting(small, more, "match_id", "left").select("match_id", "client_id", F.concat_ws(" | ", "raw", "second").alias("packed"))
    each = packed.select("match_id", "client_id", F.posexplode(A.packed_list(F.col("packed"))).alias("at", "alias"))
    told = each.select("match_id", (F.col("match_id") * 2 + F.col("at")).alias("alias_id"), "client_id", A.building_name(F.col("alias")).alias("name"), A.match_text(F.col("alias")).alias("text"))
    return told.withColumn("words", A.tokens(F.col("text")))


_BUILDING_RULES = [
    (0, lambda dims: lambda docs: match.by_tax_id(docs, dims[0], "client_id")),
    (1, lambda dims: lambda docs: match.by_name(docs, dims[0], "client_id")),
    (2, lambda dims: lambda docs: match.by_words(docs, dims[0], "client_id")),
    (3, lambda dims: lambda docs: match.by_alias(docs, dims[1], "client_id")),
]


def _by_rule(spark: SparkSession, d: str, number: int) -> DataFrame:
    named = _named(spark, d)
    hits = _BUILDING_RULES[number][1]((T.settled(_buildings(named)) if number == 2 else _buildings(named), T.settled(_aliases(named)) if number == 3 else None))(named)
    n = F.col("n_matches") if "n_matches" in hits.columns else F.lit(1)
    return hits.groupBy(F.col("doc_id").alias("p_partkey")).agg(F.min("match_id").alias("building_id"), F.sum(n).alias("n_matches"))


@query(f"WITH {_RAW_SQL}, {_NAME_SQL}, {_DIM_SQL} {_R0_SQL}")
def q_match_tax_id(spark: SparkSession, d: str) -> DataFrame:
    """Buildings by the first tax id of a document that the tenant's directory has."""
    return _by_rule(spark, d, 0).drop("n_matches")


@query(f"WITH {_RAW_SQL}, {_NAME_SQL}, {_DIM_SQL} {_R1_SQL}")
def q_match_exact(spark: SparkSession, d: str) -> DataFrame:
    return _by_rule(spark, d, 1).drop("n_matches")


@query(f"WITH {_RAW_SQL}, {_NAME_SQL}, {_DIM_SQL} {_R2_SQL}")
def q_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """All words of a canonical name, expanded and cleaned as the raw one is, are substrings of that, within a tenant."""
    return _by_rule(spark, d, 2)


@query(f"WITH {_RAW_SQL}, {_NAME_SQL}, {_DIM_SQL} {_R3_SQL}")
def q_match_alias(spark: SparkSession, d: str) -> DataFrame:
    """An alias equals the name, lies within the raw text, or holds all words of the name."""
    return _by_rule(spark, d, 3).drop("n_matches")


@query(f"""WITH {_RAW_SQL}, {_NAME_SQL}, {_DIM_SQL}, c AS (SELECT 0 AS rule, * FROM ({_R0_SQL}) UNION ALL SELECT 1, * FROM ({_R1_SQL}) UNION ALL SELECT 2, p_partkey, building_id FROM ({_R2_SQL}) UNION ALL SELECT 3, * FROM ({_R3_SQL})),
 w AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rule) AS n FROM c)
 SELECT named.p_partkey, w.building_id, CAST(w.rule AS BIGINT) AS rule, CASE WHEN w.rule IS NULL THEN 'unassigned' ELSE 'scanned' END AS route FROM named LEFT JOIN w ON w.p_partkey = named.p_partkey AND w.n = 1""")
def q_match_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Tax id, then exact, substring and alias match, each on what is left; the rest is routed as unassigned."""
    named = _named(spark, d)
    dims = (T.settled(_buildings(named)), T.settled(_aliases(named)))
    best = match.in_turn(named, [(n, rule(dims)) for n, rule in _BUILDING_RULES], T.settled)
    out = match.by_sorting(named.select("doc_id"), best, "doc_id", "left")
    return out.select(F.col("doc_id").alias("p_partkey"), F.col("match_id").alias("building_id"), F.col("rule").cast("long").alias("rule"), F.when(F.col("rule").isNull(), "unassigned").otherwise("scanned").alias("route"))


# Suppliers as vendors with a trade, a number and a legal form; lines of orders name one, or a part of its name, or give a tax id.
_TRADES = ("Ascensores", "Plomeria", "Electricidad", "Gas Natural", "Limpieza", "Seguros", "Pintura", "Cerrajeria")
_VENDOR_SQL = f"""v AS (SELECT s_suppkey AS vendor_id, s_nationkey AS client_id, list_extract({list(_TRADES)}, CAST(s_suppkey % 8 AS INTEGER) + 1) || ' ' || CAST(s_suppkey AS VARCHAR) AS name,
  '30' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1' AS cuit, 'obra ' || CAST(s_suppkey * 7 AS VARCHAR) AS alias FROM supplier),
 vd AS (SELECT o_orderkey, c_nationkey AS client_id, CASE WHEN o_totalprice < 60000 THEN ['30' || lpad(CAST(c_custkey % 100 AS VARCHAR), 8, '0') || '1', '30' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 8, '0') || '1'] ELSE [] END AS tax_ids,
  CASE WHEN o_orderkey % 7 < 3 THEN '30' || lpad(CAST(CASE WHEN o_orderkey % 7 = 0 THEN c_custkey ELSE o_orderkey // 7 END % 100 AS VARCHAR), 8, '0') || '1' WHEN o_orderkey % 7 = 3 THEN '123' ELSE '' END AS own,
  '30' || lpad(CAST(c_custkey % 100 AS VARCHAR), 8, '0') || '1' AS building_cuit,
  lower(CASE o_orderstatus WHEN 'O' THEN list_extract({list(_TRADES)}, CAST(o_custkey % 8 AS INTEGER) + 1) || ' ' || CAST(o_custkey % 100 AS VARCHAR) WHEN 'F' THEN 'Obra ' || CAST(o_custkey % 100 * 7 AS VARCHAR)
   ELSE 'para ' || list_extract({list(_TRADES)}, CAST(o_orderkey % 8 AS INTEGER) + 1) || ' urgente' END) AS name FROM orders JOIN customer ON o_custkey = c_custkey),
 c AS (SELECT o_orderkey, 0 AS rule, min_by(vendor_id, i * 1000000000 + vendor_id) AS vendor_id FROM (SELECT o_orderkey, client_id, building_cuit, unnest(tax_ids) AS t, generate_subscripts(tax_ids, 1) AS i FROM vd) AS x JOIN v ON v.client_id = x.client_id AND v.cuit = t AND t <> building_cuit GROUP BY 1
 UNION ALL SELECT o_orderkey, 1, min(vendor_id) FROM vd JOIN v ON v.client_id = vd.client_id AND v.cuit = own AND own <> building_cuit GROUP BY 1
 UNION ALL SELECT o_orderkey, 2, min(vendor_id) FROM vd JOIN v ON v.client_id = vd.client_id AND (lower(v.name) = vd.name OR v.alias = vd.name) GROUP BY 1
 UNION ALL SELECT o_orderkey, 3, min(vendor_id) FROM vd JOIN v ON v.client_id = vd.client_id AND length(vd.name) >= 5 AND (contains(lower(v.name), vd.name) OR contains(vd.name, substr(lower(v.name), 1, 5))) GROUP BY 1),
 w AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rule) AS n FROM c)"""


@query(f"WITH {_VENDOR_SQL} SELECT o_orderkey, w.vendor_id, CAST(w.rule AS BIGINT) AS rule, CASE WHEN w.rule IS NULL THEN 'unassigned' ELSE 'scanned' END AS route FROM vd LEFT JOIN w USING (o_orderkey) WHERE coalesce(w.n, 1) = 1")
def q_match_vendor(spark: SparkSession, d: str) -> DataFrame:
    """The vendor cascade: all tax ids but for the building's, the document's own tax id unless it is the building's, exact name or alias, part of the name."""

    def trade(k: F.Column) -> F.Column:
        return F.element_at(F.array(*(F.lit(t) for t in _TRADES)), (k % len(_TRADES)).cast("int") + 1)

    def cuit(k: F.Column) -> F.Column:
        return K.digits(F.concat(F.lit("30-"), F.lpad(k.cast("string"), 8, "0"), F.lit("-1")))

    k = F.col("s_suppkey")
    form = F.when(F.col("s_acctbal") > 0, " S.R.L.").otherwise(" S.A.")
    vendors = T.settled(
        T.read(spark, d, "supplier").select(
            F.col("s_nationkey").alias("client_id"), k.alias("vendor_id"), cuit(k).alias("digits"), K.provider_name(F.concat(trade(k), F.lit(" "), k.cast("string"), form)).alias("name"),
            F.concat(F.lit("Obra "), (k * 7).cast("string"), F.lit(" | ")).alias("packed"),
        ).withColumn("names", F.concat(F.array("name"), F.transform(A.packed_list(F.col("packed")), K.provider_name)))
    )
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    told = F.when(F.col("o_orderstatus") == "O", F.concat(trade(c), F.lit(" "), (c % 100).cast("string"))).when(F.col("o_orderstatus") == "F", F.concat(F.lit("Obra "), (c % 100 * 7).cast("string"))).otherwise(F.concat(F.lit("para "), trade(o), F.lit(" urgente")))
    ids = F.when(F.col("o_totalprice") < 60000, F.array(cuit(c % 100), cuit(o % 100))).otherwise(F.array().cast("array<string>"))
    own = F.when(o % 7 == 0, cuit(c % 100)).when(o % 7 < 3, cuit(F.floor(o / 7) % 100)).when(o % 7 == 3, "123").otherwise("")
    orders = T.read(spark, d, "orders").join(T.consortiums(spark, d).select(F.col("consortium_id").alias("o_custkey"), "client_id"), "o_custkey")
    docs = T.settled(orders.select(o.alias("doc_id"), "client_id", ids.alias("tax_ids"), own.alias("own_id"), cuit(c % 100).alias("building_tax_id"), K.provider_name(told).alias("name")))
    rules = assign.vendor_rules(assign.Directory(None, vendors, None, None))
    out = docs.select("doc_id").join(match.in_turn(docs, rules, T.settled), "doc_id", "left")
    return out.select(F.col("doc_id").alias("o_orderkey"), F.col("match_id").alias("vendor_id"), F.col("rule").cast("long").alias("rule"), F.when(F.col("rule").isNull(), "unassigned").otherwise("scanned").alias("route"))


# --- texts -----------------------------------------------------------------------------------------

_WORDS = ("Edesur", "aysa", "Litoral Gas", "Telecom", "aguas de argentinas", "LSP 7", "")
_BILL_SQL = f"bill AS (SELECT doc_id, coalesce(source, '') || ' ' || list_extract({list(_WORDS)}, CAST(doc_id % {len(_WORDS)} AS INTEGER) + 1) || chr(10) || coalesce(text, '') AS body FROM documents)"


def _sql_any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"contains(u, '{x}')" for x in w.split("+")) + ")" for w in words) + ")"


@query(f"""WITH {_BILL_SQL}, h AS (SELECT doc_id, upper(substr(body, 1, 4000)) AS u FROM bill)
 SELECT doc_id, CASE WHEN NOT {_sql_any((*X.UTILITY_WORDS, "AGUAS+ARGENTINAS"))} THEN NULL {' '.join(f"WHEN {_sql_any(w)} THEN '{n}'" for n, w in X.COMPANY_WORDS)} ELSE 'GENERIC_LSP' END AS company FROM h""")
def q_lsp_route(spark: SparkSession, d: str) -> DataFrame:
    """The company that issued a bill; documents get a heading that may name one."""
    word = F.element_at(F.array(*(F.lit(w) for w in _WORDS)), (F.col("doc_id") % len(_WORDS)).cast("int") + 1)
    bill = T.read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit(" "), word, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("body"))
    return bill.select("doc_id", X.utility_company(F.col("body")).alias("company"))


_CLEAN = r"""regexp_replace(regexp_replace(replace(regexp_replace(replace(coalesce(text, ''), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(9), ' '), ' {2,}', ' ', 'g'), '^[\t\n\x0B\f\r  ]+|[\t\n\x0B\f\r  ]+$', '', 'g')"""


@query(f"SELECT doc_id, sha256({_CLEAN}) AS text_hash, length({_CLEAN}) AS n_chars FROM documents")
def q_text_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents").select("doc_id", X.clean_text(F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_hash"), F.length("t").cast("long").alias("n_chars"))


@query(r"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)),
 lambda x: regexp_replace(x, '^[\t\n\x0B\f\r  ]+|[\t\n\x0B\f\r  ]+$', '', 'g')), lambda x: x <> '')[1:80], chr(10))) AS lines_hash FROM documents""")
def q_relevant_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents").select("doc_id", X.relevant_lines(F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("lines_hash"))


@query()
def q_infer_label_line(spark: SparkSession, d: str) -> DataFrame:
    """The business name of documents that start with a labelled line."""
    head = F.when(F.col("doc_id") % 2 == 0, "Razón Social: Consorcio de Propietarios\n30-1/2\n").otherwise(F.concat(F.lit("RAZON SOCIAL: "), F.coalesce("source", F.lit("")), F.lit("\n")))
    docs = T.read(spark, d, "documents").select("doc_id", X.plain_lines(F.concat(head, F.coalesce("text", F.lit("")))).alias("lines"))
    return docs.select("doc_id", X.building_from_lines(F.col("lines")).alias("building"))


# --- usage and runs --------------------------------------------------------------------------------


@query(f"""WITH {_USE} SELECT client_id, CASE WHEN grouping(provider) = 1 AND grouping(model) = 1 THEN 'aggregate' WHEN grouping(model) = 1 THEN 'provider' ELSE 'model' END AS grain,
 coalesce(provider, model, 'aggregate') AS name, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_calls FROM use_ GROUP BY GROUPING SETS ((client_id), (client_id, provider), (client_id, model))""")
def q_usage_grains(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_grains(T.usage(spark, d))


@query(f"""WITH {_USE} SELECT client_id, bool_and(k > 2) AS all_enabled, bool_or(provider = 'error') AS any_error, CAST(max(run_at) AS VARCHAR)[1:19] AS last_run,
 CAST(sum(tokens) AS BIGINT) AS tokens, arg_max(k, struct_pack(a := run_at, b := event_id)) FILTER (WHERE provider = 'error') AS last_error,
 CASE max(CASE provider WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) WHEN 2 THEN 'limited' WHEN 1 THEN 'ok' ELSE 'unknown' END AS quota FROM use_ GROUP BY 1""")
def q_runtime_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Runtime state of each tenant: flags, latest run, sums, latest error, worst quota status."""
    rank = F.max(F.when(F.col("provider") == "error", 2).when(F.col("provider") == "purchase", 1).otherwise(0))
    out = T.usage(spark, d).groupBy("client_id").agg(
        F.bool_and(F.col("k") > 2).alias("all_enabled"),
        F.bool_or(F.col("provider") == "error").alias("any_error"),
        F.date_format(F.max("run_at"), "yyyy-MM-dd HH:mm:ss").alias("last_run"),
        F.sum("tokens").alias("tokens"),
        F.max_by(F.when(F.col("provider") == "error", F.col("k")), F.when(F.col("provider") == "error", F.struct("run_at", "event_id"))).alias("last_error"),
        F.element_at(F.array(F.lit("unknown"), F.lit("ok"), F.lit("limited")), rank + 1).alias("quota"),
    )
    return out


@query(f"""WITH {_USE}, r AS (SELECT client_id, CAST(run_at AS DATE) AS day, count(*) FILTER (WHERE provider <> 'error') AS n_ok, count(*) FILTER (WHERE provider = 'error') AS n_failed, CAST(sum(tokens) AS BIGINT) AS tokens FROM use_ GROUP BY 1, 2)
 SELECT client_id, CAST(day AS VARCHAR) AS day, n_ok, n_failed, tokens, CASE WHEN tokens % 13 = 0 THEN 'failed' WHEN n_failed = 0 THEN 'success' WHEN n_ok > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""")
def q_run_status(spark: SparkSession, d: str) -> DataFrame:
    """Daily runs of each tenant with their status."""
    bad = F.col("provider") == "error"
    out = T.usage(spark, d).groupBy("client_id", F.to_date("run_at").cast("string").alias("day")).agg(F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_failed"), F.sum("tokens").alias("tokens"))
    out = out.withColumn("error", F.when(F.col("tokens") % 13 == 0, "lost its lock"))
    return out.withColumn("status", jobs.run_status("n_ok", "n_failed", "error")).drop("error")


@query(f"""WITH {_USE}, g AS (SELECT event_id, client_id, run_at, lag(run_at) OVER (PARTITION BY client_id ORDER BY run_at, event_id) AS was FROM use_)
 SELECT event_id, client_id, coalesce(epoch_us(run_at) - epoch_us(was) >= 3600000000, true) AS gap_ok FROM g""")
def q_interval_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether an hour lies between a tenant's event and the one before."""
    return periods.lag_gate(T.usage(spark, d).select("event_id", "client_id", "run_at"), "client_id", "run_at", 3600, "event_id").select("event_id", "client_id", "gap_ok")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 g AS (SELECT event_id, user_id, n, ts AS last, true AS accepted FROM e WHERE n = 1
 UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN epoch_us(e.ts) - epoch_us(g.last) >= 3600000000 THEN e.ts ELSE g.last END, epoch_us(e.ts) - epoch_us(g.last) >= 3600000000 FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)
 SELECT event_id, user_id, accepted FROM g""")
def q_interval_gate_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Events that a gate of one hour since the last accepted event of the user lets through."""
    ticks = T.usage(spark, d).join(T.read(spark, d, "events").select("event_id", "user_id"), "event_id").select("event_id", "user_id", "run_at")
    return periods.greedy_gate(ticks, "user_id", "run_at", 3600, "event_id").select("event_id", "user_id", "accepted")


@query("""SELECT event_id, CAST(CAST(props->>'$.k' AS INTEGER) AS BIGINT) AS k, coalesce(nullif(trim(props->>'$.sheet'), ''), 'Sheet1') AS sheet,
 CASE WHEN CAST(props->>'$.k' AS INTEGER) < 10 THEN 'interval too short' ELSE '' END AS errors FROM events""")
def q_config_json(spark: SparkSession, d: str) -> DataFrame:
    """Settings decoded from JSON with defaults, and what is wrong with them."""
    e = T.read(spark, d, "events").select("event_id", F.from_json("props", "k int, sheet string").alias("c"))
    wrong = F.array_compact(F.array(F.when(F.col("c.k") < 10, "interval too short"), F.when(F.col("c.k").isNull(), "interval missing")))
    return e.select("event_id", F.col("c.k").cast("long").alias("k"), F.coalesce(F.nullif(X.js_trim(F.col("c.sheet")), F.lit("")), F.lit("Sheet1")).alias("sheet"), F.array_join(wrong, "; ").alias("errors"))


# --- periods ---------------------------------------------------------------------------------------


@query(f"""WITH {_PER}, a AS (SELECT c_nationkey AS client_id, year, month, count(*) AS n FROM per JOIN customer ON consortium_id = c_custkey GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY n DESC, year, month) AS k FROM a)
 SELECT CAST(client_id AS BIGINT) AS client_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, n AS n_periods FROM r WHERE k = 1""")
def q_majority_month(spark: SparkSession, d: str) -> DataFrame:
    rows = T.periods(spark, d).join(T.consortiums(spark, d).select("consortium_id", "client_id"), "consortium_id")
    return _longs(periods.majority_month(rows, "client_id"), "client_id", "year", "month")


_ACT = "act AS (SELECT consortium_id, year, month FROM (SELECT *, row_number() OVER (PARTITION BY consortium_id ORDER BY year DESC, month DESC) AS n FROM per) AS x WHERE n = 1)"


@query(f"WITH {_PER}, {_ACT} SELECT consortium_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, lpad(CAST(month AS VARCHAR), 2, '0') || '/' || CAST(year AS VARCHAR) AS label FROM act")
def q_active_period(spark: SparkSession, d: str) -> DataFrame:
    return _longs(periods.active_period(T.periods(spark, d), "consortium_id"), "year", "month")


@query(f"""WITH {_PER}, {_ACT}, a AS (SELECT act.*, c_nationkey AS client_id FROM act JOIN customer ON consortium_id = c_custkey),
 cnt AS (SELECT client_id, year, month, count(*) AS c FROM a GROUP BY 1, 2, 3),
 m AS (SELECT client_id, year AS my, month AS mm FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY c DESC, year, month) AS n FROM cnt) AS x WHERE n = 1)
 SELECT consortium_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CASE WHEN year = my AND month = mm THEN 'close' ELSE 'skip' END AS action,
 CAST(CASE WHEN year = my AND month = mm THEN year + CASE WHEN month = 12 THEN 1 ELSE 0 END END AS BIGINT) AS next_year,
 CAST(CASE WHEN year = my AND month = mm THEN month % 12 + 1 END AS BIGINT) AS next_month FROM a JOIN m ON m.client_id = a.client_id""")
def q_period_close_all(spark: SparkSession, d: str) -> DataFrame:
    """Close the active periods that are their tenant's majority month and open the next."""
    active = periods.active_period(T.periods(spark, d), "consortium_id").join(T.consortiums(spark, d).select("consortium_id", "client_id"), "consortium_id")
    mode = periods.majority_month(active, "client_id").select("client_id", F.col("year").alias("majority_year"), F.col("month").alias("majority_month"))
    out = periods.close_all(active.join(mode, "client_id"))
    return _longs(out.select("consortium_id", "year", "month", "action", "next_year", "next_month"), "year", "month", "next_year", "next_month")


# --- merges ----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 5 <> 0),
 s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE upper(c_name) END AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0)
 SELECT coalesce(t.k, s.k) AS consortium_id, coalesce(s.name, t.name) AS name, coalesce(s.seg, t.seg) AS segment, CASE WHEN t.k IS NULL THEN 'insert' WHEN s.k IS NOT NULL THEN 'update' ELSE 'keep' END AS action FROM t FULL JOIN s ON t.k = s.k""")
def q_sync_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the building directory merged."""
    c = T.read(spark, d, "customer")
    target = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("consortium_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    source = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("consortium_id"), F.when(F.col("c_custkey") % 7 != 0, F.upper("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    return merge.merge(target, source, ["consortium_id"])


@query("""WITH f AS (SELECT c_nationkey AS k, min(c_custkey) AS r FROM customer WHERE c_acctbal > 0 GROUP BY 1)
 SELECT CAST(k AS BIGINT) AS client_id, r AS row_number, c_name AS name FROM f JOIN customer ON c_custkey = r WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""")
def q_import_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an import whose key isn't there yet; of equal keys the first row."""
    rows = T.read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").cast("long").alias("client_id"), F.col("c_custkey").alias("row_number"), F.col("c_name").alias("name"))
    have = T.read(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("client_id"))
    return merge.insert_absent(have, rows, ["client_id"], "row_number")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def q_purge(spark: SparkSession, d: str) -> DataFrame:
    """Orders that stay when a tenant is purged."""
    gone = T.consortiums(spark, d).where("client_id = 7").select(F.col("consortium_id").alias("o_custkey"))
    return merge.without(T.read(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(f"""WITH {_INV} SELECT l_orderkey, l_linenumber::BIGINT AS line_number, '$ ' || translate(format('{{:,.2f}}', CAST(amount AS DOUBLE)), ',.', '.,') AS c,
 CASE month {' '.join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(K.MONTHS))} END AS d,
 CASE WHEN l_partkey % 700 < 26 THEN chr(CAST(65 + l_partkey % 700 AS INTEGER)) ELSE chr(CAST(64 + (l_partkey % 700) // 26 AS INTEGER)) || chr(CAST(65 + l_partkey % 700 % 26 AS INTEGER)) END AS e FROM inv""")
def q_sheet_row(spark: SparkSession, d: str) -> DataFrame:
    """Invoices as positional sheet columns: amount in pesos, month name, a column's letters."""
    inv = T.invoices(spark, d)
    return inv.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_number"), K.pesos(F.col("amount").cast("double")).alias("c"), K.month_name(F.col("month")).alias("d"), K.column_letters((F.col("l_partkey") % 700).cast("int")).alias("e"))


# --- sheets, quotas and counts -----------------------------------------------------------------------


@query(f"""WITH {_INV} SELECT DISTINCT CAST(l_orderkey % 1000 AS VARCHAR) || '|30-' || lpad(CAST(provider_id AS VARCHAR), 8, '0') || '-1|' || CAST(due_date AS VARCHAR) || '|' || printf('%.2f', CAST(amount AS DOUBLE)) AS business_key FROM inv""")
def q_existing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Business keys read back from sheet rows that a mapping wrote."""
    inv = T.invoices(spark, d)
    tax = F.concat(F.lit("30-"), F.lpad(F.col("provider_id").cast("string"), 8, "0"), F.lit("-1"))
    rows = inv.select((F.col("l_orderkey") % 1000).alias("boletaNumber"), tax.alias("providerTaxId"), F.col("due_date").alias("dueDate"), "amount")
    mapping = sheets.mapping_of(None)
    return sheets.duplicate_keys(sheets.sheet_row(rows, mapping), mapping)


@query(f"""WITH {_USE}, e AS (SELECT client_id, event_id, run_at, CASE WHEN k % 10 < 7 THEN list_extract(['Error 429', 'Quota exceeded', 'Too Many Requests', 'rate limit reached', 'insufficient_quota', 'limit: 0', 'server closed the connection'], k % 10 + 1) || repeat(' at step', k)
  WHEN provider = 'error' THEN 'timeout' END AS message FROM use_),
 r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY run_at DESC, event_id DESC) AS n FROM e WHERE message IS NOT NULL)
 SELECT client_id, CASE WHEN lower(message) LIKE '%quota%' OR message LIKE '%429%' OR lower(message) LIKE '%too many requests%' OR lower(message) LIKE '%rate limit%' OR lower(message) LIKE '%limit: 0%' THEN 'limited' ELSE 'ok' END AS quota_status,
  CASE WHEN length(message) > 300 THEN message[1:300] || '...' ELSE message END AS last_error FROM r WHERE n = 1""")
def q_quota_status(spark: SparkSession, d: str) -> DataFrame:
    """Quota status of each tenant after its last error."""
    u = T.usage(spark, d)
    said = F.array(*map(F.lit, ("Error 429", "Quota exceeded", "Too Many Requests", "rate limit reached", "insufficient_quota", "limit: 0", "server closed the connection")))
    message = F.when(F.col("k") % 10 < 7, F.concat(F.get(said, F.col("k") % 10), F.repeat(F.lit(" at step"), F.col("k")))).when(F.col("provider") == "error", "timeout")
    last = u.select("client_id", "event_id", "run_at", message.alias("m")).where("m is not null").groupBy("client_id").agg(F.max_by("m", F.struct("run_at", "event_id")).alias("last_error"))
    return last.select("client_id", F.when(jobs.is_quota_error(F.col("last_error")), "limited").otherwise("ok").alias("quota_status"), jobs.trimmed_error(F.col("last_error")).alias("last_error"))


@query("""SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def q_table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [T.read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("customer", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {_USE}, m AS (SELECT client_id, provider, CAST(sum(tokens) AS BIGINT) AS t FROM use_ GROUP BY 1, 2)
 SELECT client_id, string_agg(provider || '=' || CAST(t AS VARCHAR), ',' ORDER BY provider) AS by_provider, CAST(sum(t) AS BIGINT) AS tokens FROM m GROUP BY 1""")
def q_usage_maps(spark: SparkSession, d: str) -> DataFrame:
    """Token maps of runs added up key by key."""
    runs = T.usage(spark, d).groupBy("client_id", F.to_date("run_at").alias("day"), "provider").agg(F.sum("tokens").alias("t"))
    runs = runs.groupBy("client_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("provider", "t"))).alias("m"))
    summed = runs.select("client_id", F.explode("m")).groupBy("client_id", "key").agg(F.sum("value").alias("t"))
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "t"))), lambda x: F.concat(x["key"], F.lit("="), x["t"].cast("string"))), ",")
    return summed.groupBy("client_id").agg(each.alias("by_provider"), F.sum("t").alias("tokens"))


# --- extraction ------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
 w AS (SELECT doc_id, t, source, length(t) % 9 AS k FROM t)
 SELECT doc_id, CASE WHEN k NOT IN (4, 5, 6, 7, 8) THEN source END AS provider, CASE WHEN k NOT IN (4, 5, 6, 7, 8) THEN '30-' || lpad(CAST(length(t) AS VARCHAR), 8, '0') || '-5' END AS provider_tax_id,
 CASE WHEN k NOT IN (4, 5, 6, 7, 8) THEN t END AS detail, CASE WHEN k NOT IN (4, 5, 6, 7, 8) THEN CASE WHEN k = 0 THEN NULL ELSE length(t) + 0.5 END END AS amount,
 CASE WHEN k = 1 THEN 'EFECTIVO' END AS payment_method, CAST(CASE WHEN k = 2 THEN 2 END AS BIGINT) AS n_tax_ids, CASE WHEN k IN (4, 5, 6, 7, 8) THEN 'failed' ELSE 'parsed' END AS route FROM w""")
def q_extract_parse(spark: SparkSession, d: str) -> DataFrame:
    """A fenced JSON answer with the whole text of each document, parsed into a record; wrong types, unknown ways to pay and broken JSON fail."""
    from billforge.operators.extract import parse_answer

    t, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    k = n % 9
    fields = F.struct(
        F.col("source").alias("provider"), F.concat(F.lit("30"), F.lpad(n.cast("string"), 8, "0"), F.lit("5")).alias("providerTaxId"), t.alias("detail"),
        F.when(k > 0, n + 0.5).alias("amount"), F.when(k == 1, "EFECTIVO").when(k == 4, "BITCOIN").alias("paymentMethod"),
        F.when(k == 2, F.array(F.lit("30-1"), F.lit("2"))).alias("allTaxIds"), F.when(k == 5, F.array(F.lit(1))).alias("alias"), F.when(k == 6, F.struct(F.lit(1).alias("x"))).alias("consortium"), F.when(k == 3, "more").alias("unknown"),
    )
    answer = F.when(k == 7, F.lit("not json")).when(k == 8, F.lit("[1]")).otherwise(F.concat(F.lit("```json\n"), F.to_json(fields), F.lit("\n```")))
    out = parse_answer(T.read(spark, d, "documents").select("doc_id", answer.alias("answer")), "answer")
    return out.select("doc_id", "provider", "provider_tax_id", "detail", "amount", "payment_method", F.when(F.col("all_tax_ids").isNotNull(), F.size("all_tax_ids")).cast("long").alias("n_tax_ids"), "route")


@query("SELECT DISTINCT user_id % 25 AS client_id, event_type AS file_id FROM events")
def q_stream_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Each tenant and file once, from a stream of events."""
    from billforge.streaming.enqueue import enqueue_once

    return enqueue_once(spark, f"{d}/events.parquet", T.new_folder(spark))


# --- short forms, services, and who has no period ----------------------------------------------------


@query(r"""WITH d AS (SELECT doc_id, source, n_chars AS n, coalesce(source, '') || '-' || CAST(doc_id AS VARCHAR) AS id, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS t,
  CASE WHEN n_chars % 2 = 0 THEN '[' || CAST(400 + doc_id % 150 AS VARCHAR) || ' ' ELSE '' END || coalesce(text, '') AS m FROM documents),
 e AS (SELECT *, regexp_replace(string_split(m, chr(10))[1], '^\s+|\s+$', '', 'g') AS line FROM d),
 f AS (SELECT *, CASE WHEN length(line) > 220 THEN line[1:220] || '...' ELSE line END AS cut FROM e)
 SELECT doc_id, CASE WHEN length(id) <= 10 THEN id ELSE id[1:4] || '…' || right(id, 4) END AS short_id, h[1:6] || '...' || right(h, 6) AS short_hash,
  CASE WHEN length(t) > 70 THEN t[1:70] || '...' ELSE t END AS short_key,
  CASE WHEN n * 37 < 1000 THEN CAST(n * 37 AS VARCHAR) || 'ms' WHEN n * 37 < 60000 THEN CAST(n * 37 // 1000 AS VARCHAR) || 's' ELSE CAST(n * 37 // 60000 AS VARCHAR) || 'm ' || CAST(n * 37 // 1000 % 60 AS VARCHAR) || 's' END AS took,
  CASE WHEN regexp_matches(line, '\[[0-9]{3}\s') THEN 'HTTP ' || regexp_extract(line, '\[([0-9]{3})\s', 1) || ': ' || cut ELSE cut END AS error,
  sha256('manual:' || coalesce(source, '') || ':' || CAST(n AS VARCHAR) || ':') AS manual_hash FROM f""")
def q_short_forms(spark: SparkSession, d: str) -> DataFrame:
    """Ids, hashes, keys, durations and errors as they are shown."""
    docs, n, t = T.read(spark, d, "documents"), F.col("n_chars"), F.coalesce("text", F.lit(""))
    said = F.concat(F.when(n % 2 == 0, F.concat(F.lit("["), (400 + F.col("doc_id") % 150).cast("string"), F.lit(" "))).otherwise(""), t)
    return docs.select(
        "doc_id", S.short_id(F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string"))).alias("short_id"), S.short_hash(F.sha2(t.cast("binary"), 256)).alias("short_hash"),
        S.short_key(t).alias("short_key"), S.duration(n * 37).alias("took"), S.compact_error(said).alias("error"), S.manual_hash(F.col("source"), n, F.lit(None)).alias("manual_hash"),
    )


@query("""WITH m AS (SELECT event_id, ts, CASE CAST(CAST(props->>'$.k' AS INTEGER) % 5 AS INTEGER) WHEN 0 THEN 'Gemini-2' WHEN 1 THEN 'GPT-4' WHEN 2 THEN 'o3-mini' WHEN 3 THEN 'local' END AS model, user_id FROM events)
 SELECT CASE WHEN lower(coalesce(model, '')) LIKE '%gemini%' THEN 'gemini' WHEN lower(coalesce(model, '')) LIKE '%gpt%' OR lower(coalesce(model, '')) LIKE '%o1%' OR lower(coalesce(model, '')) LIKE '%o3%' THEN 'openai' ELSE 'unknown' END AS vendor,
 count(*) AS n, CAST(sum(greatest(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-02') // 1000, 0)) AS BIGINT) AS millis FROM m GROUP BY 1""")
def q_vendor_of_model(spark: SparkSession, d: str) -> DataFrame:
    """Calls and run time of each vendor, told by the model's name."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    model = F.when(k == 0, "Gemini-2").when(k == 1, "GPT-4").when(k == 2, "o3-mini").when(k == 3, "local")
    took = S.run_millis(F.lit("2024-01-02 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp"))
    return T.read(spark, d, "events").groupBy(S.vendor_of_model(model).alias("vendor")).agg(F.count(F.lit(1)).alias("n"), F.sum(took).alias("millis"))


@query("SELECT c_nationkey AS client_id, c_custkey AS consortium_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def q_without_active_period(spark: SparkSession, d: str) -> DataFrame:
    """Buildings without an active period (an open order)."""
    active = T.read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("consortium_id"))
    return T.consortiums(spark, d).join(active, "consortium_id", "left_anti").select("client_id", "consortium_id")


@query("""WITH s AS (SELECT c_custkey AS service_id, c_nationkey AS client_id, CASE WHEN c_acctbal > 3000 THEN c_custkey % 40 END AS vendor_id, c_mktsegment AS vendor, nullif(CAST(c_custkey * 10 AS VARCHAR), '0') AS number FROM customer),
 o AS (SELECT o_orderkey, c_nationkey AS client_id, CASE WHEN o_orderstatus <> 'F' THEN o_custkey % 40 END AS vendor_id, CASE WHEN o_totalprice > 90000 THEN c_mktsegment ELSE 'OTHER' END AS vendor, nullif(CAST(o_custkey * 10 AS VARCHAR), '0') AS number FROM orders JOIN customer ON o_custkey = c_custkey),
 a AS (SELECT o_orderkey, min(service_id) AS service_id FROM o JOIN s USING (client_id, vendor_id, number) GROUP BY 1), b AS (SELECT o_orderkey, min(service_id) AS service_id FROM o JOIN s USING (client_id, vendor, number) GROUP BY 1)
 SELECT o.o_orderkey, coalesce(a.service_id, b.service_id) AS service_id, CAST(CASE WHEN a.service_id IS NOT NULL THEN 1 WHEN b.service_id IS NOT NULL THEN 2 END AS BIGINT) AS rule,
  CASE WHEN coalesce(a.service_id, b.service_id) IS NOT NULL AND s.vendor_id IS NULL THEN o.vendor_id END AS filled_vendor_id
 FROM o LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_orderkey) LEFT JOIN s ON s.service_id = coalesce(a.service_id, b.service_id)""")
def q_match_service(spark: SparkSession, d: str) -> DataFrame:
    """The fast path by a service's number with the vendor's id, then with the vendor's text; services without an id get it filled."""
    c = T.read(spark, d, "customer")
    number = K.client_number(F.lpad((F.col("c_custkey") * 10).cast("string"), 12, "0"))
    services = c.select(F.col("c_custkey").alias("match_id"), F.col("c_nationkey").alias("client_id"), F.when(F.col("c_acctbal") > 3000, F.col("c_custkey") % 40).alias("vendor_id"), F.col("c_mktsegment").alias("vendor"), number.alias("number"))
    orders = T.read(spark, d, "orders").join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    docs = orders.select(
        F.col("o_orderkey").alias("doc_id"), F.col("c_nationkey").alias("client_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 40).alias("vendor_id"),
        F.when(F.col("o_totalprice") > 90000, F.col("c_mktsegment")).otherwise("OTHER").alias("vendor"), K.client_number(F.lpad((F.col("o_custkey") * 10).cast("string"), 12, "0")).alias("number"),
    )
    rules = [(n, lambda x, key=key: x.join(services.select("match_id", *key), key).select("doc_id", "match_id")) for n, key in ((1, ["client_id", "vendor_id", "number"]), (2, ["client_id", "vendor", "number"]))]
    best = match.in_turn(docs, rules, T.settled).join(services.select("match_id", F.col("vendor_id").alias("known")), "match_id")
    out = docs.select("doc_id", "vendor_id").join(best, "doc_id", "left")
    filled = F.when(F.col("match_id").isNotNull() & F.col("known").isNull(), F.col("vendor_id"))
    return out.select(F.col("doc_id").alias("o_orderkey"), F.col("match_id").alias("service_id"), F.col("rule").cast("long").alias("rule"), filled.alias("filled_vendor_id"))
