"""Registered queries of run records, directory sync, imports, configs and the document pipeline, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions import address as A
from billforge.functions import shown as S
from billforge.functions import text as X
from billforge.operators import configs, directory, jobs, pages, queue, runs
from billforge.plans.queries import _BILL_SQL, _INV, _NAME_SQL, _PER, _RAW_SQL, _WORDS, _longs, _raw_addresses, _sql_any, query
from billforge.operators.extract import parse_answer
from billforge.sources import extractors
from billforge.sources import tables as T

# --- run summaries, log, counters, usage rows --------------------------------------------------------

#: what each summary of _runs says: k % 6 tells its shape, 3 and 4 are none
_RUNS = """ev AS (SELECT event_id, user_id, ts, event_type, CAST(props->>'$.k' AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS t FROM events),
 runs AS (SELECT *, k % 6 AS n, k % 6 NOT IN (3, 4) AS has, CASE WHEN event_type = 'error' THEN 'broken ' || CAST(k AS VARCHAR) END AS error FROM ev),
 s AS (SELECT event_id, user_id, ts, n, t, k, event_type, error, has, k AS total_found, CASE WHEN n = 5 THEN 0 ELSE k % 5 END AS processed, k % 3 AS skipped, k % 4 AS failed,
  CASE WHEN n = 0 THEN 0 ELSE 1 END AS unassigned, CASE WHEN n = 1 THEN 1 ELSE k % 2 END AS duplicates, CASE WHEN n = 1 THEN 3 ELSE 0 END AS n_errors,
  CASE n WHEN 1 THEN t WHEN 2 THEN t ELSE 0 END AS input_tokens, CASE n WHEN 1 THEN k ELSE 0 END AS output_tokens, CASE n WHEN 0 THEN t WHEN 1 THEN t + k ELSE 0 END AS total_tokens FROM runs)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs with a stored summary of one of six shapes, old ones among them."""
    e = T.spread(T.read(spark, d, "events")).withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("t", F.round(F.col("value") * 100).cast("long"))
    n = F.col("k") % 6

    def put(template: str):
        for name, c in (("K5", F.col("k") % 5), ("K4", F.col("k") % 4), ("K3", F.col("k") % 3), ("K2", F.col("k") % 2), ("K", F.col("k")), ("T", F.col("t"))):
            template = F.replace(F.lit(template) if isinstance(template, str) else template, F.lit(f"<{name}>"), c.cast("string"))
        return template

    counts = '"totalFound":<K>,"skipped":<K3>,"failed":<K4>'
    old = put("{" + counts + ',"processed":<K5>,"duplicatesDetected":<K2>,"tokenUsage":{"totalTokens":<T>,"byProvider":{"gemini":<T>},"byModel":{"gpt-4o":<T>}}}')
    new = put(
        "{" + counts + ',"processed":<K5>,"unassigned":1,"duplicatesDetected":true,"errors":[{"fileId":"f1","error":"x"},5,[],{"fileName":7}],"tokenUsage":{"inputTokens":<T>,"outputTokens":<K>,"totalTokens":'
        '"<S>","byProvider":{"openai":{"inputTokens":<T>,"outputTokens":<K>,"totalTokens":<S>},"bad":"x"},"byModel":{"gemini-2":{"totalTokens":<T>},"o1":{"outputTokens":<K>}}}}'
    )
    new = F.replace(new, F.lit("<S>"), (F.col("t") + F.col("k")).cast("string"))
    texts = put("{" + counts + ',"processed":" <K5> ","unassigned":"1","duplicatesDetected":<K2>,"tokenUsage":{"inputTokens":"<T>","byProvider":[1],"byModel":3}}')
    odd = put("{" + counts + ',"processed":"abc","unassigned":true,"duplicatesDetected":<K2>,"errors":"none","tokenUsage":7}')
    json = F.when(n == 0, old).when(n == 1, new).when(n == 2, texts).when(n == 3, "[1]").when(n == 5, odd)
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), F.col("k").cast("string")))
    return runs.with_summary(e.select("event_id", "user_id", "k", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("trigger"), error.alias("error"), json.alias("json")), "json")


_SUMS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE has), 0) AS BIGINT) AS {c}" for c in (*runs.COUNTS, *runs.TOKENS))


@query(f"""WITH {_RUNS}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
 SELECT count(*) FILTER (WHERE has) AS n_summaries, {_SUMS}, CAST(coalesce(sum(n_errors) FILTER (WHERE has), 0) AS BIGINT) AS n_errors FROM l""")
def q_last_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The last summary of each user's runs, added up."""
    last = _runs(spark, d).groupBy("user_id").agg(F.max_by("summary", F.struct("ts", "event_id")).alias("summary"))
    return runs.added_up(last, "summary")


@query(f"""WITH {_RUNS} SELECT user_id, count(*) AS total_runs, {_SUMS}, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_trigger,
 list_extract(list(error ORDER BY ts DESC, event_id DESC), 1) AS last_error FROM s GROUP BY 1""")
def q_run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each user: those stored up to the middle of the table's time, and the log since added."""
    log = _runs(spark, d)
    middle = log.agg(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long")).first()[0]
    at, old = F.struct("ts", "event_id"), F.unix_micros("ts") <= F.lit(middle)
    stored = runs.counters(log.where(old), "user_id", "summary", at)
    return runs.counters(log.where(~old), "user_id", "summary", at, stored=stored)


@query(f"""WITH {_RUNS} SELECT event_id, CASE WHEN error IS NOT NULL OR NOT has THEN 'failed' WHEN failed > 0 AND processed > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'success' END AS status,
 CAST(greatest((k - 50) * 1000, 0) AS BIGINT) AS duration_ms FROM s""")
def q_run_log(spark: SparkSession, d: str) -> DataFrame:
    """Status and duration of every run; an end before the start counts as none."""
    log = _runs(spark, d).withColumns({"processed": F.col("summary.processed"), "failed": F.col("summary.failed"), "ended": F.timestamp_millis(F.unix_millis("ts") + (F.col("k") - 50) * 1000)})
    return log.select("event_id", jobs.run_status("processed", "failed", "error").alias("status"), S.run_millis(F.col("ts"), F.col("ended")).alias("duration_ms"))


@query(f"""WITH {_RUNS} SELECT event_id, 'aggregate' AS grain, 'aggregate' AS provider, NULL AS model, input_tokens, output_tokens, total_tokens FROM s WHERE has AND total_tokens > 0
 UNION ALL SELECT event_id, 'provider', 'gemini', NULL, 0, 0, t FROM s WHERE n = 0 UNION ALL SELECT event_id, 'provider', 'openai', NULL, t, k, t + k FROM s WHERE n = 1
 UNION ALL SELECT event_id, 'model', 'openai', 'gpt-4o', 0, 0, t FROM s WHERE n = 0 UNION ALL SELECT event_id, 'model', 'gemini', 'gemini-2', 0, 0, t FROM s WHERE n = 1 UNION ALL SELECT event_id, 'model', 'openai', 'o1', 0, k, 0 FROM s WHERE n = 1""")
def q_usage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Usage rows of every run at three grains."""
    return runs.usage_rows(_runs(spark, d).select("event_id", "summary"), "summary")


# --- directory sync and imports ----------------------------------------------------------------------


@query("""WITH sh AS (SELECT o_orderkey, c_nationkey AS client_id, upper(trim(c_name)) || CASE WHEN o_orderstatus = 'P' THEN ' BIS' ELSE '' END AS consortium_name,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE upper(s_name) END AS provider, CASE WHEN o_orderkey % 9 = 0 THEN '000' ELSE lpad(CAST(o_orderkey % 1000 AS VARCHAR), 6, '0') END AS number
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 50),
 r AS (SELECT * FROM sh WHERE provider <> '')
 SELECT o_orderkey, c_custkey AS consortium_id, s_suppkey AS provider_id, CASE WHEN ltrim(number, '0') = '' THEN number ELSE ltrim(number, '0') END AS client_number,
  CASE WHEN c_custkey IS NULL THEN 'LspService ignorado: consorcio "' || consortium_name || '" no encontrado para proveedor ' || provider || ' nro ' || number END AS warning
 FROM r LEFT JOIN customer ON upper(c_name) = consortium_name AND c_nationkey = client_id LEFT JOIN supplier ON upper(s_name) = provider AND s_nationkey = client_id""")
def q_sync_services(spark: SparkSession, d: str) -> DataFrame:
    """A services tab with the ids that its names stand for, or a warning."""
    b = T.consortiums(spark, d).withColumn("consortium_name", F.upper("consortium_name"))
    o = T.read(spark, d, "orders").join(T.consortiums(spark, d).withColumnRenamed("consortium_id", "o_custkey"), "o_custkey")
    o = o.join(T.providers(spark, d).select(F.col("provider_id").alias("_p"), "provider_name"), F.col("_p") == F.col("o_orderkey") % 50, "left")
    sheet = o.select(
        "o_orderkey", "client_id", F.concat(F.lit(" "), F.lower("consortium_name"), F.when(F.col("o_orderstatus") == "P", " bis").otherwise(" ")).alias("a"),
        F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.lower("provider_name")).alias("b"),
        F.when(F.col("o_orderkey") % 9 == 0, "000").otherwise(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 6, "0")).alias("c"), F.lit(None).alias("d"),
    )
    vendors = T.providers(spark, d).withColumnRenamed("provider_client", "client_id")
    return directory.services(directory.read_tab(sheet, "_LspServices"), b, vendors, "client_id").select("o_orderkey", "consortium_id", "provider_id", "client_number", "warning")


@query("""WITH synced AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000)
 SELECT CAST(s_nationkey AS BIGINT) AS client_id, s_name AS name, 'stored' AS origin FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM synced)
 UNION ALL SELECT CAST(c_nationkey AS BIGINT), upper(c_name), 'sheet' FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (SELECT k FROM synced)""")
def q_sync_replace(spark: SparkSession, d: str) -> DataFrame:
    """A catalog whose rows are replaced as a whole for the tenants that were synced."""
    stored = T.providers(spark, d).select(F.col("provider_client").cast("long").alias("client_id"), F.col("provider_name").alias("name"), F.lit("stored").alias("origin"))
    c = T.read(spark, d, "customer").withColumn("client_id", F.col("c_nationkey").cast("long"))
    sheet = c.where("c_acctbal > 0").select("client_id", F.concat(F.lit(" "), "c_name").alias("a"), F.lit("").alias("b"))
    sheet = directory.read_tab(sheet, "_Rubros").select("client_id", "name", F.lit("sheet").alias("origin"))
    return directory.replaced(stored, sheet, c.where("c_acctbal > 9000"), "client_id")


@query("""SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS consortium_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_sync_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Invoices after a sync: those of buildings that the sheet names no more lose their building."""
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("consortium_id"), F.col("c_nationkey").alias("client_id"), F.col("c_name").alias("name"), "c_acctbal")
    gone = directory.orphans(c, c.where("c_acctbal >= 0"), ["client_id", "name"])
    return directory.set_null(T.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("consortium_id")), "consortium_id", gone, "consortium_id")


@query("""WITH act AS (SELECT o_custkey AS b, max(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
 f AS (SELECT c_nationkey AS c, p, count(*) AS n FROM act JOIN customer ON b = c_custkey GROUP BY ALL),
 m AS (SELECT c, arg_min(p, struct_pack(a := -n, b := p)) AS p FROM f GROUP BY 1)
 SELECT c_nationkey AS client_id, c_custkey AS consortium_id, CAST(coalesce(p // 12, 2024) AS BIGINT) AS year, CAST(coalesce(p % 12 + 1, 6) AS BIGINT) AS month
 FROM customer LEFT JOIN m ON c = c_nationkey WHERE c_custkey NOT IN (SELECT b FROM act)""")
def q_first_periods(spark: SparkSession, d: str) -> DataFrame:
    """Periods to open for buildings without an active one."""
    p = T.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("consortium_id"), F.struct(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).alias("p"))
    active = p.groupBy("consortium_id").agg(F.max("p").alias("p")).select("consortium_id", "p.year", "p.month")
    b = T.consortiums(spark, d)
    return directory.first_periods(b, active.join(b, "consortium_id"), tenant="client_id", building="consortium_id", now=(2024, 6))


@query("""WITH r AS (SELECT c_nationkey AS client_id, c_custkey + 2 AS row_number, CASE WHEN c_acctbal < 0 THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'Edificio ' || CAST(c_custkey // 40 AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS cuit FROM customer)
 SELECT client_id, row_number, nullif(name, '') AS name, cuit, CASE WHEN name = '' THEN 'error'
   WHEN name IN (SELECT c_name FROM customer WHERE c_acctbal > 5000 AND c_nationkey = client_id) OR row_number > min(row_number) OVER (PARTITION BY client_id, name) THEN 'skipped' ELSE 'imported' END AS outcome,
  CASE WHEN name = '' THEN 'Fila ' || CAST(row_number AS VARCHAR) || ': columna "Nombre" vacía — omitida' END AS message FROM r""")
def q_import_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row of an import: imported, skipped, or an error with its row number."""
    c = T.read(spark, d, "customer")
    name = F.when(F.col("c_acctbal") < 0, "  ").when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Edificio "), F.floor(F.col("c_custkey") / 40).cast("string"))).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    rows = c.select(F.col("c_nationkey").alias("client_id"), F.col("c_custkey").alias("at"), name.alias("nombre"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("Cuit"))
    have = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("client_id"), F.col("c_name").alias("name"))
    return directory.import_buildings(rows, have, tenant="client_id", row="at").select("client_id", "row_number", "name", "cuit", "outcome", "message")


# --- configs -----------------------------------------------------------------------------------------

_FOLDERS = """f AS (SELECT c_custkey, c_custkey % 7 AS n, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '.' WHEN 3 THEN 'same' ELSE 'p' || CAST(c_custkey AS VARCHAR) END AS pending,
 CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 3 THEN 'same' WHEN 4 THEN NULL WHEN 5 THEN '.' ELSE 's' || CAST(c_custkey AS VARCHAR) END AS scanned FROM customer)"""


def _folders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pending = F.when(k % 7 == 1, "  ").when(k % 7 == 2, ".").when(k % 7 == 3, " same").otherwise(F.concat(F.lit("p"), k.cast("string")))
    scanned = F.when(k % 7 == 3, "same ").when(k % 7 == 5, ".").when(k % 7 != 4, F.concat(F.lit("s"), k.cast("string")))
    return T.read(spark, d, "customer").select("c_custkey", F.when(k % 7 != 0, F.to_json(F.struct(pending.alias("pending"), scanned.alias("scanned")))).alias("folders"))


@query(f"""WITH {_FOLDERS} SELECT c_custkey, concat_ws(',', CASE WHEN n = 0 THEN 'no_folders' END, CASE WHEN coalesce(pending, '') = '' THEN 'pending_missing' WHEN pending = '.' THEN 'pending_invalid' END,
 CASE WHEN coalesce(scanned, '') = '' THEN 'scanned_missing' WHEN scanned = '.' THEN 'scanned_invalid' END, CASE WHEN pending <> '' AND pending = scanned THEN 'same_folder' END) AS issues FROM f""")
def q_folder_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each tenant's folders."""
    return _folders(spark, d).select("c_custkey", F.concat_ws(",", configs.folder_issues(F.col("folders"))).alias("issues"))


@query(f"""WITH {_FOLDERS} SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN n = 1 THEN '  ' WHEN n = 3 THEN ' same' ELSE pending END AS pending,
 CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN n = 3 THEN 'same ' ELSE scanned END AS scanned FROM f""")
def q_patch_config(spark: SparkSession, d: str) -> DataFrame:
    """Folder configs after a sparse patch; an explicit null takes a key out."""
    k = F.col("c_custkey")
    patch = F.map_concat(F.when(k % 3 == 0, F.create_map(F.lit("pending"), F.lit("new"))).otherwise(configs.no_entries()), F.when(k % 5 == 0, F.create_map(F.lit("scanned"), F.lit(None).cast("string"))).otherwise(configs.no_entries()))
    out = _folders(spark, d).select("c_custkey", configs.patched(configs.as_map(F.col("folders")), patch).alias("m"))
    return out.select("c_custkey", F.col("m")["pending"].alias("pending"), F.col("m")["scanned"].alias("scanned"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 700 NOT BETWEEN 1 AND 500 THEN 'batchSize' END, CASE WHEN o_custkey NOT BETWEEN 1 AND 1440 THEN 'intervalMinutes' END,
 CASE WHEN length(o_orderstatus) < 2 THEN 'name' END) AS invalid FROM orders""")
def q_invalid_patches(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each request that are out of range."""
    body = F.to_json(F.struct((F.col("o_orderkey") % 700).alias("batchSize"), F.col("o_custkey").alias("intervalMinutes"), F.col("o_orderstatus").alias("name")))
    return T.read(spark, d, "orders").select("o_orderkey", F.concat_ws(",", configs.violations(body)).alias("invalid"))


# --- queue and lists ---------------------------------------------------------------------------------


@query("""SELECT o_orderkey, 'PROCESSING' AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def q_claim_next(spark: SparkSession, d: str) -> DataFrame:
    """The oldest waiting job, claimed."""
    waiting = T.read(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMPLETED").alias("status"))
    return queue.claimed(waiting, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "status")


@query("""SELECT o_orderkey, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def q_latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return queue.latest(T.read(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 10).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query(f"""WITH {_PER}, a AS (SELECT DISTINCT o_custkey AS consortium_id, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE o_orderstatus = 'P'),
 p AS (SELECT per.*, a.year IS NOT NULL AS active FROM per LEFT JOIN a USING (consortium_id, year, month))
 SELECT consortium_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, CASE WHEN active THEN 'ACTIVE' ELSE 'CLOSED' END AS status FROM p
 QUALIFY row_number() OVER (PARTITION BY consortium_id ORDER BY active DESC, year DESC, month DESC) = 1""")
def q_selected_period(spark: SparkSession, d: str) -> DataFrame:
    """The period that a building's page opens with."""
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("consortium_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "P").alias("active"))
    p = o.groupBy("consortium_id", "year", "month").agg(F.max("active").alias("active")).withColumn("status", F.when(F.col("active"), "ACTIVE").otherwise("CLOSED"))
    return _longs(queue.selected_period(p, "consortium_id"), "year", "month")


@query("""SELECT CAST(c_nationkey AS BIGINT) AS client_id, greatest(count(o_orderkey) + 2, 2) AS next_row, 'A' || CAST(greatest(count(o_orderkey) + 2, 2) AS VARCHAR) || ':M' || CAST(greatest(count(o_orderkey) + 2, 2) AS VARCHAR) AS range
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q_next_sheet_row(spark: SparkSession, d: str) -> DataFrame:
    """Where the next row of each tenant's sheet goes, below a heading and its invoices."""
    b = T.consortiums(spark, d)
    n = T.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("consortium_id")).count()
    rows = b.join(n, "consortium_id", "left").groupBy(F.col("client_id").cast("long").alias("client_id")).agg((F.coalesce(F.sum("count"), F.lit(0)) + 1).alias("rows"))
    return rows.select("client_id", *queue.next_row(F.col("rows")))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey, s_name AS coeficiente, n_name AS rubro FROM lineitem
 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN nation ON n_nationkey = s_nationkey""")
def q_invoice_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Invoices with the names of their catalog entries, null where these are gone."""
    lines = T.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_number"), "l_partkey", "l_suppkey")
    s = T.read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("coeficiente"), F.col("s_nationkey").alias("client_id"))
    n = T.clients(spark, d).select("client_id", F.col("client_name").alias("rubro"))
    return lines.join(s.join(n, "client_id", "left"), "l_suppkey", "left").select("l_orderkey", "line_number", "l_partkey", "coeficiente", "rubro")


# --- extractors ------------------------------------------------------------------------------------------

_HEAD = """CASE WHEN doc_id % 3 < 2 THEN 'Razón Social: Consorcio ' || source || ' ' || doc_id % 50 || chr(10) ELSE '' END || CASE WHEN doc_id % 4 > 0 THEN 'CUIT 30-' || lpad(CAST(doc_id % 70 AS VARCHAR), 8, '0') || '-1' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 5 > 0 THEN 'Factura Nº ' || doc_id || chr(10) ELSE '' END || 'TOTAL: $ 1.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ',50' || chr(10) || text"""


@query(rf"""WITH b AS (SELECT doc_id, text IS NULL AS none, {_HEAD} AS t FROM documents),
 x AS (SELECT doc_id, none, t, nullif(regexp_extract(t, '(?i)raz[oó]n social: *([^
]*[^
 ])', 1), '') AS consortium, nullif(regexp_extract(t, '(?i)(?:boleta|factura) n[º°ro.]* *([0-9][0-9-]*)', 1), '') AS number, list_extract(regexp_extract_all(t, '[0-9]{{2}}-[0-9]{{8}}-[0-9]'), 1) AS tax FROM b),
 y AS (SELECT *, CASE WHEN none THEN NULL WHEN consortium IS NOT NULL AND number IS NOT NULL THEN 'labelled-lines' WHEN number IS NOT NULL THEN 'numbers' END AS model FROM x)
 SELECT doc_id, model, CASE WHEN model IS NOT NULL THEN consortium END AS consortium, CASE WHEN model IS NOT NULL THEN number END AS boleta_number, CASE WHEN model IS NOT NULL THEN tax END AS provider_tax_id,
  CASE WHEN model IS NOT NULL THEN 1000.5 + doc_id % 1000 END AS amount, CASE WHEN model = 'labelled-lines' OR none THEN '' WHEN model = 'numbers' THEN 'rules: no consortium in the text' WHEN consortium IS NULL THEN 'rules: no consortium in the text; rules: no boletaNumber in the text' ELSE 'rules: no boletaNumber in the text; rules: no boletaNumber in the text' END AS errors FROM y""")
def q_extractors(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labelled lines read by two extractors in turn, and the errors of those that could not."""
    i = F.col("doc_id")
    tax = F.concat(F.lit("CUIT 30-"), F.lpad((i % 70).cast("string"), 8, "0"), F.lit("-1\n"))
    head = F.concat(
        F.when(i % 3 < 2, F.concat(F.lit("Razón Social: Consorcio "), "source", F.lit(" "), (i % 50).cast("string"), F.lit("\n"))).otherwise(""), F.when(i % 4 > 0, tax).otherwise(""),
        F.when(i % 5 > 0, F.concat(F.lit("Factura Nº "), i.cast("string"), F.lit("\n"))).otherwise(""), F.lit("TOTAL: $ 1."), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(",50\n"), "text",
    )
    chain = [extractors.Rules(("consortium", "boletaNumber")), extractors.Rules(("boletaNumber",), model="numbers")]
    out = parse_answer(extractors.extract(T.spread(T.read(spark, d, "documents").select("doc_id", head.alias("text"))), chain).withColumnRenamed("provider", "by"), "answer")
    return out.select("doc_id", "model", "consortium", "boleta_number", "provider_tax_id", "amount", F.array_join("errors", "; ").alias("errors"))


# --- pages -----------------------------------------------------------------------------------------------


@query(f"""WITH {_INV} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey, CASE WHEN l_linenumber = 3 THEN '-' ELSE '' END || '$' || chr(160) || translate(format('{{:,.2f}}', CAST(amount AS DOUBLE)), ',.', '.,') AS amount,
 CASE WHEN l_linenumber = 4 THEN '—' ELSE CAST(day(due_date) AS VARCHAR) || '/' || CAST(month(due_date) AS VARCHAR) || '/' || CAST(year(due_date) AS VARCHAR) END AS due, CAST(due_date AS VARCHAR) AS input FROM inv""")
def q_shown_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and dates of invoices as pages show them."""
    inv = T.invoices(spark, d)
    amount, due = F.when(F.col("l_linenumber") == 3, -F.col("amount")).otherwise(F.col("amount")), F.when(F.col("l_linenumber") != 4, F.col("due_date"))
    iso = F.concat(F.col("due_date").cast("string"), F.lit("T00:00:00.000Z"))
    return inv.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_number"), "l_partkey", S.shown_amount(amount).alias("amount"), S.shown_date(due).alias("due"), S.input_date(iso).alias("input"))


@query("""WITH v AS (SELECT s_suppkey AS id, s_nationkey AS c, '30' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '1' AS cuit, 'proveedor sa ' || CAST(s_suppkey AS VARCHAR) AS n, CASE WHEN s_acctbal > 5000 THEN 'pago ' || CAST(s_suppkey AS VARCHAR) END AS a FROM supplier),
 o AS (SELECT o_orderkey, c_nationkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN '30' || lpad(CAST(o_custkey % 60 AS VARCHAR), 8, '0') || '1' END AS tax, CASE WHEN o_orderstatus = 'P' THEN 'pago ' ELSE 'proveedor sa ' END || CAST(o_custkey % 70 AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
 t AS (SELECT o_orderkey, min(id) AS id FROM o JOIN v ON o.c = v.c AND cuit = tax GROUP BY 1), m AS (SELECT o_orderkey, min(id) AS id FROM o JOIN v ON o.c = v.c AND (v.n = o.n OR v.a = o.n) GROUP BY 1)
 SELECT o.o_orderkey, coalesce(t.id, m.id) AS vendor_id, CAST(CASE WHEN t.id IS NOT NULL THEN 0 WHEN m.id IS NOT NULL THEN 1 END AS BIGINT) AS rule FROM o LEFT JOIN t USING (o_orderkey) LEFT JOIN m USING (o_orderkey)""")
def q_vendor_of_scan(spark: SparkSession, d: str) -> DataFrame:
    """The vendor of each scan by tax id, name or payment alias, as pages match them."""
    n = F.col("s_suppkey").cast("string")
    vendors = T.read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("match_id"), F.col("s_nationkey").alias("client_id"), F.concat(F.lit("30-"), F.lpad(n, 8, "0"), F.lit("-1")).alias("cuit"),
        F.concat(F.lit("Proveedor S.A. "), n).alias("name"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("pago_"), n)).alias("payment_alias"),
    ).withColumn("name", F.replace("name", F.lit("S.A."), F.lit("SA.")))
    o = T.read(spark, d, "orders").join(T.consortiums(spark, d).withColumnRenamed("consortium_id", "o_custkey"), "o_custkey")
    tax = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("30 "), F.lpad((F.col("o_custkey") % 60).cast("string"), 8, "0"), F.lit(" 1")))
    told = F.concat(F.when(F.col("o_orderstatus") == "P", " PAGO-").otherwise("proveedor, sa  "), (F.col("o_custkey") % 70).cast("string"))
    scans = T.settled(o.select(F.col("o_orderkey").alias("doc_id"), "client_id", told.alias("provider"), tax.alias("provider_tax_id")))
    found = pages.vendor_of_scan(scans, vendors, "client_id", T.settled)
    return scans.join(found, "doc_id", "left").select(F.col("doc_id").alias("o_orderkey"), F.col("match_id").alias("vendor_id"), F.col("rule").cast("long").alias("rule"))


@query(f"""WITH {_RAW_SQL}, {_NAME_SQL}, known_ AS (SELECT client_id, name, min(raw) AS known FROM named JOIN part USING (p_partkey) WHERE name <> '' AND p_size <= 25 GROUP BY 1, 2),
 sel AS (SELECT a.*, b.name AS selected FROM named a LEFT JOIN named b ON b.p_partkey = a.p_partkey - a.p_partkey % 2),
 mis AS (SELECT *, coalesce(name <> '' AND selected <> '' AND name <> selected, false) AS mismatch FROM sel)
 SELECT p_partkey, mismatch, CASE WHEN mismatch THEN coalesce(known, trim(raw)) END AS found FROM mis x LEFT JOIN known_ k ON k.client_id = x.client_id AND k.name = x.name""")
def q_building_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Scans that name another building than the one selected."""
    named = T.settled(_raw_addresses(spark, d).withColumn("name", A.building_name(F.col("raw"))))
    selected = named.select(F.col("p_partkey").alias("_b"), F.col("name").alias("selected"))
    scans = named.join(selected, F.col("_b") == F.col("p_partkey") - F.col("p_partkey") % 2, "left")
    small = T.read(spark, d, "part").where("p_size <= 25").select("p_partkey")
    known = named.join(small, "p_partkey").select("client_id", "name", F.col("raw").alias("raw_name"))
    return pages.building_mismatch(scans, known, "client_id").select("p_partkey", "mismatch", "found")


@query("""SELECT o_orderkey, sha256('manual:' || CAST(c_nationkey AS VARCHAR) || ':' || CAST(o_custkey AS VARCHAR) || ':' || o_orderpriority || ':' || regexp_replace(CAST(o_totalprice AS VARCHAR), '[.]0$', '') || ':1700000000000') AS document_hash,
 upper(o_orderpriority) AS number_norm, '30' || CAST(o_custkey AS VARCHAR) AS tax_id_norm, printf('%.2f', o_totalprice) AS amount_norm, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderdate AS DATE)::VARCHAR END AS due_norm
 FROM orders JOIN customer ON c_custkey = o_custkey""")
def q_manual_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Orders as invoices typed in by hand."""
    o = T.read(spark, d, "orders").join(T.consortiums(spark, d), F.col("consortium_id") == F.col("o_custkey"))
    rows = o.select(
        "o_orderkey", "client_id", "consortium_id", F.lower("o_orderpriority").alias("low"), F.col("o_orderpriority").alias("number"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("due"), F.concat(F.lit("30-"), F.col("o_custkey").cast("string")).alias("tax_id"),
    )
    out = pages.manual_invoices(rows, F.lit("1700000000000"))
    return out.select("o_orderkey", "document_hash", "number_norm", "tax_id_norm", "amount_norm", "due_norm")


@query(f"""WITH {_INV}, v AS (SELECT s_suppkey, s_name, s_nationkey, '30' || CAST(s_suppkey AS VARCHAR) AS cuit FROM supplier), a AS (SELECT c_custkey, c_nationkey, '30' || CAST(c_custkey % 100 AS VARCHAR) AS cuit FROM customer)
 SELECT c_custkey AS consortium_id, s_suppkey AS provider_id, s_name AS provider_name FROM a JOIN v ON a.cuit = v.cuit AND c_nationkey = s_nationkey WHERE EXISTS (SELECT 1 FROM inv WHERE consortium_id = c_custkey AND provider_id = s_suppkey)""")
def q_linked_vendors(spark: SparkSession, d: str) -> DataFrame:
    """Vendors by tax id among those that a building is linked with."""
    vendors = T.providers(spark, d).select(F.col("provider_client").alias("client_id"), "provider_id", "provider_name", F.concat(F.lit("30"), F.col("provider_id").cast("string")).alias("cuit"))
    asked = T.consortiums(spark, d).select("client_id", "consortium_id", F.concat(F.lit("30"), (F.col("consortium_id") % 100).cast("string")).alias("cuit"))
    return pages.linked_vendors(T.invoices(spark, d), vendors, asked).select("consortium_id", "provider_id", "provider_name")


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE lower(s_name) END AS name, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def q_join_update(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of a table updated from the rows of another that have its key."""
    target = T.read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    source = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lower("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return pages.updated(target, source, "c_custkey", ["name", "acctbal"])


_LINES = r"""array_to_string(list_filter(list_transform(string_split(replace(body, chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\t\n\x0B\f\r  ]+|[\t\n\x0B\f\r  ]+$', '', 'g')), lambda x: x <> '')[1:80], chr(10))"""


@query(f"""WITH {_BILL_SQL}, h AS (SELECT *, upper(substr(body, 1, {X.ROUTED_CHARS})) AS u FROM bill),
 b AS (SELECT *, CASE WHEN NOT {_sql_any((*X.UTILITY_WORDS, "AGUAS+ARGENTINAS"))} THEN 'invoice' {' '.join(f"WHEN {_sql_any(w)} THEN '{X.PROMPTS.get(n, 'utility')}'" for n, w in X.COMPANY_WORDS)} ELSE 'utility' END AS told FROM h)
 SELECT doc_id, sha256('Prompt ' || told || chr(10) || {_LINES}) AS prompt_hash FROM b""")
def q_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each bill: its company's template and its telling lines."""
    word = F.element_at(F.array(*(F.lit(w) for w in _WORDS)), (F.col("doc_id") % len(_WORDS)).cast("int") + 1)
    body = F.concat(F.coalesce("source", F.lit("")), F.lit(" "), word, F.lit("\n"), F.coalesce("text", F.lit("")))
    names = sorted({*X.PROMPTS.values(), "utility", "invoice"})
    templates = F.create_map(*(F.lit(v) for n in names for v in (n, f"Prompt {n}")))
    docs = T.read(spark, d, "documents").select("doc_id", body.alias("body"))
    return docs.select("doc_id", F.sha2(X.prompt(F.col("body"), templates).cast("binary"), 256).alias("prompt_hash"))
