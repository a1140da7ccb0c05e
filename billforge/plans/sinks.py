"""Registered queries of what is written or told to a page: sheets, tables replaced together, secrets, totals, quotas and configs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.functions import keys as K
from billforge.functions import secret
from billforge.operators import configs, pages, runs, sheets, usage
from billforge.plans.queries import _INV, query
from billforge.plans.records import _RUNS, _runs
from billforge.sources import snapshots
from billforge.sources import tables as T

# --- sheets ------------------------------------------------------------------------------------------------

_MAPPING = {"boletaNumber": "B", "consortium": "C", "amount": "E"}


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 7 AS t, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) AS n FROM orders),
 old AS (SELECT c_custkey % 5 AS t, c_custkey // 5 + 1 AS r, c_name FROM customer),
 e AS (SELECT t, max(r) AS last FROM old GROUP BY 1)
 SELECT CAST(t AS BIGINT) AS client_id, r AS row_number, '' AS a, CASE WHEN r = 1 AND t IN (2, 3) THEN 'NUMERO DE BOLETA' WHEN r = 1 THEN 'Nro' ELSE c_name END AS b, CASE WHEN r = 1 AND t IN (2, 3) THEN 'CONSORCIO' ELSE '' END AS c, '' AS d, CASE WHEN r = 1 AND t IN (2, 3) THEN 'MONTO' ELSE '' END AS e FROM old
 UNION ALL SELECT t, 1, '', 'NUMERO DE BOLETA', 'CONSORCIO', '', 'MONTO' FROM (VALUES (5), (6)) AS v(t)
 UNION ALL SELECT o.t, greatest(coalesce(last, 0), 1) + n, '', CAST(o_orderkey AS VARCHAR), 'c' || o_custkey, '', '$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') FROM o LEFT JOIN e ON e.t = o.t""")
def q_sheet_append(spark: SparkSession, d: str) -> DataFrame:
    """Orders written below the rows of seven sheets: three have a heading of their own, two a blank first row, two are empty."""
    t, r = (F.col("c_custkey") % 5).alias("client_id"), F.floor(F.col("c_custkey") / 5) + 1
    first = F.when((F.col("row_number") == 1) & F.col("client_id").isin(2, 3), " ").when(F.col("row_number") == 1, "Nro").otherwise(F.col("c_name"))
    old = T.read(spark, d, "customer").select(t, r.cast("long").alias("row_number"), "c_name")
    old = old.select("client_id", "row_number", F.lit("").alias("A"), first.alias("B"), *(F.lit("").alias(x) for x in "CDE"))
    new = T.read(spark, d, "orders").select((F.col("o_custkey") % 7).alias("client_id"), "o_orderkey", F.col("o_orderkey").alias("boletaNumber"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("consortium"), F.col("o_totalprice").alias("amount"))
    out = sheets.appended(T.settled(old), new, _MAPPING, T.settled, tenant="client_id", order=["o_orderkey"])
    return out.select("client_id", "row_number", *(F.col(x).alias(x.lower()) for x in "ABCDE"))


@query("""SELECT o_orderkey, 'B' || o_orderkey || ':E' || o_orderkey AS written FROM orders""")
def q_written_range(spark: SparkSession, d: str) -> DataFrame:
    """The range of a sheet that each row fills."""
    return T.read(spark, d, "orders").select("o_orderkey", sheets.written_range(_MAPPING, F.col("o_orderkey")).alias("written"))


# --- tables replaced together ------------------------------------------------------------------------------


def _store(spark: SparkSession, d: str) -> snapshots.Snapshots:
    """Orders as invoices and files, events as usage and jobs, nations' counters, in a store of their own."""
    o, client = T.read(spark, d, "orders"), (F.col("o_custkey") % 25).alias("client_id")
    tax = F.concat(F.when(F.col("o_custkey") % 2 == 0, "30-").otherwise("30"), (F.col("o_custkey") % 50).cast("string"))
    file = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey"))
    store = snapshots.Snapshots(spark, T.new_folder(spark))
    tables = {
        "invoices": o.select(client, F.col("o_orderkey").alias("invoice_id"), file.alias("file_id"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("vendor_id"), tax.alias("provider_tax_id")),
        "files": o.select(client, F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderstatus") == "P", "unassigned").when(F.col("o_orderstatus") == "F", "scanned").otherwise("failed").alias("route")),
        "jobs": o.where("o_orderkey % 4 = 0").select(client, F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 8 == 0, "PENDING").otherwise("COMPLETED").alias("status"), F.lit(1).alias("attempts"), F.col("o_orderdate").alias("created_at")),
        "usage": T.usage(spark, d).select(F.col("client_id").cast("long").alias("client_id"), "tokens"),
        "states": T.clients(spark, d).select(F.col("client_id").cast("long").alias("client_id"), F.length("client_name").alias("total_runs"), F.lit(7).cast("long").alias("total_tokens"), F.lit(True).alias("enabled")),
    }
    store.publish(tables)
    return store


_PURGED = "client_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"


@query(f"""WITH o AS (SELECT *, o_custkey % 25 AS client_id FROM orders), u AS (SELECT user_id % 25 AS client_id FROM events)
 SELECT 'invoices' AS name, CAST(client_id AS BIGINT) AS client_id, '' AS state, count(*) AS n FROM o WHERE NOT {_PURGED} GROUP BY ALL UNION ALL SELECT 'jobs', client_id, '', count(*) FROM o WHERE o_orderkey % 4 = 0 AND NOT {_PURGED} GROUP BY ALL
 UNION ALL SELECT 'usage', client_id, '', count(*) FROM u WHERE NOT {_PURGED} GROUP BY ALL
 UNION ALL SELECT 'states', client_id, CASE WHEN {_PURGED} THEN '0 0' ELSE length(n_name) || ' 7' END, 1 FROM (SELECT n_nationkey AS client_id, n_name FROM nation)
 UNION ALL SELECT 'files', client_id, CASE WHEN {_PURGED} AND o_orderkey % 9 > 0 AND o_orderstatus IN ('P', 'F') THEN 'pending' WHEN o_orderstatus = 'P' THEN 'unassigned' WHEN o_orderstatus = 'F' THEN 'scanned' ELSE 'failed' END AS s, count(*) FROM o GROUP BY ALL""")
def q_purge_tables(spark: SparkSession, d: str) -> DataFrame:
    """Five tables after what the tenants of one region have processed was purged, published together."""
    store = _store(spark, d)
    store.publish(snapshots.purge(store, T.read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("client_id"))))
    told = {"states": F.concat_ws(" ", "total_runs", "total_tokens"), "files": F.col("route")}
    out = None
    for name in ("invoices", "jobs", "usage", "states", "files"):
        part = store.read(name).groupBy(F.lit(name).alias("name"), "client_id", told.get(name, F.lit("")).alias("state")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("""WITH o AS (SELECT *, o_custkey % 25 AS client_id, CASE WHEN o_custkey % 2 = 0 THEN '30-' ELSE '30' END || o_custkey % 50 AS tax FROM orders),
 v AS (SELECT s_nationkey AS client_id, s_suppkey % 50 AS k FROM supplier WHERE s_suppkey % 3 = 0),
 h AS (SELECT o.*, o_orderstatus <> 'F' AND o_orderkey % 9 > 0 AND EXISTS (SELECT 1 FROM v WHERE v.client_id = o.client_id AND v.k = o_custkey % 50) AS hit FROM o)
 SELECT 'invoices' AS name, CAST(client_id AS BIGINT) AS client_id, o_orderkey AS id, CAST(NULL AS VARCHAR) AS status FROM h WHERE NOT hit UNION ALL SELECT 'jobs', client_id, o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'PENDING' ELSE 'COMPLETED' END FROM h WHERE o_orderkey % 4 = 0
 UNION ALL SELECT 'jobs', client_id, o_orderkey, 'PENDING' FROM h WHERE hit AND o_orderkey % 8 > 0""")
def q_requeue_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """Invoices and jobs after new vendors have explained some invoices without one: these go, and their files wait again."""
    store = _store(spark, d)
    s = F.col("s_suppkey") % 50
    vendors = T.read(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").cast("long").alias("client_id"), F.concat(F.lit("30-"), s.cast("string"), F.lit(" ")).alias("given"))
    vendors = vendors.select("client_id", F.trim("given").alias("tax_id"))
    store.publish(snapshots.requeued(store, vendors, F.lit("2024-05-01").cast("timestamp_ntz")))
    left = store.read("invoices").select(F.lit("invoices").alias("name"), "client_id", F.col("invoice_id").alias("id"), F.lit(None).cast("string").alias("status"))
    return left.union(store.read("jobs").select(F.lit("jobs"), "client_id", "file_id", "status"))


@query(f"""WITH {_INV} SELECT CASE WHEN l_linenumber = 1 THEN 'unassigned' ELSE 'scanned' END AS route, consortium_id, lpad(CAST(month AS VARCHAR), 2, '0') || '/' || year AS period, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM inv GROUP BY ALL""")
def q_folders(spark: SparkSession, d: str) -> DataFrame:
    """Invoices in folders by route and period, the batch of one route written twice."""
    inv = T.invoices(spark, d)
    rows = T.settled(inv.select(F.when(F.col("l_linenumber") == 1, "unassigned").otherwise("scanned").alias("route"), K.period_label(F.col("month"), F.col("year")).alias("period"), "consortium_id", "amount"))
    place = T.new_folder(spark)
    snapshots.foldered(rows, place, by=["route", "period"], files=1)
    snapshots.foldered(rows.where("route = 'scanned'"), place, by=["route", "period"], files=1)
    back = spark.read.schema(rows.schema).parquet(place)
    return back.groupBy("route", "consortium_id", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


# --- secrets, totals, quotas and configs -------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN c_name ELSE c_name || ' ñ€' END AS plain, c_custkey % 4 <> 0 AS hidden, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 4 + 16 + 1 + 24 + 1 + 4 * ((strlen(c_name) + CASE WHEN c_custkey % 4 > 1 THEN 6 ELSE 0 END + 2) // 3) END AS n_chars FROM customer""")
def q_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Names encrypted and decrypted again: what comes back, whether it was hidden, and how long the encrypted text is."""
    k, key = F.col("c_custkey"), F.lit("a secret of the tests")
    c = T.read(spark, d, "customer").select(k, F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" ñ€"))).alias("text"))
    sealed = T.settled(c.withColumn("sealed", secret.encrypted(F.col("text"), key)))
    again = secret.encrypted(F.col("sealed"), key)
    return sealed.select("c_custkey", secret.decrypted(again, key).alias("plain"), ((F.col("sealed") != F.col("text")) & F.col("sealed").startswith(secret.MARK)).alias("hidden"), F.length("sealed").cast("long").alias("n_chars"))


@query(f"""WITH {_INV} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line_number, CAST(inv.amount AS DOUBLE) AS amount, (SELECT count(*) FROM inv WHERE year >= 1996) AS total FROM inv WHERE year >= 1996
 ORDER BY inv.amount DESC, l_orderkey, l_linenumber, l_partkey, provider_id LIMIT 100 OFFSET 200""")
def q_page_total(spark: SparkSession, d: str) -> DataFrame:
    """The third page of the dearest invoices, of as many as a page may have, and how many there are in all."""
    order = [F.desc("amount"), "l_orderkey", "l_linenumber", "l_partkey", "provider_id"]
    page, total = pages.page_with_total(T.invoices(spark, d).where("year >= 1996"), order, T.settled, page=3, size=5000)
    return page.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_number"), F.col("amount").cast("double").alias("amount"), F.lit(total).cast("long").alias("total"))


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal DESC, c_custkey, o_orderkey LIMIT 40""")
def q_by_related(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the order of a column of their customers."""
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return pages.ordered_by(T.read(spark, d, "orders"), c, "o_custkey", [F.desc("c_acctbal"), "o_custkey", "o_orderkey"]).limit(40).select("o_orderkey", "c_name")


@query(f"""WITH {_RUNS}, l AS (SELECT * FROM s WHERE has QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
 SELECT count(*) AS n_summaries, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(sum(CASE WHEN n = 1 THEN 3 ELSE 0 END) AS BIGINT) AS n_listed,
  coalesce(string_agg(CASE WHEN n = 1 THEN 'f1/unknown/x;unknown/unknown/Unknown error;unknown/unknown/Unknown error' END, ';' ORDER BY user_id), '') AS errors,
  CAST(sum(t) FILTER (WHERE n = 0) AS BIGINT) AS gemini_total, CAST(sum(t) FILTER (WHERE n = 1) AS BIGINT) AS openai_input, CAST(sum(k) FILTER (WHERE n = 1) AS BIGINT) AS openai_output, CAST(sum(t + k) FILTER (WHERE n = 1) AS BIGINT) AS openai_total,
  CAST(sum(t) FILTER (WHERE n = 0) AS BIGINT) AS gpt_total, CAST(sum(t) FILTER (WHERE n = 1) AS BIGINT) AS gemini2_total, CAST(sum(k) FILTER (WHERE n = 1) AS BIGINT) AS o1_output FROM l""")
def q_folded_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The last summaries of all users as one, its maps and its list of errors included."""
    last = _runs(spark, d).where("summary is not null").groupBy("user_id").agg(F.max_by("summary", F.struct("ts", "event_id")).alias("summary"))
    out = runs.folded(T.settled(last), "summary", ["user_id"])
    told = F.array_join(F.transform("errors", lambda e: F.concat_ws("/", e["file_id"], e["file_name"], e["error"])), ";")
    cells = {"gemini_total": ("by_provider", "gemini", "total_tokens"), "openai_input": ("by_provider", "openai", "input_tokens"), "openai_output": ("by_provider", "openai", "output_tokens"), "openai_total": ("by_provider", "openai", "total_tokens"),
             "gpt_total": ("by_model", "gpt-4o", "total_tokens"), "gemini2_total": ("by_model", "gemini-2", "total_tokens"), "o1_output": ("by_model", "o1", "output_tokens")}
    return out.select("n_summaries", "total_tokens", F.size("errors").cast("long").alias("n_listed"), told.alias("errors"), *(F.try_element_at(F.col(m), F.lit(k))[t].alias(n) for n, (m, k, t) in cells.items()))


@query("""WITH e AS (SELECT event_id, user_id % 25 AS client_id, ts, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
 r AS (SELECT *, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 5 = 0 THEN 'Gemini: 429 Too Many Requests' WHEN k % 5 = 1 THEN 'OpenAI insufficient_quota ' || repeat('x', 300) WHEN k % 5 = 2 THEN 'generativelanguage quota' ELSE 'gemini timeout' END AS err, event_type <> 'error' AS has FROM e),
 p AS (SELECT client_id, ts, event_id, 'gemini' AS vendor, CASE WHEN has AND k % 5 IN (0, 2) OR NOT has AND k % 5 = 0 THEN 'limited' WHEN has AND k % 3 = 0 THEN 'ok' END AS status, err FROM r
  UNION ALL SELECT client_id, ts, event_id, 'openai', CASE WHEN k % 5 = 1 THEN 'limited' WHEN has AND k % 2 = 0 THEN 'ok' END, err FROM r)
 SELECT CAST(client_id AS BIGINT) AS client_id, vendor, status, CASE WHEN status = 'ok' THEN 'Consumo detectado en la ultima ejecucion.' WHEN length(err) > 300 THEN err[1:300] || '...' ELSE err END AS note FROM p WHERE status IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY client_id, vendor ORDER BY ts DESC, event_id DESC) = 1""")
def q_quota_by_vendor(spark: SparkSession, d: str) -> DataFrame:
    """The quota of each vendor for each tenant, after its runs' usage and errors."""
    e = T.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    n = F.col("k") % 5
    err = F.when(n == 4, None).when(n == 0, "Gemini: 429 Too Many Requests").when(n == 1, F.concat(F.lit("OpenAI insufficient_quota "), F.repeat(F.lit("x"), F.lit(300)))).when(n == 2, "generativelanguage quota").otherwise("gemini timeout")
    e = e.withColumn("error", err)
    used = {"gemini": F.when(F.col("k") % 3 == 0, 5).otherwise(0), "openai": F.when(F.col("k") % 2 == 0, 5).otherwise(0)}
    by = F.struct(*(F.struct(c.alias("totalTokens")).alias(v) for v, c in used.items()))
    errors = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("rate limit of no vendor").alias("error")), F.struct(F.col("error").alias("error"))))
    json = F.when(F.col("event_type") != "error", F.to_json(F.struct(F.struct(by.alias("byProvider")).alias("tokenUsage"), errors.alias("errors"))))
    log = runs.with_summary(e.select((F.col("user_id") % 25).alias("client_id"), "event_id", "ts", F.when(F.col("event_type") == "error", F.col("error")).alias("error"), json.alias("json")), "json")
    return runs.quota_states(log, "client_id", "summary", "error", ["ts", "event_id"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'body' ELSE concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'altaSheetsId' END, CASE WHEN o_orderkey % 700 NOT BETWEEN 1 AND 500 OR o_orderkey % 4 = 1 THEN 'batchSize' END, CASE WHEN o_orderkey % 11 = 0 THEN 'driveFolderPending' END,
  CASE WHEN o_orderkey % 5 < 3 THEN 'googleClientEmail' END, CASE WHEN o_custkey NOT BETWEEN 1 AND 1440 THEN 'intervalMinutes' END, CASE WHEN o_orderkey % 6 = 0 THEN 'isActive' END, CASE WHEN o_orderkey % 13 < 2 THEN 'name' END) END AS invalid FROM orders""")
def q_patch_violations(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each patch, as JSON, that are of a wrong kind or out of range."""
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    mails = F.element_at(F.array(*map(F.lit, ("a b@x.org", ".a@x.org", "a@x", "Ana.Paz+1@mail.example.org", "x@a-b.io"))), (o % 5).cast("int") + 1)
    size = (o % 700).cast("string")
    body = F.concat(
        F.lit('{"intervalMinutes":'), c, F.lit(',"batchSize":'), F.when(o % 4 == 0, F.concat(size, F.lit(".0"))).when(o % 4 == 1, F.concat(size, F.lit(".5"))).otherwise(size), F.lit(',"googleClientEmail":"'), mails, F.lit('","altaSheetsId":'),
        F.when(o % 3 == 0, '"short"').when(o % 3 == 1, "null").otherwise('"0123456789"'), F.lit(',"isActive":'), F.when(o % 6 == 0, '"true"').otherwise("true"), F.when(o % 11 == 0, ',"driveFolderPending":null').otherwise(""),
        F.lit(',"name":'), F.when(o % 13 == 0, '"x"').when(o % 13 == 1, "7").otherwise('"xy"'), F.lit(',"other":[1]}'),
    )
    body = F.when(o % 50 == 0, F.when(o % 100 == 0, "[1]").otherwise("{broken")).otherwise(body)
    return T.spread(T.read(spark, d, "orders")).select("o_orderkey", F.concat_ws(",", configs.violations(body)).alias("invalid"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Missing required client config: driveFoldersJson.pending' WHEN c_custkey % 5 = 0 THEN 'Missing required client config: driveFoldersJson.scanned' WHEN c_custkey % 3 = 0 THEN 'Invalid client config: pending and scanned folders must be different'
 WHEN c_custkey % 11 = 0 THEN 'Missing required client config: sheetName' WHEN c_custkey % 2 = 0 THEN 'Missing required client config: google credentials (projectId/clientEmail/privateKey/sheetsId)' END AS error FROM customer""")
def q_config_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first thing that keeps each tenant's config from being used."""
    k = F.col("c_custkey")
    folders = F.to_json(F.struct(F.when(k % 7 == 0, " ").otherwise("f1").alias("pending"), F.when(k % 5 != 0, F.when(k % 3 == 0, "f1 ").otherwise("f2")).alias("scanned")))
    google = F.when(k % 4 != 0, F.to_json(F.struct(F.lit("p").alias("projectId"), F.lit("e").alias("clientEmail"), F.lit("k").alias("privateKey"), F.when(k % 2 == 1, "s").alias("sheetsId"))))
    return T.read(spark, d, "customer").select("c_custkey", configs.config_error(folders, google, F.when(k % 11 == 0, " ").otherwise("Sheet1")).alias("error"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 <> 1 AS project, c_custkey % 7 <> 2 AS sheet, c_custkey % 3 AS ai FROM customer)
 SELECT k AS c_custkey, CASE WHEN project AND sheet THEN 'p' || k || '/secret ' || k || '/s' END AS google, CASE ai WHEN 1 THEN 'key ' || k || '//' WHEN 2 THEN '//gpt' END AS ai, CASE WHEN k % 4 = 0 THEN 'M/A' END AS mapping FROM c""")
def q_client_configs(spark: SparkSession, d: str) -> DataFrame:
    """Credentials, extractors' settings and column mappings read from each tenant's JSON, keys decrypted."""
    k, key = F.col("c_custkey"), F.lit("another secret of the tests")
    n = k.cast("string")
    google = F.struct(F.when(k % 5 != 1, F.concat(F.lit(" p"), n)).alias("projectId"), F.lit("e@x.org").alias("clientEmail"), secret.encrypted(F.concat(F.lit("secret "), n), key).alias("privateKey"), F.when(k % 7 != 2, "s").otherwise(" ").alias("sheetsId"))
    columns = F.struct(*((F.when(k % 4 == 0, "A") if f == "period" else F.lit("M" if f == "amount" else "B")).alias(f) for f in configs.MAPPED_FIELDS))
    extraction = F.struct(F.when(k % 3 == 1, secret.encrypted(F.concat(F.lit("key "), n), key)).alias("geminiApiKey"), F.when(k % 3 == 2, " gpt ").alias("openaiModel"), columns.alias("columnMapping"))
    c = T.settled(T.spread(T.read(spark, d, "customer")).select(k, F.to_json(google).alias("g"), F.to_json(extraction).alias("x")))
    g, a, m = configs.google_config(F.col("g"), key), configs.ai_config(F.col("x"), key), configs.mapping_config(F.col("x"))
    c = c.select("c_custkey", g.alias("g"), a.alias("a"), m.alias("m"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    return c.select(
        "c_custkey", F.when(F.col("g").isNotNull(), F.concat_ws("/", "g.projectId", "g.privateKey", "g.sheetsId")).alias("google"),
        F.when(F.col("a").isNotNull(), F.concat_ws("/", blank(F.col("a.geminiApiKey")), blank(F.col("a.geminiModel")), blank(F.col("a.openaiModel")))).alias("ai"), F.when(F.col("m").isNotNull(), F.concat_ws("/", F.col("m")["amount"], F.col("m")["period"])).alias("mapping"),
    )


@query(f"""WITH {_RUNS}, u AS (SELECT * FROM s WHERE has AND user_id % 4 > 0)
 SELECT 'provider' AS grain, 'gemini' AS name, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, CAST(coalesce(sum(t), 0) AS BIGINT) AS total_tokens FROM u WHERE n = 0 UNION ALL SELECT 'provider', 'openai', CAST(coalesce(sum(t), 0) AS BIGINT), CAST(coalesce(sum(k), 0) AS BIGINT), CAST(coalesce(sum(t + k), 0) AS BIGINT) FROM u WHERE n = 1
 UNION ALL SELECT 'model', 'gpt-4o', 0, 0, CAST(coalesce(sum(t), 0) AS BIGINT) FROM u WHERE n = 0 UNION ALL SELECT 'model', 'gemini-2', 0, 0, CAST(coalesce(sum(t), 0) AS BIGINT) FROM u WHERE n = 1 UNION ALL SELECT 'model', 'o1', 0, CAST(coalesce(sum(k), 0) AS BIGINT), 0 FROM u WHERE n = 1""")
def q_stored_usage(spark: SparkSession, d: str) -> DataFrame:
    """The stored usage of three quarters of the tenants, by vendor and by model, without the rows that hold all of it."""
    rows = runs.usage_rows(_runs(spark, d).select(F.col("user_id").alias("client_id"), "event_id", "summary"), "summary")
    asked = T.read(spark, d, "events").where("user_id % 4 > 0").select(F.col("user_id").alias("client_id"))
    return usage.stored_totals(rows, asked)


@query(f"""WITH {_INV} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey, CASE WHEN l_linenumber = 2 THEN 'Sin Consorcio' ELSE 'Customer ' || consortium_id END || '/' || CASE WHEN l_linenumber = 3 THEN 'Sin Período' ELSE
 list_extract(['ENERO', 'FEBRERO', 'MARZO', 'ABRIL', 'MAYO', 'JUNIO', 'JULIO', 'AGOSTO', 'SEPTIEMBRE', 'OCTUBRE', 'NOVIEMBRE', 'DICIEMBRE'], month) || ' ' || year END AS folder FROM inv""")
def q_receipt_folders(spark: SparkSession, d: str) -> DataFrame:
    """The folder of each invoice's receipt."""
    inv = T.invoices(spark, d)
    building = F.when(F.col("l_linenumber") != 2, F.concat(F.lit("Customer "), F.col("consortium_id").cast("string")))
    return inv.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line_number"), "l_partkey", K.receipts_folder(building, F.when(F.col("l_linenumber") != 3, F.col("month")), F.col("year")).alias("folder"))
