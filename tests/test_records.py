import json

import pytest
from billforge.functions import shown as S
from billforge.functions import text as X
from billforge.operators import configs, directory, pages, queue, runs
from billforge.plans.registry import QUERIES
from billforge.sources import tables as T
from pyspark.sql import functions as F


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_summaries_of_both_shapes(spark):
    old = {"processed": "4", "failed": True, "skipped": None, "tokenUsage": {"totalTokens": 9, "byProvider": {"gemini": 9, "x": "9"}, "byModel": {"gpt-4o": 2.0}}}
    new = {"totalFound": 2, "errors": [{"fileId": "a"}, [], 3, None], "tokenUsage": {"byProvider": {"openai": {"inputTokens": 1, "outputTokens": 2, "totalTokens": "3"}}}}
    texts = [json.dumps(old), json.dumps(new), "[1]", "{broken", None, "{}"]
    got = runs.with_summary(spark.createDataFrame(list(enumerate(texts)), "id int, json string"), "json").orderBy("id").collect()
    assert [r["summary"] is None for r in got] == [False, False, True, True, True, False]
    first, second = got[0]["summary"], got[1]["summary"]
    assert (first["processed"], first["failed"], first["skipped"], first["total_tokens"]) == (4, 1, 0, 9)
    assert {k: tuple(v) for k, v in first["by_provider"].items()} == {"gemini": (0, 0, 9)}
    assert {k: tuple(v) for k, v in second["by_provider"].items()} == {"openai": (1, 2, 3)}
    assert [tuple(e) for e in second["errors"]] == [("a", "unknown", "Unknown error"), ("unknown", "unknown", "Unknown error")]
    usage = runs.usage_rows(runs.with_summary(spark.createDataFrame([(1, texts[0])], "id int, json string"), "json"), "summary")
    assert sorted(tuple(r)[1:] for r in usage.collect()) == sorted([("aggregate", "aggregate", None, 0, 0, 9), ("provider", "gemini", None, 0, 0, 9), ("model", "openai", "gpt-4o", 0, 0, 2)], key=str)


def test_counters_grow_by_the_log(spark):
    log = runs.with_summary(spark.createDataFrame([("a", 1, "MANUAL", None, '{"processed": 3}'), ("a", 2, "CRON", "x", None), ("b", 1, "CRON", None, "{}")], "c string, at int, trigger string, error string, json string"), "json")
    once = runs.counters(log, "c", "summary", F.col("at"))
    twice = runs.counters(log.where("c = 'a'"), "c", "summary", F.col("at"), stored=once)
    got = {r["c"]: (r["total_runs"], r["processed"], r["last_trigger"], r["last_error"]) for r in twice.collect()}
    assert got == {"a": (4, 6, "CRON", "x"), "b": (1, 0, "CRON", None)}


def test_tabs_services_and_replacement(spark):
    sheet = spark.createDataFrame([(1, " torre uno ", "edesur", " 0012 ", ""), (1, "nadie", "gas", "000", "d"), (1, "  ", "gas", "1", None), (1, "torre uno", None, "1", None)], "t int, a string, b string, c string, d string")
    tab = directory.read_tab(sheet, "_LspServices")
    assert rows(tab, "client_number") == [(1, "NADIE", "GAS", "000", "d"), (1, "TORRE UNO", "EDESUR", "0012", None)]
    b = spark.createDataFrame([(1, "TORRE UNO", 7)], "t int, consortium_name string, consortium_id int")
    v = spark.createDataFrame([(1, "Edesur", 3), (1, "EDESUR", 5)], "t int, provider_name string, provider_id int")
    got = directory.services(tab, b, v, "t").select("consortium_id", "provider_id", "client_number", "warning")
    assert rows(got, "client_number") == [(None, None, "000", 'LspService ignorado: consorcio "NADIE" no encontrado para proveedor GAS nro 000'), (7, 5, "12", None)]
    have = spark.createDataFrame([(1, "old"), (2, "kept")], "t int, n string")
    new = spark.createDataFrame([(1, "new")], "t int, n string")
    assert rows(directory.replaced(have, new, new, "t"), "t") == [(1, "new"), (2, "kept")]
    assert rows(directory.replaced(have, new.limit(0), new, "t"), "t") == [(2, "kept")]
    assert rows(directory.missing_tabs(spark.createDataFrame([("_Rubros",), ("x",)], "title string"), "title"), "title") == [("_Coeficientes",), ("_Consorcios",), ("_LspServices",), ("_Proveedores",)]


def test_import_names_the_rows_with_errors(spark):
    r = spark.createDataFrame([(1, 0, " A ", "1"), (1, 1, "", None), (1, 2, "A", None), (1, 3, "B", ""), (2, 4, "A", None), (1, 5, None, None)], "t int, i int, NOMBRE string, Cuit string")
    have = spark.createDataFrame([(1, "B")], "t int, name string")
    got = rows(directory.import_buildings(r, have, tenant="t", row="i").select("row_number", "name", "cuit", "outcome", "message"), "row_number")
    assert [g[3] for g in got] == ["imported", "error", "skipped", "skipped", "imported", "error"]
    assert got[1][4] == 'Fila 3: columna "Nombre" vacía — omitida' and got[3][2] is None


def test_configs(spark):
    m = spark.createDataFrame([('{"pending":" a ","scanned":"a"}',), ('{"pending":"."}',), (None,), ("{}",)], "j string")
    got = [r[0] for r in m.select(F.concat_ws(",", configs.folder_issues(F.col("j")))).collect()]
    assert got == ["same_folder", "pending_invalid,scanned_missing", "no_folders,pending_missing,scanned_missing", "pending_missing,scanned_missing"]
    patch = F.create_map(F.lit("b"), F.lit("2"), F.lit("pending"), F.lit(None).cast("string"))
    assert m.limit(1).select(configs.patched(configs.as_map(F.col("j")), patch)).first()[0] == {"scanned": "a", "b": "2"}


def test_queue(spark):
    j = spark.createDataFrame([(1, 5, "PENDING"), (2, 4, "PENDING"), (3, 1, "FAILED")], "id int, at int, status string")
    assert rows(queue.claimed(j, ["at", "id"]), "id") == [(2, 4, "PROCESSING")] and queue.claimed(j.where("id = 3"), ["at"]).count() == 0
    p = spark.createDataFrame([(1, 2024, 5, "ACTIVE"), (1, 2024, 6, "CLOSED"), (2, 2023, 12, "CLOSED"), (2, 2024, 1, "CLOSED")], "b int, year int, month int, status string")
    assert rows(queue.selected_period(p, "b"), "b") == [(1, 2024, 5, "ACTIVE"), (2, 2024, 1, "CLOSED")]
    assert tuple(spark.createDataFrame([(0,)], "n int").select(*queue.next_row(F.col("n"))).first()) == (2, "A2:M2")


def test_pages(spark):
    v = spark.createDataFrame([(3, 1, "30-12345678-9", "Gas S.A.", None), (2, 1, None, "Luz", "gas_s_a"), (4, 2, None, "Luz", None)], "match_id int, t int, cuit string, name string, payment_alias string")
    scans = [(1, 1, "x", "30123456789"), (2, 1, " GAS-S.A ", None), (3, 1, "luz", "123"), (4, 2, "gas s a", None), (5, 1, "lu", None)]
    found = pages.vendor_of_scan(spark.createDataFrame(scans, "doc_id int, t int, provider string, provider_tax_id string"), v, "t", T.settled)
    assert rows(found, "doc_id") == [(1, 3, 0), (2, 2, 1), (3, 2, 1)]
    scan = spark.createDataFrame([(1, "A 1", "B 2", " a 1 "), (1, "C 3", "B 2", " c 3 "), (1, "B 2", "B 2", "b"), (1, "", "B 2", "")], "t int, name string, selected string, raw string")
    got = pages.building_mismatch(scan, spark.createDataFrame([(1, "A 1", "Calle A 1")], "t int, name string, raw_name string"), "t").select("name", "mismatch", "found")
    assert rows(got, "name") == [("", False, None), ("A 1", True, "Calle A 1"), ("B 2", False, None), ("C 3", True, "c 3")]
    assert rows(pages.scoped(v, "t", {"role": "CLIENT", "client_id": 2}).select("match_id"), "match_id") == [(4,)] and pages.scoped(v, "t", {"role": "ADMIN"}).count() == 3
    with pytest.raises(PermissionError):
        pages.scoped(v, "t", {"role": "VIEWER", "client_id": 2}, change=True)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    assert rows(pages.updated(t, spark.createDataFrame([(2, None)], "k int, c string"), "k", ["c"]), "k") == [(1, "a"), (2, None)]


def test_shown_forms(spark):
    one = spark.createDataFrame([(1234.5, -0.4, None)], "a double, b double, c double")
    assert tuple(one.select(*(S.shown_amount(F.col(c)) for c in "abc")).first()) == ("$ 1.234,50", "-$ 0,40", "—")
    got = one.select(S.shown_date(F.lit("2024-03-05").cast("date")), S.shown_date(F.lit(None).cast("date")), S.input_date(F.lit("2024-03-05T10:00:00Z")), S.input_date(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("5/3/2024", "—", "2024-03-05", "")
    names = [one.select(X.prompt_name(F.lit(t))).first()[0] for t in ("web Edesur x", "Litoral Gas x", "telecom", "aguas de argentinas", "LSP 7", "Factura")]
    assert names == ["edesur", "gas", "personal", "utility", "utility", "invoice"]


@pytest.mark.parametrize("name", ["q_patch_violations", "q_client_configs"])
def test_configs_are_parsed_once(name, spark, sf_dir):
    import re

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"try_parse_json\(", plan)) == 1


def test_sheet_keys_are_shuffled_once(spark, sf_dir):
    plan = QUERIES["q_existing_keys"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Distinct") + plan.count("Deduplicate") == 1


def test_summaries_are_parsed_once(spark, sf_dir):
    import re

    plan = QUERIES["q_usage_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json", plan, re.IGNORECASE)) == 1
