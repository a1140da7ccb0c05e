"""Order-dependent rules against plain loops, stores, secrets, sheets and the stream's gate."""

import base64
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from billforge.functions import keys as K
from billforge.functions import secret
from billforge.operators import configs, directory, edits, pages, runs, sheets
from billforge.operators.carry import last_before
from billforge.operators.numbering import numbered
from billforge.sources import extractors, snapshots
from billforge.sources import tables as T
from billforge.streaming import scheduler


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=repr) if not by else [tuple(r) for r in df.orderBy(*by).collect()]


# --- imports of vendors --------------------------------------------------------------------------------------


def vendors_by_hand(sheet, have):
    state, out = {t: [v for v in have if v[0] == t] for t in {s[0] for s in sheet}}, {}
    for t, at, name, cuit in sorted(sheet, key=lambda s: s[1]):
        name, cuit = (name or "").strip() or None, (cuit or "").strip() or None
        digits = "".join(c for c in cuit or "" if c in "0123456789")
        if name is None:
            out[t, at + 2] = "error"
        elif any(v[1] == name or (len(digits) >= 10 and v[2] and digits in v[2]) for v in state[t]):
            out[t, at + 2] = "skipped"
        else:
            out[t, at + 2] = "imported"
            state[t].append((t, name, cuit))
    return out


def test_vendors_of_an_import_equal_a_loop(spark):
    r = random.Random(3)
    ids = ["30111111111", "30-11111111-1", "x 30111111111 / 30222222222", "30222222222", "0111111111", "123456789", None, " "]
    sheet = [(r.choice([1, 1, 2]), i, r.choice(["A", "B", "C", "D", "E", " ", None, f"n{i}"]), r.choice(ids)) for i in range(160)]
    # chains of three: the second is skipped for the first, so the third, which only the second forbids, comes in
    sheet += [(3, 0, "P", "30777777777"), (3, 1, "P", "30888888888"), (3, 2, "Q", "30888888888"), (3, 3, "R", "30888888888"), (3, 4, "R", "30999999999"), (3, 5, "S", "30999999999"), (3, 6, "S", None)]
    have = [(1, "A", "30555555555"), (2, "Z", None), (3, "T", "30-77777777-7")]
    df = spark.createDataFrame([(t, i, n, c, "x") for t, i, n, c in sheet], "t int, i long, `Razon Social` string, CUIT string, outcome string")
    out = directory.import_vendors(df, spark.createDataFrame(have, "t int, name string, cuit string"), T.settled, tenant="t", row="i")
    got = {(x["t"], x["row_number"]): x["outcome"] for x in out.collect()}
    assert got == vendors_by_hand(sheet, have)
    assert [got[3, i] for i in range(2, 9)] == ["imported", "skipped", "imported", "skipped", "imported", "skipped", "imported"]
    assert {x["message"] for x in out.where("outcome = 'error' and row_number = 9").collect()} <= {'Fila 9: columna "Nombre" vacía — omitida'}
    assert directory.import_vendors(df.limit(0), spark.createDataFrame([], "t int, name string, cuit string"), T.settled, tenant="t", row="i").count() == 0


# --- edits -----------------------------------------------------------------------------------------------------


def edits_by_hand(log):
    live, reasons = {}, {}
    for t, seq, id_, op, key, v in sorted(log, key=lambda x: x[1]):
        own = live.setdefault(t, {})
        why = None
        if op in ("patch", "delete") and id_ not in own:
            why = "not found"
        elif op == "create" and id_ in own:
            why = "exists"
        elif op != "delete" and key is not None and any(k == key for i, (k, _) in own.items() if i != id_):
            why = "duplicate"
        reasons[t, seq] = why
        if why:
            continue
        if op == "delete":
            del own[id_]
        elif op == "patch":
            own[id_] = (key if key is not None else own[id_][0], v if v is not None else own[id_][1])
        else:
            own[id_] = (key, v)
    return reasons, {(t, i, k, v) for t, own in live.items() for i, (k, v) in own.items()}


@pytest.mark.parametrize("seed, chunk", [(1, 65536), (2, 7)])
def test_edits_equal_a_loop(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(edits, "_CHUNK", chunk)
    r = random.Random(seed)
    log = [(r.choice([1, 1, 2]), i, r.randint(1, 12), r.choice(["create", "create", "save", "patch", "patch", "delete"]), r.choice(["a", "b", "c", "d", "e", None]), r.choice(["x", "y", None])) for i in range(250)]
    # a third of all edits save one row
    log += [(2, 1000 + i, 99, "save", "hot", str(i)) for i in range(120)] + [(2, 1060, 5, "save", "hot", "q")]
    log = [x if x[1] != 1060 or x[2] == 5 else (2, 2000, 99, "save", "hot", "z") for x in log]
    got = T.settled(edits.replay(spark.createDataFrame(log, "tenant int, seq long, id long, op string, key string, v string"), T.settled))
    reasons, live = edits_by_hand(log)
    assert {(x["tenant"], x["seq"]): x["reason"] for x in got.collect()} == reasons
    assert {"not found", "exists", "duplicate", None} == set(reasons.values())
    # a save gives all values, so nulls in it overwrite; patches keep: the snapshot reads nulls as not given
    want = {(t, i) for t, i, _, _ in live}
    assert {(x["tenant"], x["id"]) for x in edits.snapshot(got, ["v"]).collect()} == want


def test_refusals_that_hang_on_one_another_take_few_rounds(spark):
    # each of forty ids asks for the key of the one before it, which keeps it as it is refused itself
    log = [(1, i, i, "save", f"k{i}") for i in range(41)] + [(1, 100 + i, i, "save", f"k{i - 1}") for i in range(1, 41)]
    tables = []

    def settle(df):
        tables.append(df)
        return T.settled(df)

    got = edits.replay(spark.createDataFrame(log, "tenant int, seq long, id long, op string, key string"), settle)
    assert {x["seq"] for x in got.where("reason = 'duplicate'").collect()} == {100 + i for i in range(1, 41)}
    assert len(tables) <= 12


def test_a_key_held_from_the_first_stretch_on_reaches_the_last_at_once(spark, monkeypatch):
    monkeypatch.setattr(edits, "_CHUNK", 4)
    log = [(1, 0, 0, "save", "a")] + [(1, i, i, "create", "a" if i % 2 else f"b{i % 8}") for i in range(1, 64)] + [(1, 64, 0, "delete", None), (1, 65, 65, "save", "a")]
    tables = []

    def settle(df):
        tables.append(df)
        return T.settled(df)

    got = edits.replay(spark.createDataFrame(log, "tenant int, seq long, id long, op string, key string"), settle)
    reasons, _ = edits_by_hand([(*x, None) for x in log])
    assert {(x["tenant"], x["seq"]): x["reason"] for x in got.collect()} == reasons
    assert len(tables) <= 12


def test_last_value_before_a_row(spark):
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), r.choice([*range(40), None]), i, r.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t int, i int, v int")
    got = {x["i"]: x["p"] for x in last_before(df, ["k"], ["t", "i"], F.col("v"), bucket=F.floor(F.col("t") / 7), name="p").collect()}
    for k in ("a", "b", None):
        last = None
        for _, t, i, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
            assert got[i] == last
            last = v if v is not None else last


def test_places_in_a_group_of_any_size(spark):
    df = spark.createDataFrame([("a" if i % 10 else None, i // 3, i) for i in range(1000)], "`g.x` string, o int, i int")
    got = numbered(df, "g.x", ["o"], T.settled, place="n").collect()
    for g in ("a", None):
        own = sorted((x["n"], x["o"]) for x in got if x["g.x"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)
    plan = numbered(df, "g.x", ["o"], T.settled)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


# --- sheets, stores and folders --------------------------------------------------------------------------------


def test_rows_go_below_a_heading(spark):
    sheet = spark.createDataFrame([(1, 1, "", "Mine"), (1, 2, "", "x"), (1, 9, "", "y"), (2, 1, "", " "), (2, 2, "", "z"), (4, 1, "", "keep")], "t int, row_number long, A string, B string")
    new = spark.createDataFrame([(t, n, 1.5) for t, n in ((1, "b"), (1, "a"), (2, "c"), (3, "e"), (3, "d"), (3, "d"))], "t int, provider string, amount double")
    mapping = {"provider": "B", "amount": "C"}
    out = sheets.appended(sheet.withColumn("C", F.lit("")), new, mapping, T.settled, tenant="t", order=["provider"])
    assert [x[:2] + x[3:] for x in rows(out, "t", "row_number")] == [
        (1, 1, "Mine", ""), (1, 2, "x", ""), (1, 9, "y", ""), (1, 10, "a", "$ 1,50"), (1, 11, "b", "$ 1,50"), (2, 1, "PROVEEDOR", "MONTO"), (2, 2, "z", ""), (2, 3, "c", "$ 1,50"),
        (3, 1, "PROVEEDOR", "MONTO"), (3, 2, "d", "$ 1,50"), (3, 3, "d", "$ 1,50"), (3, 4, "e", "$ 1,50"), (4, 1, "keep", ""),
    ]
    left = sheets.cleared(out, spark.createDataFrame([(1,), (3,)], "t int"), "t")
    assert [x[:2] for x in rows(left, "t", "row_number")] == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (4, 1)]
    assert sheets.used_columns({"a": "D", "b": "AB", "c": "F"}) == ("D", "AB") and sheets.header_row({"amount": "C", "alias": "A"}) == {"A": "ALIAS", "B": "", "C": "MONTO"}


def test_a_failed_write_leaves_the_old_tables(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None
    store.publish({"a": spark.range(3), "b": spark.range(5)})
    broken = spark.range(4).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.publish({"a": spark.range(9), "b": broken})
    assert (store.read("a").count(), store.read("b").count()) == (3, 5)
    store.publish({"b": store.read("b").where("id < 2")})  # reads what it replaces
    assert (store.read("a").count(), store.read("b").count()) == (3, 2)
    store.forget_old()
    assert store.read("b").count() == 2 and len([n for n in os.listdir(tmp_path / "s") if not n.startswith(".")]) == 2


def test_folders_are_replaced_one_by_one(spark, tmp_path):
    place = str(tmp_path / "f")
    df = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 3, None)], "route string, n int, b string")
    snapshots.foldered(df, place, by=["route", "b"])
    snapshots.foldered(df.where("route = 'y'"), place, by=["route", "b"])
    assert rows(spark.read.schema(df.schema).parquet(place).select("route", "n", "b")) == rows(df)
    snapshots.foldered(spark.createDataFrame([("x", 7, "a")], df.schema), place, by=["route", "b"])
    assert sorted(x["n"] for x in spark.read.schema(df.schema).parquet(place).collect()) == [2, 3, 7]


def test_purge_and_requeue(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    store.publish({
        "invoices": spark.createDataFrame([(1, 10, 5, None, "30-1"), (1, 11, None, None, "30-1"), (1, 12, 6, 3, "301"), (1, 13, 7, None, "301"), (2, 14, 5, None, "301")], "client_id int, invoice_id int, file_id int, vendor_id int, provider_tax_id string"),
        "jobs": spark.createDataFrame([(1, 5, "PROCESSING", 2), (1, 7, "FAILED", 3), (2, 9, "PENDING", 0)], "client_id int, file_id int, status string, attempts int"),
        "usage": spark.createDataFrame([(1, 4), (2, 5)], "client_id int, tokens int"),
        "states": spark.createDataFrame([(1, 4, True), (2, 5, False)], "client_id int, total_runs int, enabled boolean"),
        "files": spark.createDataFrame([(1, 5, "scanned"), (1, 6, "failed"), (1, 8, "scanned"), (2, 5, "scanned")], "client_id int, file_id int, route string"),
    })
    again = snapshots.requeued(store, spark.createDataFrame([(1, "30-1")], "client_id int, tax_id string"), F.lit(None).cast("timestamp"))
    assert rows(again["invoices"].select("invoice_id")) == [(11,), (12,), (14,)]
    assert rows(again["jobs"].select("client_id", "file_id", "status", "attempts")) == [(1, 5, "PROCESSING", 2), (1, 7, "FAILED", 3), (1, 7, "PENDING", 0), (2, 9, "PENDING", 0)]
    store.publish(snapshots.purge(store, spark.createDataFrame([(1,)], "client_id int")))
    assert [store.read(n).count() for n in ("invoices", "jobs", "usage")] == [1, 1, 1]
    assert rows(store.read("states")) == [(1, 0, True), (2, 5, False)]
    assert rows(store.read("files")) == [(1, 5, "pending"), (1, 6, "failed"), (1, 8, "scanned"), (2, 5, "scanned")]


# --- secrets, pages, runs, configs -------------------------------------------------------------------------------


def test_secrets(spark):
    key = F.lit("s3cret")
    df = spark.createDataFrame([("plain",), ("ñ€" * 40,), ("",), (None,), ("enc:",)], "t string")
    sealed = T.settled(df.withColumn("e", secret.encrypted(F.col("t"), key)))
    told = {x["t"]: x["e"] for x in sealed.collect()}
    assert told[""] == "" and told[None] is None and told["enc:"] == "enc:"
    iv, tag, data = (base64.b64decode(p) for p in told["plain"].removeprefix("enc:").split("."))
    assert (len(iv), len(tag), len(data)) == (12, 16, 5)
    back = {x["t"]: x["d"] for x in sealed.where("t <> 'enc:'").withColumn("d", secret.decrypted(F.col("e"), key)).collect()}
    assert all(k == v for k, v in back.items())
    # the layout of another writer, put together from its parts
    raw = spark.range(1).select(F.aes_encrypt(F.lit("abc").cast("binary"), F.unhex(F.sha2(F.lit("s3cret").cast("binary"), 256)), F.lit("GCM"))).first()[0]
    foreign = "enc:" + ".".join(base64.b64encode(x).decode() for x in (raw[:12], raw[-16:], raw[12:-16]))
    assert spark.createDataFrame([(foreign,)], "e string").select(secret.decrypted(F.col("e"), key)).first()[0] == "abc"
    for bad, k in ((foreign, F.lit("other")), ("enc:abc", key), (foreign[:-4] + "AAAA", key), (foreign, F.lit(" "))):
        with pytest.raises(Exception, match="valid|needed|invalid|AES"):
            spark.createDataFrame([(bad,)], "e string").select(secret.decrypted(F.col("e"), k)).collect()


def test_a_page_with_its_total(spark):
    df = T.settled(spark.range(250).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1000))))
    ordered, plans = [x["id"] for x in sorted(df.collect(), key=lambda x: (x["k"], x["id"]))], []

    def settle(out):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return T.settled(out)

    for page, size, shown in ((1, 50, ordered[:50]), (0, 500, ordered[:100]), (3, 100, ordered[200:]), (9, 100, []), (2, -4, ordered[1:2])):
        out, total = pages.page_with_total(df, ["k", "id"], settle, page=page, size=size)
        assert [x["id"] for x in out.collect()] == shown and total == 250
    assert all(p.count("FileScan") == 1 and "TakeOrderedAndProject" in p for p in plans)


def summary(tokens, errors):
    return json.dumps({"tokenUsage": {"byProvider": {k: {"totalTokens": v} for k, v in tokens.items()}}, "errors": [{"error": e} for e in errors]})


def test_quota_by_vendor(spark):
    log = [
        (1, 1, summary({"gemini": 5, "openai": 0}, []), None), (1, 2, summary({}, ["timeout"]), None), (1, 3, summary({"openai": 2}, ["OPENAI 429", "openai quota " + "x" * 400, "gemini down"]), None),
        (2, 1, None, "GEMINI rate limit"), (2, 2, None, "generativelanguage quota"), (3, 1, summary({"gemini": 1}, ["generativelanguage: limit: 0"]), "openai quota"), (4, 1, None, None),
    ]
    df = runs.with_summary(spark.createDataFrame(log, "c int, at int, json string, error string"), "json")
    got = {(x["c"], x["vendor"]): (x["status"], x["note"]) for x in runs.quota_states(df, "c", "summary", "error", ["at"]).collect()}
    assert got == {(1, "gemini"): ("ok", runs.USED), (1, "openai"): ("limited", ("openai quota " + "x" * 400)[:300] + "..."), (2, "gemini"): ("limited", "GEMINI rate limit"), (3, "gemini"): ("limited", "generativelanguage: limit: 0")}


def test_summaries_as_one(spark):
    a = json.dumps({"processed": 1, "errors": [{"fileId": "f", "fileName": "n", "error": "e1"}], "tokenUsage": {"totalTokens": 5, "byProvider": {"gemini": 5}, "byModel": {"m": {"inputTokens": 2, "totalTokens": 3}}}})
    b = json.dumps({"processed": 2, "errors": [{"error": "e0"}], "tokenUsage": {"totalTokens": 1, "byProvider": {"gemini": {"inputTokens": 1, "totalTokens": 1}, "openai": 2}}})
    df = runs.with_summary(spark.createDataFrame([(2, a), (1, b), (3, None)], "k int, json string"), "json")
    x = runs.folded(df, "summary", ["k"]).first()
    assert (x["n_summaries"], x["processed"], x["total_tokens"], [e["error"] for e in x["errors"]]) == (2, 3, 6, ["e0", "e1"])
    assert {k: tuple(v) for k, v in x["by_provider"].items()} == {"gemini": (1, 0, 6), "openai": (0, 0, 2)} and {k: tuple(v) for k, v in x["by_model"].items()} == {"m": (2, 0, 3)}
    empty = runs.folded(df.where("k > 5"), "summary", ["k"]).first()
    assert (empty["n_summaries"], empty["errors"], empty["by_provider"]) == (0, [], {})


@pytest.mark.parametrize("body, broken", [
    ("{}", ""), ("[1]", "body"), ("{x", "body"), ('{"name":"x"}', "name"), ('{"name":null}', "name"), ('{"batchSize":1.0,"intervalMinutes":1440}', ""), ('{"batchSize":"5","intervalMinutes":0}', "batchSize,intervalMinutes"),
    ('{"batchSize":501}', "batchSize"), ('{"isActive":1,"consortiumsEnabled":false}', "isActive"), ('{"geminiApiKey":null,"openaiApiKey":"short"}', "openaiApiKey"), ('{"googleClientEmail":"a.b@c-d.org"}', ""),
    ('{"googleClientEmail":"a..b@c.org"}', "googleClientEmail"), ('{"driveFolderFailed":"","driveFolderPending":"1234"}', "driveFolderPending"), ('{"unknown":[{}]}', ""), ('{"sheetName":""}', "sheetName"),
])
def test_patches(spark, body, broken):
    assert spark.createDataFrame([(body,)], "b string").select(F.concat_ws(",", configs.violations(F.col("b")))).first()[0] == broken


def test_config_errors_and_defaults(spark):
    google = json.dumps({k: "x" for k in configs.GOOGLE_FIELDS})
    data = [(1, '{"pending":"a","scanned":"b"}', google, "S"), (2, None, google, "S"), (3, '{"pending":"a","scanned":"b"}', None, "S"), (4, '{"pending":"a","scanned":"p"}', google, "S")]
    df = spark.createDataFrame(data, "k int, f string, g string, s string")
    got = {x["k"]: (x["a"], x["b"]) for x in df.select("k", configs.config_error(F.col("f"), F.col("g"), F.col("s")).alias("a"), configs.config_error(F.col("f"), F.col("g"), F.col("s"), pending="p", scanned="p").alias("b")).collect()}
    assert got[1] == (None, None) and got[2] == (configs.CONFIG_ERRORS[0], configs.CONFIG_ERRORS[2]) and got[3][0] == configs.CONFIG_ERRORS[4] and got[4] == (None, None)


def test_dates_or_null(spark):
    told = ["2024-05-01", "2024-13-01", "3/7/2024", "May 5, 2024", "pronto", "", None]
    got = [x[0] and str(x[0]) for x in spark.createDataFrame([(t,) for t in told], "t string").select(K.parsed_date(F.col("t"))).collect()]
    assert got == ["2024-05-01", None, "2024-03-07", "2024-05-05", None, None, None]


def test_extractors_in_turn(spark):
    df = spark.createDataFrame([(1, "Razón Social: A \nFactura Nº 12\nTotal: $ 1.234,5\nCUIT 30-00000001-1 30-00000001-1"), (2, "Factura nro 9"), (3, "x"), (4, None), (5, "")], "`a.b` int, text string")
    out = T.settled(extractors.extract(df, [extractors.Rules(("consortium",)), extractors.Rules(("boletaNumber",), model="numbers")]))
    got = {x["a.b"]: x for x in out.collect()}
    a = json.loads(got[1]["answer"])
    assert (a["consortium"], a["boletaNumber"], a["amount"], a["allTaxIds"], got[1]["model"], got[1]["errors"]) == ("A", "12", "1234.5", ["30-00000001-1"], "labelled-lines", [])
    assert (got[2]["model"], got[2]["errors"], got[2]["total_tokens"]) == ("numbers", ["rules: no consortium in the text"], 3 + 3)
    assert got[3]["answer"] is None and len(got[3]["errors"]) == 2 and got[4]["errors"] == [] and len(got[5]["errors"]) == 2
    assert rows(extractors.usage_of(out, ["`a.b`"]).select("model", "input_tokens")) == [("labelled-lines", 12), ("numbers", 3)]
    assert extractors.extract(df.limit(0), [extractors.Rules()]).count() == 0


def test_the_gate_survives_a_restart(spark, tmp_path):
    ticks, place = str(tmp_path / "ticks"), str(tmp_path / "gate")
    base = 1_700_000_000

    def more(data):
        spark.createDataFrame(data, "tick_id long, client_id long, s long, interval_seconds long, n_files long").select("tick_id", "client_id", F.timestamp_seconds(F.col("s") + base).alias("at"), "interval_seconds", "n_files").write.mode("append").parquet(ticks)
        return {x["tick_id"]: x["accepted"] for x in scheduler.run_gate(spark, ticks, place).collect()}

    first = more([(1, 1, 0, 600, 3), (2, 1, 300, 600, 3), (3, 2, 10, 600, 0), (4, 2, 20, 600, 1), (5, 2, 30, 600, 1)])
    assert first == {1: True, 2: False, 3: True, 4: True, 5: False}  # a tick without files does not close the gate
    second = more([(6, 1, 599, 600, 1), (7, 1, 600, 600, 1), (8, 2, 40, 5, 1), (9, 3, 50, 600, 1)])
    assert second == {**first, 6: False, 7: True, 8: True, 9: True}  # state is there after a restart; an interval is the tick's own
    third = more([(10, 1, 90_000, 600, 1), (11, 3, 90_000, 600, 1)])
    assert third[10] and third[11] and more([(12, 1, 90_001, 600, 1)])[12] is False
