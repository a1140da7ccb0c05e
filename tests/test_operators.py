from billforge.operators import dedup, jobs, merge, periods
from pyspark.sql import functions as F


def test_merge_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    once = merge.merge(t, s, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a", "keep"), (2, "c", "update"), (3, None, "insert")]
    twice = merge.merge(once.drop("action"), s, ["k"]).drop("action")
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.drop("action").collect()), key=str)
    assert {r["k"] for r in merge.merge(t, s, ["k"], delete_orphans=True).collect()} == {2, 3}


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "i int, k string")
    got = {r["i"]: r["is_duplicate"] for r in dedup.mark_duplicates(df, ["k"], F.col("i")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_retry_states(spark):
    df = spark.createDataFrame([(0, 3, True), (0, 3, False), (2, 3, False)], "attempts int, max_attempts int, ok boolean")
    assert sorted((r["status"], r["attempts"]) for r in jobs.after_attempt(df).collect()) == [("COMPLETED", 0), ("FAILED", 3), ("PENDING", 1)]


def test_december_rolls_into_january(spark):
    df = spark.createDataFrame([(1, 2023, 12, 2023, 12), (2, 2023, 11, 2023, 12)], "consortium_id int, year int, month int, majority_year int, majority_month int")
    rows = {r["consortium_id"]: (r["action"], r["next_year"], r["next_month"]) for r in periods.close_all(df).collect()}
    assert rows == {1: ("close", 2024, 1), 2: ("skip", None, None)}


def test_status_of_a_run(spark):
    df = spark.createDataFrame([(5, 0, None), (2, 5, None), (0, 3, None), (5, 0, "stopped"), (None, None, None), (0, 0, None)], "p int, f int, e string")
    assert [r[0] for r in df.select(jobs.run_status("p", "f", "e")).collect()] == ["success", "partial", "failed", "failed", "failed", "success"]


def test_quota_errors(spark):
    said = ["429", "Quota!", "TOO MANY REQUESTS", "Rate Limit", "insufficient_quota", "limit: 0", "limit: 1", None, "x" * 301]
    rows = spark.createDataFrame([(m,) for m in said], "m string").select(jobs.is_quota_error(F.col("m")), jobs.trimmed_error(F.col("m"))).collect()
    assert [r[0] for r in rows] == [True] * 6 + [False] * 3 and rows[8][1] == "x" * 300 + "..." and rows[7][1] is None


def test_new_files_of_a_tenant(spark):
    files = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), ("b", 2, 9)], "t string, f int, n int")
    done = spark.createDataFrame([("a", 1)], "t string, f int")
    got = jobs.new_files(files, done, done.limit(0), tenant="t", file="f", batch="n", order=["f"])
    assert sorted((r["t"], r["f"]) for r in got.collect()) == [("b", 1), ("b", 2)]


def test_gate_takes_one_of_equal_times(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 3599), (4, 1, 3600), (5, 2, 10), (6, 1, None)]
    df = spark.createDataFrame(rows, "id long, k long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = periods.greedy_gate(df, "k", "ts", 3600, "id").where("accepted").collect()
    assert {r["id"] for r in got} == {1, 4, 5}


def test_upserts_write_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in merge.merge(t, s, ["k"], nulls="win").collect()} == {1: "a", 2: None}


def test_answers_of_wrong_types_fail(spark):
    from billforge.operators.extract import parse_answer

    said = ['{"provider":{"x":1}}', '{"paymentMethod":"BITCOIN"}', '{"allTaxIds":[1]}', '{"amount":true}', "[]", "", None, '{"amount":"1.234,5","provider":null,"other":[]}', '{"amount":12,"allTaxIds":["1"]}', "```json\n{}\n```"]
    rows = parse_answer(spark.createDataFrame([(m,) for m in said], "m string"), "m").collect()
    assert [r["route"] for r in rows] == ["failed"] * 7 + ["parsed"] * 3
    assert rows[8]["amount"] == 12.0 and rows[8]["all_tax_ids"] == ["1"]


def test_words_of_a_name_with_a_point_match_it(spark):
    from billforge.functions import address as A
    from billforge.operators import match

    docs = spark.createDataFrame([(1, 5, "GENERAL. BROWN 00706 PB"), (2, 5, "BROWN 706"), (3, 6, "GENERAL BROWN 706"), (4, 5, None)], "doc_id long, client_id int, raw string")
    dim = spark.createDataFrame([(9, 5, "GENERAL. BROWN 706"), (8, 5, ""), (7, 6, "AB 7")], "match_id long, client_id int, name string")
    docs = docs.withColumn("text", A.match_text(F.col("raw")))
    got = match.by_words(docs, dim.withColumn("words", A.tokens(A.match_text(F.col("name")))), "client_id").collect()
    assert [(r["doc_id"], r["match_id"]) for r in got] == [(1, 9)]


def test_equal_texts_and_words_meet_once(spark):
    from billforge.operators import match

    docs = spark.createDataFrame([(i, 5, "GENERAL BROWN 706", "BROWN") for i in range(300)] + [(900, 5, "AB", "AB"), (901, 6, "GENERAL BROWN 706", "")], "doc_id long, client_id int, text string, name string")
    dim = spark.createDataFrame([(i, 5, "BROWN 706", ["BROWN", "706"], f"A BROWN {i % 2}") for i in range(400, 0, -1)], "match_id long, client_id int, text string, words array<string>, name string")
    pairs = match.contained(docs, dim, "client_id")
    assert [(r["client_id"], r["text"], r["words"]) for r in pairs.collect()] == [(5, "GENERAL BROWN 706", ["BROWN", "706"])]
    got = match.by_words(docs, dim, "client_id").collect()
    assert sorted((r["doc_id"], r["match_id"], r["n_matches"]) for r in got) == [(i, 1, 400) for i in range(300)]
    assert {(r["doc_id"], r["match_id"]) for r in match.by_part_of_name(docs, dim, "client_id").collect()} == {(i, 1) for i in range(300)}
    assert {(r["doc_id"], r["match_id"]) for r in match.by_alias(docs, dim, "client_id").collect()} == {(i, 1) for i in range(300)}


def test_enqueue_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    from billforge.streaming.enqueue import enqueue_once

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.where("event_id < 50").write.parquet(str(tmp_path / "in" / "a.parquet"))
    for _ in range(2):
        out = enqueue_once(spark, str(tmp_path / "in" / "a.parquet" / "*.parquet"), str(tmp_path / "place"))
        assert out.count() == out.distinct().count() == events.where("event_id < 50").selectExpr("user_id % 25", "event_type").distinct().count()
