import __spark_entry__ as entry
import pytest
from billforge.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["q_match_alias", "q_match_cascade", "q_match_vendor", "q_document_pipeline"])
def test_query_equals_sql_on_more_rows(name, same_rows, larger):
    same_rows(QUERIES[name], ORACLE_SQL[name], *larger)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_greedy_gate_equals_a_loop(spark, sf_dir):
    got = {r["event_id"]: r["accepted"] for r in QUERIES["q_interval_gate_greedy"](spark, sf_dir).collect()}
    last = {}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    for e in events:
        ok = e["user_id"] not in last or (e["ts"] - last[e["user_id"]]).total_seconds() >= 3600
        if ok:
            last[e["user_id"]] = e["ts"]
        assert got[e["event_id"]] == ok


def test_extract_routes_broken_answers(spark, sf_dir):
    rows = QUERIES["q_extract_parse"](spark, sf_dir).collect()
    assert {r["route"] for r in rows} == {"parsed", "failed"} and all(r["provider"] is None for r in rows if r["route"] == "failed")


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_address_norm", "q_text_clean", "q_match_fuzzy", "q_lsp_route"])
def test_no_python_in_normalisers(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
