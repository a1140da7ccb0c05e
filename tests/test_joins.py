import pytest
from billforge.operators import match
from billforge.plans.registry import QUERIES
from billforge.sources import tables


@pytest.fixture()
def plans(monkeypatch):
    """The plans of all tables that a query settles, as they are before anything of them runs."""
    told, settled = [], tables.settled

    def settle(df):
        told.append(plan_of(df))
        return settled(df)

    monkeypatch.setattr(tables, "settled", settle)
    return told


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_match_fuzzy", "q_match_alias", "q_match_cascade"])
def test_nothing_goes_through_the_driver(name, spark, sf_dir, plans):
    assert all("Broadcast" not in p for p in [plan_of(QUERIES[name](spark, sf_dir)), *plans])


def test_pieces_of_texts_stay_off_the_driver(spark):
    texts = spark.sql("SELECT * FROM VALUES (1, 'AV LARGE RING 120'), (2, 'CALLE X') AS v(t, text)")
    words = spark.sql("SELECT * FROM VALUES (1, array('RING', '12')), (1, array('NONE')), (2, array('RING')), (1, array()), (1, NULL) AS v(t, words)")
    pairs = match.contained(texts, words, "t")
    assert "Broadcast" not in plan_of(pairs)
    assert [tuple(r) for r in pairs.collect()] == [(1, "AV LARGE RING 120", ["RING", "12"])]


def test_documents_meet_the_directory_by_sorting(spark, sf_dir, plans):
    """But for the at most 179 customers that documents are made up with."""
    plans.append(plan_of(QUERIES["q_document_pipeline"](spark, sf_dir)))
    assert len(plans) > 10 and all("Broadcast" not in p or p.count("BroadcastExchange") == 1 and "-88" in p for p in plans)
