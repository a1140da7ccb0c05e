import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty, blank and repeated texts, and columns with clashing names."""
    a = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(0, a), (1, a.upper()), (2, a + " fourteen"), (3, None), (4, ""), (5, " \n "), (6, "one two"), (7, "one two"), (8, "x " * 3000), (8, "x " * 3000), (None, a), (9, "aé 日本 " * 40)]
    return spark.createDataFrame([(d, t, 7, "s0", d) for d, t in rows], "doc_id long, text string, n long, source string, component_id long")


@pytest.fixture
def nothing(spark, docs):
    return docs.limit(0)
