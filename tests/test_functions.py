import pytest
from billforge.functions import address as A
from billforge.functions import keys as K
from billforge.functions import text as X
from pyspark.sql import functions as F


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


NAMES = {
    "CONSORCIO DE PROPIETARIOS AV PUEYRREDON 2418": "PUEYRREDON 2418",
    "CONSORCIO DE COPROPIETARIOS THAMES NUMEROS 647-649 CAP F": "THAMES 647",
    "BROWN ALMTE AV 708": "BROWN ALMIRANTE AV 708",
    "CONS. PROPIET. JUFRE 37/39/41": "JUFRE 37",
    "AV ALMIRANTE BROWN 00706 018": "ALMIRANTE BROWN 706",
    "FRAY JUSTO SANTAMARIA DE ORO 02178 001": "FRAY JUSTO SANTAMARIA DE ORO 2178",
    "CASTILLO 00246 C1414AWF CAPITAL FEDERAL": "CASTILLO 246",
    "SAN ANTONIO 345 PB A": "SAN ANTONIO 345",
    "JUNCAL 1234 3 B": "JUNCAL 1234",
    "CONS PROP ARENALES 2154": "CONS PROP ARENALES 2154",
    "GRAL. PAZ 100": "GENERAL. PAZ 100",
    "AV. STA FE 1234 PISO 3 B": "SANTA FE 1234",
    "CALLE 50 1234": "50 1234",
    "GRAL.PAZ 100": "GENERALPAZ 100",
    "CALLE CALLE 9": "CALLE 9",
    "": "",
    None: "",
}


def test_building_names(spark):
    assert values(spark, list(NAMES), A.building_name) == list(NAMES.values())


@pytest.mark.parametrize(
    ("ocr", "name", "hit"),
    [("BROWN ALMTE AV 708", "ALMIRANTE BROWN 706", False), ("ALMIRANTE BROWN 00706 018", "ALMIRANTE BROWN 706", True), ("THAMES 1647", "THAMES 647", True), ("ANYTHING", "---", True)],
)
def test_substring_match(spark, ocr, name, hit):
    df = spark.createDataFrame([(ocr, name)], "o string, n string")
    got = df.select(A.all_within(A.tokens(A.match_text(F.col("n"))), A.match_text(F.col("o"))).alias("x")).first()["x"]
    assert got is hit


def test_provider_names(spark):
    cases = {"EDESUR S.A.": "edesur", "ACME S.A.S.": "acme s", "ACME SAS": "acme", "ACME S.A.U.": "acme u", "TIGRE ASCENSORES S.R.L.": "tigre ascensores", "S.A.": "", "LTDA. NORTE": "norte", "S.C. LIMPIEZA": "limpieza", None: ""}
    assert values(spark, list(cases), K.provider_name) == list(cases.values())


def test_amounts(spark):
    cases = {
        "$ 118.000,00": ("118000.00", 118.0), "118000": ("118000.00", 118000.0), "$ 118,000.00": ("118000.00", 118.0), "1.550.550,00": ("1550550.00", 1.55),
        "1.550.550": ("1.55", 1.55), "118.000": ("118.00", 118.0), "-118.000,00": ("-118.00", -118.0), "12abc": ("12.00", 12.0), "n/a": ("n/a", None), "0": ("0.00", 0.0), "1,234": ("1234.00", 1.23),
        None: ("", None),
    }
    assert values(spark, list(cases), K.business_amount) == [a for a, _ in cases.values()]
    assert values(spark, list(cases), K.extracted_amount) == [b for _, b in cases.values()]


def test_keys(spark):
    df = spark.createDataFrame([(" A1 ", "30-1", "2024-01-02", "1,5"), (None, "", None, None)], "a string, b string, c string, d string")
    key = K.business_key(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = df.select(key.alias("k"), K.stored_key(key, F.lit("h")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("a1|30-1|2024-01-02|1.50", "a1|30-1|2024-01-02|1.50"), (None, "__hash__h")]


def test_sheet_letters_round_trip(spark):
    df = spark.range(0, 18278, 97).select("id", K.column_index(K.column_letters(F.col("id"))).alias("back"))
    assert df.where("id <> back").count() == 0
    assert values(spark, ["A", "Z", "aa", "AZ", "ZZ", "AAA"], lambda c: K.column_index(c)) == [0, 25, 26, 51, 701, 702]


def test_text_rules(spark):
    assert values(spark, ["a\r\n\r\n\r\nb\t\tc  d ", None], lambda c: X.clean_text(F.coalesce(c, F.lit("")))) == ["a\n\nb c d", ""]
    assert values(spark, ["factura telecom", "hola", "LSP 1", "aguas argentinas x", None], X.utility_company) == ["PERSONAL", None, "GENERIC_LSP", "ABSA", None]
    lines = "x\nRazón Social: Cons. de Prop.\nCUIT 3\n30/1\nTHAMES 647\n"
    assert values(spark, [lines, "no", "Social: A"], lambda c: X.building_from_lines(X.plain_lines(c))) == ["Cons. de Prop. THAMES 647", None, "A"]
