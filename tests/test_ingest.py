from billforge.operators import sheets
from billforge.sources import ingest
from billforge.sources import tables as T
from pyspark.sql import functions as F


def test_files_extract_and_route(spark, tmp_path):
    for name, data in {"a.pdf": b"text a", "b.pdf": b"scan", "c.pdf": b"boom", "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)

    def direct(content):
        if content == b"boom":
            raise ValueError("broken")
        return "" if content == b"scan" else content.decode()

    files = ingest.list_files(spark, str(tmp_path))
    assert [r["tenant"] for r in files.collect()] == [None] * 3
    got = ingest.extract_text(files, [direct, lambda c: "from images" if c == b"scan" else None])
    rows = {r["name"]: r for r in ingest.route(got.withColumn("match_id", F.when(F.col("name") == "a.pdf", 1))).collect()}
    assert {n: (r["text"], r["route"]) for n, r in rows.items()} == {"a.pdf": ("text a", "scanned"), "b.pdf": ("from images", "unassigned"), "c.pdf": (None, "failed")}
    assert rows["c.pdf"]["error"].startswith("ValueError")


def test_mapping(spark):
    assert sheets.mapping_of({"amount": "A"}) == sheets.DEFAULT_MAPPING
    mapping = sheets.mapping_of({"boletaNumber": "b", "amount": "a"}, {"boletaNumber": "A", "amount": "B"})
    df = spark.createDataFrame([("x", 118000.0), (None, None)], "boletaNumber string, amount double")
    out = sheets.sheet_row(df, mapping)
    assert out.columns == ["A", "B"] and [tuple(r) for r in out.collect()] == [("$ 118.000,00", "x"), ("", "")]


def test_files_of_tenants_come_in_order(spark, tmp_path):
    import os

    for i, name in enumerate(("t1/b.pdf", "t2/x/a.pdf", "t1/a.pdf", "c.pdf")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1_700_000_000 - i // 2, 1_700_000_000 - i // 2))
    assert [(r["tenant"], r["name"]) for r in ingest.list_files(spark, str(tmp_path)).collect()] == [("t1", "a.pdf"), (None, "c.pdf"), ("t2", "a.pdf"), ("t1", "b.pdf")]


def test_bills_are_read_again_by_their_first_page(spark, tmp_path):
    for name, data in {"bill.pdf": "EDESUR\fpage two", "other.pdf": "invoice\fmore", "late.pdf": "x\fAYSA", "bad.pdf": "boom"}.items():
        (tmp_path / name).write_text(data)

    def direct(content, pages=None):
        if content == b"boom":
            raise ValueError("broken")
        return "\f".join(content.decode().split("\f")[:pages])

    got = {r["name"]: (r["company"], r["text"], r["error"]) for r in ingest.texts_to_extract(ingest.list_files(spark, str(tmp_path)), [direct], T.settled).collect()}
    assert got == {"bill.pdf": ("EDESUR", "EDESUR", None), "other.pdf": (None, "invoice\fmore", None), "late.pdf": ("AYSA", "x", None), "bad.pdf": (None, None, "ValueError: broken")}
