"""The document pipeline against a plain loop over documents, and its single rules."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from billforge.operators import documents
from billforge.operators.assign import Directory, assign
from billforge.sources import tables as T

B = "building_id long, client_id int, canonical_name string, raw_name string, tax_id string, match_names string"
V = "vendor_id long, client_id int, canonical_name string, tax_id string, match_names string, payment_alias string"
S = "service_id long, client_id int, building_id long, provider string, vendor_id long, client_number string"
P = "building_id long, year int, month int"


def directory(spark, b, v, s=(), p=()):
    return Directory(spark.createDataFrame(list(b), B), spark.createDataFrame(list(v), V), spark.createDataFrame(list(s), S), spark.createDataFrame(list(p), P))


BUILDINGS = [(1, 1, "ALSINA 100", "Alsina 100", "33-00000001-5", None), (2, 1, "BELGRANO 200", "Alsina 100", None, None), (3, 1, "COLON 300", "Colon 300", None, None), (4, 2, "ALSINA 100", "Alsina 100", None, None)]
VENDORS = [(10, 1, "Ascensores Uno", "30-11111111-1", None, "PAGO"), (11, 1, "Bombas Dos", None, None, None), (12, 1, "Cerrajeros Tres", "30222222221", None, ""), (13, 2, "Ascensores Uno", "30111111111", None, None)]


def dashed(tax):
    d = re.sub(r"\D", "", tax or "")
    return f"{d[:2]}-{d[2:10]}-{d[10]}" if len(d) == 11 else tax


def key_of(r):
    parts = [(r["number"] or "").lower(), (r["tax"] or "").lower(), r["due"] or "", "" if r["amount"] is None else f"{r['amount']:.2f}"]
    return "|".join(parts) if any(parts) else None


def loop(docs, sheet):
    """Documents one by one, with names that match exactly and no other rule."""
    store, keys, out = {}, {t: set(k) for t, k in sheet.items()}, {}
    for d, tenant, text, answer in sorted(docs):
        if text is None:
            out[d] = ("failed",) + (None,) * 5
            continue
        h = hashlib.sha256(text.encode()).hexdigest()
        mine = store.setdefault(tenant, {}).get(h)
        if mine:
            r = dict(mine["r"], due=mine["r"]["due"] if re.match(r"\d{4}-", mine["r"]["due"] or "") else None)
        elif answer is None:
            r = dict.fromkeys(("number", "tax", "due", "amount", "building", "vendor"))
        else:
            a = json.loads(answer)
            r = {"number": a["boletaNumber"], "tax": dashed(a["providerTaxId"]), "due": a["dueDate"], "amount": a["amount"], "building": a["consortium"], "vendor": a["provider"]}
        raw = key_of(r)
        how = "hash" if mine else None
        if not mine and raw and any(x["parts"] == raw for x in store[tenant].values()):
            how = "stored key"
        if not how and raw in keys.setdefault(tenant, set()):
            how = "sheet key"
        b = min((x for x in BUILDINGS if x[1] == tenant and x[2] == (r["building"] or "").upper()), default=None)
        digits = re.sub(r"\D", "", r["tax"] or "")
        v = min((x for x in VENDORS if x[1] == tenant and len(digits) >= 10 and re.sub(r"\D", "", x[3] or "") == digits), default=None)
        v = v or min((x for x in VENDORS if x[1] == tenant and r["vendor"] and x[2].lower() == r["vendor"].lower()), default=None)
        if not b or not v:
            out[d] = ("unassigned", None, None, False, raw, None)
            continue
        r = dict(r, building=b[3], vendor=v[2], tax=v[3] or r["tax"])
        parts = key_of(r) or f"__hash__{h}"
        if parts.startswith("__hash__"):
            parts = f"__hash__{h}"
        free = not any(x["parts"] == parts for k, x in store[tenant].items() if k != h)
        if free:
            store[tenant][h] = {"r": r, "parts": parts, "last": d, "dup": how is not None}
        if raw:
            keys.setdefault(tenant, set()).add(raw)
        out[d] = ("scanned", b[0], how, free, raw, parts)
    return out, {(t, h): (x["parts"], x["last"], x["dup"], x["r"]["building"]) for t, s in store.items() for h, x in s.items()}


def random_docs(seed, n=90):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        fields = {
            "boletaNumber": r.choice(["1", "1", "2", None]), "consortium": r.choice(["Alsina 100", "Alsina 100", "Belgrano 200", "Colon 300", "nobody", None]), "provider": r.choice(["ascensores uno", "Bombas Dos", "cerrajeros tres", "x", None]),
            "providerTaxId": r.choice([None, None, "30-11111111-1", "30222222221", "30-22222222-1", "99"]), "dueDate": r.choice(["2024-05-01", "2024-05-01", "pronto", None]), "amount": r.choice([1.5, 1.5, 1.5, None]),
        }
        docs.append((i * 2, r.choice([1, 1, 1, 2]), r.choice(["a", "b", "c", "d", f"own {i}", f"own {i}", None]), r.choice([json.dumps(fields)] * 8 + [None])))
    return docs


@pytest.mark.parametrize("seed", [4])
def test_equals_a_loop_over_documents(spark, seed):
    docs, sheet = random_docs(seed), {1: {"1||2024-05-01|1.50", "2|99||2.00"}}
    df = spark.createDataFrame(docs, "doc_id int, client_id int, text string, answer string")
    keys = spark.createDataFrame([(t, k) for t, ks in sheet.items() for k in ks], "client_id int, business_key string")
    got = documents.process(df, directory(spark, BUILDINGS, VENDORS), T.settled, sheet_keys=keys)
    expected, store = loop(docs, sheet)
    out = {x["doc_id"]: (x["route"], x["building_id"] if x["route"] == "scanned" else None, x["duplicate_by"], x["saved"], x["business_key"], x["stored_key"]) for x in got.documents.collect()}
    assert out == expected
    assert {(x["client_id"], x["content_hash"]): (x["stored_key"], x["last_doc_id"], x["is_duplicate"], x["consortium"]) for x in got.invoices.collect()} == store
    ways = {x[2] for x in expected.values()}
    assert {"hash", "stored key", "sheet key"} <= ways and any(x[0] == "scanned" and not x[3] for x in expected.values())


def doc(i, text, building, vendor, tenant=1, **more):
    return i, tenant, text, json.dumps({"consortium": building, "provider": vendor, **more})


def outcomes(spark, docs, d):
    df = spark.createDataFrame(docs, "doc_id int, client_id int, text string, answer string")
    return {x["doc_id"]: x for x in documents.process(df, d, T.settled).documents.collect()}


def test_a_duplicate_by_the_stored_key_alone(spark):
    d = directory(spark, BUILDINGS, VENDORS)
    docs = [
        doc(1, "a", "Alsina 100", "Ascensores Uno", boletaNumber="7"),  # no tax id extracted: the directory's is stored
        doc(2, "b", "Alsina 100", "Ascensores Uno", boletaNumber="7", providerTaxId="30111111111"),
        doc(3, "c", "Alsina 100", "Cerrajeros Tres", boletaNumber="8", providerTaxId="30222222221"),  # stored without dashes
        doc(4, "d", "Alsina 100", "Cerrajeros Tres", boletaNumber="8", providerTaxId="30222222221"),  # so only the sheet has its key
        doc(5, "e", "Alsina 100", "Ascensores Uno", boletaNumber="7"),
    ]
    got = outcomes(spark, docs, d)
    assert {i: (x["duplicate_by"], x["saved"]) for i, x in got.items()} == {1: (None, True), 2: ("stored key", False), 3: (None, True), 4: ("sheet key", False), 5: ("sheet key", False)}
    assert got[1]["business_key"] == "7|||" and got[1]["stored_key"] == "7|30-11111111-1||" and got[1]["alias"] == "PAGO" and got[3]["alias"] is None


def test_fields_of_failures_lines_and_utilities(spark):
    d = directory(spark, BUILDINGS, VENDORS)
    docs = [
        (1, 1, "Razón Social: Alsina 100\nx", "no json"),  # nothing was extracted, so the text's line is not asked
        doc(2, "Razón Social: Alsina 100\ny", "Consorcio de Propietarios", "Bombas Dos"),
        doc(3, "EDESUR\nRazón Social: Alsina 100", "x", "Bombas Dos"),  # bills of utilities keep theirs
        doc(4, "Razón Social: Alsina 100\nz", "Consorcio Larga Alsina 100", "Bombas Dos"),  # the longer name stays
        (5, 1, None, "{}"),
        doc(6, "u", "Alsina 100", "Bombas Dos", tenant=3),  # a tenant without a directory
        doc(7, "", "Alsina 100", "Bombas Dos"),
    ]
    got = outcomes(spark, docs, d)
    assert {i: x["route"] for i, x in got.items()} == {1: "unassigned", 2: "scanned", 3: "unassigned", 4: "scanned", 5: "failed", 6: "unassigned", 7: "scanned"}
    assert got[1]["observation"] == "OCR_ONLY" and got[2]["consortium"] == "Alsina 100" and got[3]["company"] == "EDESUR" and got[4]["building_rule"] == 2
    assert outcomes(spark, docs[:0], d) == {}


ASKED = "doc_id int, client_id int, company string, consortium string, provider string, provider_tax_id string, client_number string, all_tax_ids array<string>"


def test_vendors_services_and_periods(spark):
    buildings = [*BUILDINGS, (5, 1, "DORREGO 5", "Dorrego 5", None, "Torre Azul | Lago 12")]
    services = [(100, 1, 3, "EDESUR", None, "77"), (101, 1, 1, "EDESUR", 12, "77"), (102, 1, 2, "METROGAS", None, "5"), (103, 2, 4, "EDESUR", None, "9")]
    d = directory(spark, buildings, VENDORS, services, [(1, 2024, 5), (3, 2023, 12)]).settled(T.settled)
    own, other = ["33 00000001 5", "30-11111111-1"], ["30-22222222-1"]
    asked = [
        (1, 1, None, "nobody", "x", None, None, own),  # building and vendor by tax ids
        (2, 1, None, "Colon 300", "Bombas Dos", "30-11111111-1", None, None),  # the document's own tax id outranks its name
        (3, 1, None, "Alsina 100", "Bombas Dos", "33-00000001-5", None, None),  # but not where it is the building's
        (4, 1, None, "Alsina 100", "bombas", None, None, []),  # part of a name
        (5, 1, None, "Alsina 100", "zzz", None, None, None),  # no vendor
        (6, 1, "EDESUR", None, None, None, "0077", other),  # the company's vendor's service
        (7, 1, "EDESUR", None, None, "1", "77", None),  # the label's service with the smallest id
        (8, 1, "METROGAS", "Alsina 100", "Bombas Dos", None, "99", None),  # an unknown number
        (9, 1, "GENERIC_LSP", None, "Bombas Dos", None, "77", None),
        (10, 1, "METROGAS", None, None, None, "5", other),  # a service without a vendor gets one
        (11, 1, None, "El Lago 12 bis", "Bombas Dos", None, None, None),  # an alias
        (12, 2, "EDESUR", None, None, None, "77", None),  # another tenant's service
        (13, 1, None, " ", "Bombas Dos", "", None, ["123"]),
    ]
    got = {x["doc_id"]: x for x in assign(spark.createDataFrame(asked, ASKED), d, T.settled).collect()}
    short = {i: (x["building_id"], x["vendor_id"], x["service_id"], x["assigned"]) for i, x in got.items()}
    assert short == {
        1: (1, 10, None, True), 2: (3, 10, None, True), 3: (1, 11, None, True), 4: (1, 11, None, True), 5: (1, None, None, False), 6: (1, 12, 101, True), 7: (3, None, 100, True), 8: (1, 11, None, True),
        9: (None, None, None, False), 10: (2, 12, 102, True), 11: (5, 11, None, True), 12: (None, None, None, False), 13: (None, None, None, False),
    }
    assert (got[2]["period"], got[1]["period"], got[4]["vendor_rule"], got[2]["vendor_rule"], got[11]["building_rule"]) == ("12/2023", "05/2024", 3, 1, 3)
    assert (got[7]["new_provider"], got[7]["new_tax_id"], got[6]["new_provider"], got[6]["new_tax_id"]) == ("EDESUR S.A.", "1", "Cerrajeros Tres", "30222222221")
    assert (got[10]["fill_vendor"], got[6]["fill_vendor"], got[7]["fill_vendor"]) == (12, None, None)


def test_records_that_change_when_taken_again(spark):
    """A due date that is none, and a building whose own name leads to another, change what the next copies find."""
    buildings = [(1, 1, "ALSINA 100", "Belgrano 200", None, None), (2, 1, "BELGRANO 200", "Belgrano 200", None, None)]
    docs = [doc(i, "same", "Alsina 100", "Bombas Dos", boletaNumber="1", dueDate="pronto") for i in range(1, 6)] + [doc(3, "else", "Alsina 100", "Bombas Dos", boletaNumber="1", tenant=2)]
    got = outcomes(spark, [x for x in docs if x[1] == 1], directory(spark, buildings, VENDORS))
    assert [(got[i]["building_id"], got[i]["stored_key"], got[i]["saved"]) for i in range(1, 6)] == [(1, "1||pronto|", True), *[(2, "1|||", True)] * 4]


def test_many_copies_take_a_bounded_number_of_rounds(spark):
    docs = [doc(i, "same", "Alsina 100", "Bombas Dos", boletaNumber=str(i)) for i in range(400)]
    written = []
    df = spark.createDataFrame(docs, "doc_id int, client_id int, text string, answer string")
    out = documents.process(df, directory(spark, BUILDINGS, VENDORS), lambda x: written.append(1) or T.settled(x))
    assert out.documents.where("duplicate_by = 'hash'").count() == 399 and out.invoices.count() == 1 and len(written) < 60
    assert out.invoices.select(F.col("boleta_number")).first()[0] == "0"


def test_prompts_follow_companies_that_the_texts_themselves_name(spark, same_rows, tmp_path):
    import duckdb
    from billforge.plans.registry import ORACLE_SQL, QUERIES

    texts = ["Factura de EDENOR", "nada", "usted personal\r\notra", "METROGAS y EDESUR", None, "x", "aguas de argentinas"]
    rows = [(i, t, "es", "src", len(t or "")) for i, t in enumerate(texts * 2, start=1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(QUERIES["q_prompts"], ORACLE_SQL["q_prompts"], str(tmp_path), con)
