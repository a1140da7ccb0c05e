import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from bruteforce import words

from billforge.llm import filter_audit, language_id, merkle
from billforge.llm.numbering import numbered
from billforge.llm.oracles import filter_audit_sql, merkle_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, source, lang, n, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree(nodes):
    """The root, and each leaf's path, by the plain rule."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        at = [p // 16 for p in at]
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return (nodes[0] if nodes else None), paths


def fold(h, path):
    for a, b in path:
        h = H(a, h, b)
    return h


def manifest_by_hand(rows):
    by = {}
    for d, text, lang, source, n in rows:
        by.setdefault(source, []).append((d, text, lang, source, n))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, own = [], []
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        leaves = [leaf(d, source, lang, n, text) for d, text, lang, source, n in ordered]
        root, paths = tree(leaves)
        subroots.append(root)
        own.append((ordered, leaves, paths))
    root, above = tree(subroots)
    out = []
    for (ordered, leaves, paths), sub, up in zip(own, subroots, above, strict=True):
        for (d, text, lang, source, n), h, path in zip(ordered, leaves, paths, strict=True):
            told = h
            if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and text is not None:
                told = leaf(d, source, lang, n, re.sub("[A-Z]", lambda m: m[0].lower(), text))
            full = path + up
            out.append((d, h, sub, root, H(*(a + b for a, b in full)), fold(told, full), fold(told, full) == root))
    return sorted(out, key=repr)


def rows_of(seed, n):
    r = random.Random(seed)
    rows = [(i * 3 + 1, r.choice([None, "", "Ab É", "abc", "A" * 50]), r.choice([None, "en", "fr"]), r.choice(["big", "big", "big", None, "é", "z", ""]), r.choice([None, 7])) for i in range(n)]
    return rows + rows[:1] + [(None, "X", "en", "big", 1), (None, "X", "en", "big", 1), (5, "other text", "en", "big", 2), (10**12, "Only", "en", "one", 4)]


@pytest.mark.parametrize("n, size", [(0, 4096), (40, 4096), (700, 10), (700, 64)])
def test_manifest_equals_the_plain_rule(spark, n, size):
    rows = rows_of(n, n)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA + ", tree string, place long")
    got = sorted((tuple(x) for x in merkle.audit(df, size=size).collect()), key=repr)
    assert got == manifest_by_hand(rows)


def test_manifest_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trees_of_more_than_three_levels(spark):
    leaves = [H(str(i)) for i in range(5000)]
    df = spark.createDataFrame([(1, i, len(leaves), h) for i, h in enumerate(leaves)], "tree long, place long, n long, digest string")
    nodes = merkle.build_nodes(df, len(leaves)).collect()
    assert [x["digest"] for x in nodes if x["n"] == 1] == [tree(leaves)[0]]
    assert len(nodes) == 313 + 20 + 2 + 1


def test_octopus_fetches_the_fewest_nodes_and_expands_each_proof():
    r = random.Random(5)
    for n in (1, 2, 16, 17, 300, 4097):
        leaves = [H(str(i)) for i in range(n)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        for _ in range(5):
            some = np.array(sorted(r.sample(range(n), r.randint(1, min(n, 40)))))
            missing = merkle.missing_coordinates(some, n)
            known = set(some.tolist())
            for level, places in enumerate(missing):  # needed and not derivable, nothing else
                need = {p for k in known for p in range(k // 16 * 16, min(len(levels[level]), k // 16 * 16 + 16))} - known
                assert set(places.tolist()) == need
                known = {k // 16 for k in known}
            fetched = {(k, p): levels[k][p] for k, places in enumerate(missing) for p in places.tolist()}
            paths = list(merkle.expand(some, [leaves[i] for i in some], n, fetched))
            assert all(fold(leaves[i], p) == levels[-1][0] for i, p in zip(some, paths, strict=True))
            assert paths == [tree(leaves)[1][i] for i in some]


def test_proofs_of_some_leaves_only(spark):
    rows = rows_of(3, 300)
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    some = made.leaves.where("doc_id % 7 = 0")
    out = merkle.proofs(made, some, size=32)
    folded = out.select(merkle.folded(merkle.folded(out["digest"], out["steps"]), out["above"]).alias("r")).collect()
    assert len(folded) == some.count() > 10 and {x["r"] for x in folded} == {made.root}


def test_numbers_are_gapless_in_every_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1, 1, 2, None, 5]), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, o long, i long"), "g", ["o"]).collect()
    for g in ("a", "b", None):
        own = sorted((x["place"], x["o"]) for x in got if x["g"] == g)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [o for _, o in own] == sorted((o for _, o in own), key=lambda o: (o is not None, o))


LETTERS = "ABCDE"


def audit_by_hand(rows, labels):
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    docs = []
    for d, text, lang in rows:
        t = text or ""
        w = words(t, lower=False)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and t in first and d > first[t],
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        shapley = dict.fromkeys(LETTERS, 0)
        for order in itertools.permutations(LETTERS):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                failing = sum(f in x[1] for x in own)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows(seed=2):
    r = random.Random(seed)
    texts = [None, "", "a b c", "A " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " #", "WORD " * 10, " ".join(f"É{i}" for i in range(220))]
    rows = [(r.choice([i, i, i, 7, None]), r.choice(texts), r.choice(["en", "en", "en", "fr", None])) for i in range(300)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("block", [7, 65536])
def test_audit_of_filters_equals_applying_them(spark, block):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, lang string, A long")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), block=block).collect()
    assert {tuple(x)[:3]: list(x)[3:] for x in got} == audit_by_hand(rows, labels)


def test_audit_of_nothing_and_of_a_part_that_fails_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).collect() == []
    fine = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(250)), "en")], empty.schema)
    got = filter_audit.audit(fine, labels).collect()
    assert len(got) == 600 and {tuple(x)[3:] for x in got} == {(1, 0, 0, 0, 0, 0, 0)}


def test_posting_lists_are_sorted_and_merge(spark):
    rows = [("p", i % 50, i % 2 == 0, i % 3 == 0) for i in range(200)] + [("q", None, True, False)]
    blocks = filter_audit.postings(spark.createDataFrame(rows, "part string, doc_id long, A boolean, B boolean"), "AB", [], block=30).collect()
    assert sum(len(b["doc_ids"]) for b in blocks) == 201 and all(len(b["doc_ids"]) <= 30 for b in blocks)
    assert all(b[c] == sorted(set(b[c])) for b in blocks for c in "AB")
    r = random.Random(4)
    for _ in range(50):
        lists = [np.array(sorted(r.sample(range(60), r.randint(0, 40))), np.int32) for _ in range(r.randint(0, 5))]
        every = set().union(*(x.tolist() for x in lists))
        assert filter_audit.union(lists).tolist() == sorted(every)
        needles = np.array(sorted(r.sample(range(60), 20)), np.int32)
        assert needles[filter_audit.held(needles, filter_audit.union(lists))].tolist() == sorted(every & set(needles.tolist()))


@pytest.mark.parametrize("name", ["merkle", "audit"])
def test_sql_agrees_with_the_plain_rule_on_nulls_and_repeats(name):
    con = duckdb.connect()
    if name == "merkle":
        rows = rows_of(9, 90)
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(x) for x in rows])
        got = [tuple(x) for x in con.execute(merkle_sql()).fetchall()]
        assert sorted((x[:5] for x in got), key=repr) == sorted((x[:5] for x in manifest_by_hand(rows)), key=repr)
    else:
        rows, labels = audit_rows(3)
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(x) for x in rows])
        con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
        con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [list(x) for x in labels if x[0] is not None])
        got = {tuple(x)[:3]: list(x)[3:] for x in con.execute(filter_audit_sql()).fetchall()}
        assert got == audit_by_hand(rows, labels)


def tongue(seed, name):
    r = random.Random(seed)
    syllables = {"aa": "ka lo mi ru", "bb": "sch tze ung pf", "cc": "éa ço ñi ou"}[name].split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60)))


@pytest.fixture(scope="module")
def tongues(spark):
    rows = [(i, tongue(i, "abc"[i % 3] * 2) if i % 10 else tongue(i, "abc"[i % 3] * 2).upper(), "abc"[i % 3] * 2) for i in range(300)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? 日", None), (1003, "12 -- 7", "bb"), (None, "kalo miru", "aa"), (5, tongue(5, "cc"), "cc"), (1004, "ka " * 30000, None)]
    return spark.createDataFrame([(*x, 1, "s") for x in rows + odd], "doc_id long, text string, lang string, score long, held_out string")


def test_languages_of_held_out_texts(tongues):
    got = language_id.identify(tongues).toPandas()
    lang = {i: "abc"[i % 3] * 2 for i in range(300)}
    own = got[got.doc_id < 300]
    assert set(own[own.held_out].doc_id) == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    held = own[own.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.98
    assert got.score.between(0, 1).all() and len(got) == 307
    by = got.set_index("doc_id").lang_pred
    assert [by[i] for i in (1000, 1001, 1003)] == ["und"] * 3 and by[1002] in ("aa", "bb", "cc") and by[1004] == "aa"
    assert got[got.lang_pred == "und"].ambiguous.all()


def test_predictions_equal_a_plain_decoding(spark, tongues):
    model = language_id.train(tongues)
    texts = [tongue(700 + i, "abc"[i % 3] * 2) for i in range(12)] + ["ka schtze", "Ünf  12 ka"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for x, text in zip(sorted(got), texts, strict=True):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        grams = [plain[i : i + k] for k in language_id.GRAMS for i in range(len(plain) - k + 1)]
        _, _, doc, at = next(language_id.grams([text]))
        assert len(at) == len(grams) and len(set(at.tolist())) <= len(set(grams))
        m = [model.bias[b] + sum(language_id._SCALE / len(at) * model.weights[a, b] for a in at.tolist()) for b in range(len(model.bias))]
        loss = {name: sum(model.trust[i, b] * np.log1p(np.exp(-m[b] * model.code[i, b])) for b in range(len(m))) for i, name in enumerate(model.languages)}
        assert x["lang_pred"] == min(loss, key=loss.get)
        odds = [np.exp(-len(m) * (v - min(loss.values()))) for v in loss.values()]
        assert x["score"] == pytest.approx(1 / sum(odds), rel=1e-6)


def test_codewords_lie_apart():
    for n in (2, 3, 4, 6):
        code = language_id.codewords(n).astype(int)
        assert code.shape == (n, 2 ** (n - 1) - 1) and all((np.abs(c.sum()) < n) for c in code.T)
        assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]
    code = language_id.codewords(30).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert apart[~np.eye(30, dtype=bool)].min() >= 10


def test_a_wrong_bit_is_corrected_and_a_tie_is_flagged():
    code = language_id.codewords(5)
    model = language_id.Model(list("abcde"), code, None, np.zeros(15), np.full(code.shape, 1 / 15))
    m = code.astype(float) * 3
    for bit in range(15):
        wrong = m.copy()
        wrong[:, bit] *= -1
        best, _, _, near = language_id.decode(wrong, model)
        assert best.tolist() == [0, 1, 2, 3, 4] and not near.any()
    between = ((m[0] + m[1]) / 2)[None]
    assert language_id.decode(between, model)[3].all()


def test_one_language_or_none(spark):
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "def", "xx"), (3, None, None)], "doc_id long, text string, lang string")
    assert {(x["doc_id"], x["lang_pred"], x["score"]) for x in language_id.identify(one).collect()} == {(1, "xx", 1.0), (2, "xx", 1.0), (3, "und", 0.0)}
    assert {x["lang_pred"] for x in language_id.identify(one.withColumn("lang", one["lang"].try_cast("int").cast("string"))).collect()} == {"und"}
    assert language_id.identify(one.limit(0)).collect() == []
