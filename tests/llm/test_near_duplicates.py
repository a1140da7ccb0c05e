import random

import numpy as np
import pyarrow.parquet as pq
from bruteforce import jaccard_components, words

from billforge.llm import substring_dedup
from billforge.llm.jaccard_join import link_components
from billforge.llm.shared import components
from billforge.llm.substring_dedup import compact_windows, find_repeats, matches, remove_repeats


def synthetic(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w[:0] = passage
            docs.append(" ".join(w))
    return list(enumerate(docs))


def linked(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_components(df, **more).collect()}


def test_components_equal_brute_force(spark):
    rows = synthetic()
    expected = jaccard_components(rows)
    assert linked(spark, rows) == expected
    # small bounds send every key through stars, listed pairs and blocks
    assert linked(spark, rows, rare=2, pairs_up_to=2, list_up_to=3, block=4, bucket_tokens=50) == expected


def test_components_of_a_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    rows = list(zip(t.doc_id.tolist(), t.text.tolist(), strict=True))
    assert linked(spark, rows) == jaccard_components(rows)


def test_odd_rows(docs, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_components(docs).collect()}
    assert got[0] == got[1] == (9, 0) and got[2] == (10, 0)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[6] == (1, 6) and got[7] == (1, 6)
    assert got[8] == (1, 8) and None not in got and len(got) == 10
    assert link_components(nothing).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_compact_windows_partition_all_long_subsequences():
    h = np.random.default_rng(1).integers(0, 1000, 60).astype(np.uint64)
    seen = {}
    for a, c, b in compact_windows(h, 10):
        for i in range(a, c + 1):
            for j in range(c, b + 1):
                assert (i, j) not in seen
                seen[i, j] = c
    for i in range(60):
        for j in range(i + 9, 60):
            assert seen[i, j] == i + int(h[i : j + 1].argmin())


def test_repeated_passages(spark):
    r = random.Random(5)
    words_of = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    passage = words_of(80)
    near = list(passage)
    near[40] = "changed"
    rows = [(i, " ".join(words_of(60) + passage + words_of(60))) for i in range(0, 30)]
    rows += [(50, "\n".join([*words_of(30), " ".join(near), *words_of(30)])), (60, " ".join(words_of(300))), (61, " ".join(words_of(20) + passage[:20] + words_of(20))), (62, None), (63, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_repeats(df).collect()
    hit = {x["doc_id"] for x in found}
    assert hit == {*range(1, 30), 50}
    assert len(found) < 10 * len(rows)  # all pairs would be over 400
    for x in found:
        assert x["source_doc_id"] < x["doc_id"]
        own = words(dict(rows)[x["doc_id"]])[x["start_word"] : x["end_word"]]
        other = words(dict(rows)[x["source_doc_id"]])[x["source_start"] : x["source_end"]]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (own, other))
        assert 100 * len(a & b) >= 75 * len(a | b) and len(own) >= 50
    left = {x["doc_id"]: x["text"] for x in remove_repeats(df, find_repeats(df)).collect()}
    assert left[0] == rows[0][1] and left[62] is None and left[60] == dict(rows)[60]
    assert all(len(words(left[i])) == 120 for i in range(1, 30))


def has_passage(x, y, width, percent=75):
    """Brute force: passages that start and end with a shared shingle, over all pairs of intervals."""
    spans = lambda v: [(a, b) for a in range(len(v)) for b in range(a + width, len(v) + 1)]
    vocabulary = np.unique(np.r_[x, y])
    of_x, of_y = spans(x), spans(y)
    inside = lambda v, some: np.array([np.isin(vocabulary, v[a:b]) for a, b in some], np.float32).reshape(len(some), len(vocabulary))
    p, q = inside(x, of_x), inside(y, of_y)
    common = p @ q.T
    good = 100 * common >= percent * (p.sum(1)[:, None] + q.sum(1)[None] - common)
    for i, j in zip(*np.nonzero(good), strict=True):
        (a, b), (c, d) = of_x[i], of_y[j]
        if {int(x[a]), int(x[b - 1])} <= set(y[c:d].tolist()) and {int(y[c]), int(y[d - 1])} <= set(x[a:b].tolist()):
            return True
    return False


def test_passages_with_a_long_gap():
    x = np.arange(96, dtype=np.uint32)
    y = x.copy()
    y[42:54] = np.arange(500, 512)  # eight adjacent words of a hundred
    assert matches(x, y, 46, 75) == [(0, 96, 0, 96)]
    y = np.r_[x[:44], np.arange(500, 520, dtype=np.uint32), x[44:]]  # an insertion
    assert (0, 116, 0, 96) in matches(x, y, 46, 75)


def test_passages_equal_brute_force():
    r = random.Random(11)
    counts = [0, 0]
    for _ in range(150):
        x = np.arange(r.randint(20, 34), dtype=np.uint32)
        y = x.tolist()
        for _ in range(r.randint(1, 4)):
            at, n = r.randrange(len(y)), r.randint(1, 5)
            y[at : at + r.choice([0, n])] = [r.randrange(1000, 10**6) for _ in range(r.choice([0, n]))]
        y = np.array(y, np.uint32)
        want = has_passage(x, y, 12)
        got = matches(x, y, 12, 75)
        assert bool(got) == want, (x, y)
        counts[want] += 1
        for a, b, c, d in got:
            p, q = set(y[a:b].tolist()), set(x[c:d].tolist())
            assert b - a >= 12 and d - c >= 12 and 100 * len(p & q) >= 75 * len(p | q)
    assert min(counts) > 10


def test_passages_around_a_common_line(spark):
    r = random.Random(23)
    words_of = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    line = words_of(49)
    rows = {i: words_of(60) + line + words_of(60) for i in range(120)}
    wanted = set()
    for i in range(10):  # far apart in id order, with others between them
        around = [words_of(5), words_of(5)]
        near = [around[0], around[1]] if i % 2 else [["changed", *around[0][1:]], around[1]]
        for d, (a, b) in ((3 + i, around), (100 + i, near)):
            rows[d] = words_of(55) + a + line + b + words_of(55)
        wanted.add(100 + i)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id long, text string")
    for more in ({}, {"block": 16}):
        assert {x["doc_id"] for x in find_repeats(df.repartition(3), **more).collect()} == wanted


def test_rows_with_one_id(spark):
    r = random.Random(8)
    words_of = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    passage = words_of(70)
    rows = [(1, f"{words_of(9)} {passage}"), (2, passage + " " + words_of(9)), (2, None), (2, "short"), *[(3, f"{words_of(5)} {passage}")] * 2, (None, passage)]
    df = spark.createDataFrame([(d, t, [d], "x", 9) for d, t in rows], "doc_id long, text string, spans array<long>, _spans string, row int")
    left = remove_repeats(df, find_repeats(df))
    assert left.columns == df.columns and left.count() == len(rows)
    kept = {(x["doc_id"], x["text"]) for x in left.collect()}
    assert (1, rows[0][1]) in kept and (2, None) in kept and (2, "short") in kept and (None, passage) in kept
    assert not any(d == 3 and passage in t for d, t in kept)
    # of different texts with one id, one stands for it in op10 too
    sizes = {x["doc_id"]: x["n_shingles"] for x in link_components(df).collect()}
    assert sizes[2] in (1, 75) and sizes[3] in {len({tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}) for d, t in rows if d == 3}


def test_near_copies_are_found(spark):
    r = random.Random(29)
    rows, wanted = [], set()
    for i in range(120):
        base = [f"v{r.randrange(10**6)}" for _ in range(120)]
        near = list(base)
        for at in r.sample(range(len(near)), 2 + i % 2):  # every edit changes five shingles
            near[at] = "changed"
        rows += [(i, " ".join(base)), (1000 + i, " ".join(near))]
        if 100 * len(set(zip(*(base[k:] for k in range(5)), strict=False)) & set(zip(*(near[k:] for k in range(5)), strict=False))) >= 75 * 131:
            wanted.add(1000 + i)
    got = {x["doc_id"] for x in find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & wanted) >= 0.97 * len(wanted) and len(wanted) > 50


def test_many_buckets(spark):
    rows = synthetic(7)
    assert linked(spark, rows, bucket_tokens=1e-3) == jaccard_components(rows)


def test_no_repeats(docs, nothing):
    assert {r["doc_id"] for r in find_repeats(docs).collect()} == set()
    assert find_repeats(nothing).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path, monkeypatch):
    """Dots and blanks in names, and names that the operators use themselves."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from billforge.llm import line_quality

    line = "one line that every document of the host has"
    rows = [(i, f"{line}\n" + " ".join(f"w{i % 7}x{j}" for j in range(60)), "s", "v", i) for i in range(30)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string, `x y` long").withColumn("score", F.lit(1)).withColumn("row", F.lit("r"))
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = line_quality.remove_lines(docs, most_docs=5)
    assert out.columns == docs.columns and out.where("text like 'one line%'").count() == 0 and out.where("`a.b` = 'v'").count() == 30
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats, corpus_pipeline.mask_personal_data):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).count() == 8


def test_repeated_shared_shingles_count_once_before_pieces_are_joined(monkeypatch):
    width, percent, r = 6, 75, np.random.default_rng(11)
    for _ in range(300):
        v = r.integers(0, 12, r.integers(1, 40))
        hits = np.array([(r.random(12) < share)[v] for share in (0.2, 0.5, 0.8)])
        for hit, got in zip(hits, substring_dedup._may_repeat(v, hits, width, percent), strict=True):
            parts = ((v[a:b], hit[a:b]) for a in np.flatnonzero(hit) for b in range(a + width, len(v) + 1))
            assert got == any(100 * len(set(p[h].tolist())) >= percent * len(set(p.tolist())) for p, h in parts)
    joined = []
    monkeypatch.setattr(substring_dedup, "_joined", lambda *a: joined.append(a) or [])
    x, y = (np.r_[np.zeros(20, int), k + np.arange(6), np.zeros(20, int)] for k in (100, 200))
    assert substring_dedup.matches(x.astype(np.uint32), y.astype(np.uint32), 46, percent) == [] and not joined
    rights = substring_dedup._Rights([x], 206, 46, percent)
    assert list(rights.candidates(y, np.array([0]))) == [] and list(rights.candidates(x, np.array([0]))) == [0]
