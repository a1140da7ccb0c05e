import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from billforge.llm import edit_counts, packing, pretokens
from billforge.llm.sentencepiece_unigram import MARKER, Unigram, decode, encode

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts(n=3000):
    r = random.Random(1)
    parts = ["don't", "it's", " ", "  ", "\n", "\t", "a", "É", "ß9", "12", "'", "''", "'s", "'re ", "'ll", "...", "$", "\xa0", "×", "œ", "日本", "\x1c", "_", "<|endoftext|>", "😀"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)] + [None, "", "x" * 5000]


def test_ids_equal_the_tokenizer(reference):
    texts = odd_texts()
    for text, ids in zip(texts, packing.BpeEncoder(BPE).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == reference(text)


def test_pre_tokens_cover_each_text():
    data = np.frombuffer(b"a b  c'll\n\n d", np.uint8)
    at = pretokens.starts(data, np.array([0, 5, 13]))
    assert at[0] == 0 and 5 in at and (np.diff(at) > 0).all()


def check_packing(rows, texts, reference, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = [*reference(text), 0]
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p["start"] == at and 1 <= p["length"] <= capacity
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // capacity)
        assert all(p["length"] == capacity for p in pieces[1:])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing(spark, reference):
    texts = dict(enumerate([*odd_texts(300), *("word " * k for k in range(1, 400, 3))]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces = packing.tokenize(df, BPE, capacity=64).withColumn("ids_crc32", F.crc32("ids"))
    rows = packing.pack(pieces, capacity=64).collect()
    used = check_packing(rows, texts, reference, 64)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 64) + 1
    several = packing.pack(pieces, capacity=64, group_pieces=50).collect()
    check_packing(several, texts, reference, 64)


def test_packing_odd_rows(docs, nothing):
    rows = packing.pack(packing.tokenize(docs, BPE)).collect()
    assert sum(r["doc_id"] == 8 for r in rows) == 2 * 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert next(r["length"] for r in rows if r["doc_id"] == 3) == 1
    assert packing.pack(packing.tokenize(nothing, BPE)).count() == 0


def squares(gaps):
    return sum(v * v for g, v in gaps.items() if g)


def test_each_place_is_a_smallest_sum_of_squares():
    lengths = np.random.default_rng(2).integers(1, 33, 300)
    sequence, offset = packing.sum_of_squares(lengths, 32)
    gaps, used = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        options = []
        for g in [*(g for g, v in gaps.items() if v and g >= s), 32]:
            new = dict(gaps)
            if g != 32 or gaps.get(32):
                new[g] = new.get(g, 0) - 1
            new[g - s] = new.get(g - s, 0) + 1
            options.append((squares(new), new))
        before = used.get(int(sequence[i]), 0)
        assert before == offset[i]
        after = dict(gaps)
        if before:
            after[32 - before] -= 1
        after[32 - before - s] = after.get(32 - before - s, 0) + 1
        assert squares(after) == min(o[0] for o in options)
        gaps = after
        used[int(sequence[i])] = before + s


def test_edits_equal_encoding_anew(reference):
    counter = edit_counts.Counter(BPE)
    r = random.Random(5)
    for text in [*odd_texts(40), "the cat's   9 \n\n " * 80]:
        text = text or ""
        tree = edit_counts.TokenTree(next(counter.leaves(pa.array([text]), 8)), counter, 8)
        for _ in range(8):
            start, n = r.randint(0, len(text) + 2), r.choice([0, 1, 5, 60, 3000])
            insert = "".join(r.choice([" ", "'s", "the", "\n", "9", "é", "日", "ab " * 40]) for _ in range(r.randint(0, 6)))
            tree.edit(start, n, insert)
            start = min(start, len(text))
            text = text[:start] + insert + text[start + n :]
            assert tree.text() == text and tree.tokens == len(reference(text)) and tree.chars == len(text)


def test_edits_around_added_tokens(reference):
    r = random.Random(3)
    parts = ["<|endof", "text|>", "<|endoftext|>", "a ", "don't ", "  ", "日", " 12", "\n", "<|", "|>", "endoftext"]
    counter = edit_counts.Counter(BPE)
    for _ in range(100):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 300)))
        tree = edit_counts.TokenTree(next(iter(counter.leaves(pa.array([s]), 4))), counter, 4)
        for _ in range(6):
            a, n, more = r.randint(0, len(s) + 2), r.randint(0, 12), "".join(r.choice(parts) for _ in range(r.randint(0, 3)))
            tree.edit(a, n, more)
            a = min(a, len(s))
            s = s[:a] + more + s[a + n :]
            assert tree.text() == s and tree.tokens == len(reference(s))


def test_clashing_names(spark, unigram):
    df = spark.createDataFrame([(1, "some text", 5, 6, 7, 8)], "doc_id long, text string, n_tokens int, ids int, offset int, _g int")
    back = decode(encode(df, unigram).withColumn("text", F.lit("x")), unigram).first()
    assert back["text"] == "some text" and back["offset"] == 7
    pieces = packing.tokenize(df, BPE).withColumns({"offset": F.lit(3), "_g": F.lit(4), "sequence_id": F.lit(5)})
    placed = packing.pack(pieces).collect()
    assert [(x["offset"], x["_g"]) for x in placed] == [(0, 4)]


def test_edit_encodes_a_part_only():
    counter = edit_counts.Counter(BPE)
    text = "some words of a long text " * 2000
    tree = edit_counts.TokenTree(next(counter.leaves(pa.array([text]), 64)), counter, 64)
    assert tree.edit(25000, 3, "new") < 2000


def test_count_edits(spark, docs, nothing, reference):
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(1).alias("length"), F.lit("zz").alias("insert")), F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("insert")))
    rows = edit_counts.count_edits(docs.withColumn("edits", edits), BPE).collect()
    assert len(rows) == 3 * docs.count()
    text = dict(docs.select("doc_id", "text").collect())[0]
    assert [r["n_tokens"] for r in sorted((r for r in rows if r["doc_id"] == 0), key=lambda r: r["edit"])] == [len(reference(text)), *[len(reference(text[:2] + "zz" + text[3:]))] * 2]
    assert edit_counts.count_edits(nothing.withColumn("edits", edits), BPE).count() == 0


@pytest.fixture(scope="module")
def unigram():
    return Unigram.from_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_unigram_equals_the_library(unigram):
    known = [(p.replace(MARKER, " ") or f"<<{i}>>", float(s) if p else -1e4) for i, (p, s) in enumerate(zip(unigram.pieces, unigram.scores, strict=True))]
    for b, i in enumerate(unigram.byte_ids):
        known[i] = (f"<0x{b:02X}>", -1e4)
    other = Tokenizer(models.Unigram(known, 0, True))
    total = lambda ids: sum(unigram.scores[i] for i in ids if unigram.pieces[i])
    texts = ["the quick brown fox", "Éeauouon les mots", "a  b   c", "zz日本x", "internationalisation of things\nand more"]
    for text, ids in zip(texts, unigram.encode(pa.array(texts)), strict=True):
        theirs = other.encode(" " + text).ids
        assert abs(total(ids) - total(theirs)) < 1e-6
        assert sum(not unigram.pieces[i] for i in ids) == sum(not unigram.pieces[i] for i in theirs)


def test_unigram_best_score_by_brute_force(unigram):
    piece = {unigram.pieces[i].replace(MARKER, " "): unigram.scores[i] for i in unigram.known}
    for text, ids in zip(["hello wor", "an unkn日", "éaux le"], unigram.encode(pa.array(["hello wor", "an unkn日", "éaux le"])), strict=True):
        text = " " + text
        best = [0.0] + [-1e9] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                s = piece.get(text[i:j], unigram.unknown if j == i + 1 else -1e9)
                best[j] = max(best[j], best[i] + s)
        unknown = sum(len(c.encode()) for c in text if c not in piece)
        mine = sum(unigram.scores[i] for i in ids if unigram.pieces[i]) + unigram.unknown * sum(c not in piece for c in text)
        assert abs(mine - best[-1]) < 1e-6 and unknown == sum(not unigram.pieces[i] for i in ids)


def test_unigram_round_trip(unigram, docs, nothing):
    texts = [t for t in odd_texts() if t is not None] + ["▁ ▁▁", "<0x41>", "\x00"]
    for text, ids in zip(texts, unigram.encode(pa.array(texts)), strict=True):
        assert unigram.decode(ids) == text
    back = decode(encode(docs.withColumn("was", F.coalesce("text", F.lit(""))), unigram), unigram)
    assert back.where("text <> was or text is null").count() == 0 and back.count() == docs.count()
    assert encode(nothing, unigram).count() == 0
