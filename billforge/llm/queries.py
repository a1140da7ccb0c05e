"""The registered queries of the llm operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billforge.llm.oracles import filter_audit_sql, merkle_sql
from billforge.llm.shared import cut


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.packing import pack, tokenize

    pieces = tokenize(_read(spark, sf_dir, "documents"), tokenizer_path())
    lengths = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(lengths).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.toxicity import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a replacement, a deletion and an insertion."""
    from billforge.llm.edit_counts import count_edits

    n = F.length("text")
    edits = F.array(
        F.struct((n / 3).cast("int").alias("start"), F.lit(12).alias("length"), F.concat(F.lit(" "), "source", F.lit("'s "), "lang").alias("insert")),
        F.struct((n / 2).cast("int").alias("start"), F.lit(40).alias("length"), F.lit("").alias("insert")),
        F.struct((n * 3 / 4).cast("int").alias("start"), F.lit(0).alias("length"), F.concat(F.lit("\n"), "lang", F.lit(" 2024, "), "source").alias("insert")),
    )
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return count_edits(docs, tokenizer_path())


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.warc_derivatives import build, responses

    records = build(responses(_read(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "concurrent_to", F.crc32("block").alias("block_crc32"))


def op5_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    from billforge.llm.sentencepiece_unigram import Unigram, decode, encode

    model = Unigram.from_model(tokenizer_path("piece_bpe_32k.model"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(docs.withColumn("text_crc32", F.crc32("text")), model)
    return decode(encoded, model).select("doc_id", "n_tokens", "n_byte_tokens", F.crc32("ids").alias("ids_crc32"), (F.crc32("text") == F.col("text_crc32")).alias("round_trip"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.line_quality import judge

    return judge(_read(spark, sf_dir, "documents"))


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments among recordings that play the vectors of ``embeddings``."""
    from billforge.llm.chroma import fingerprints, render, search

    return search(cut(fingerprints(render(_read(spark, sf_dir, "embeddings")))))


def op8_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm import pii

    docs = _read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.substring_dedup import find_repeats

    return find_repeats(_read(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.jaccard_join import link_components

    return link_components(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.merkle import audit

    return audit(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.filter_audit import audit

    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billforge.llm.language_id import identify

    return identify(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity_nnpu,
        op3_edit_aware_counts,
        op4_warc_derivatives,
        op5_sentencepiece_unigram,
        op6_line_frequency,
        op7_chroma_fingerprints,
        op8_pii_bilstm_crf,
        op9_compact_windows,
        op10_ngram_jaccard_join,
        op11_merkle_manifest,
        op12_filter_audit,
        op13_language_codes,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": merkle_sql(),
    "op12_filter_audit": filter_audit_sql(),
    "op6_line_frequency": r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w) AS x),
 twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) AS x WHERE n > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS r(j) GROUP BY 1),
 line AS (SELECT doc_id, source, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l FROM (SELECT doc_id, source, unnest(ls) AS l FROM w) AS x),
 above AS (SELECT source, l FROM line GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20),
 gone AS (SELECT doc_id, count(*) AS n, sum(length(l) - length(replace(l, ' ', '')) + 1) AS nw FROM line JOIN above USING (source, l) GROUP BY 1),
 b AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_lines, CAST(coalesce(gone.nw, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept, n_removed_lines, n_removed_words FROM b""",
}
