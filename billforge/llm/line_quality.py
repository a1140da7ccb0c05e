"""Quality rules with cross-document line frequency (operator 6), in DataFrame operations only.

Lines are normalised (lower case, white space to single spaces) and hashed with
their host. A line in more than ``most_docs`` documents of one host is removed
from each of them, and a document left with less than ``least_percent`` of its
words is rejected. The base rules read one text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.llm.shared import cut, quoted

_SPACE = r"[\\x20\\x09-\\x0D]"  # inside a SQL string
_WORDS = f"filter(split(t, '{_SPACE}+'), w -> w <> '')"
_WINDOW = 8


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with column ``t`` (text, not null) and word_chars, n_symbols, n_dup_lines, n_words, n_repeat_words, base_failed.

    ``n_repeat_words`` counts the words in windows of eight words that occur twice
    or more in the text; windows are compared by 64-bit hashes.
    """
    kept = [c for c in docs.columns if c != "t"]
    words = docs.select(
        *kept,
        F.expr(_WORDS).alias("_w"),
        F.expr("length(t) - length(translate(t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr(f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_l"),
    )
    hashed = words.select(
        *kept,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.expr("aggregate(_w, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        F.expr("size(_l) - size(array_distinct(_l))").cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(_w) < {_WINDOW + 1}, cast(array() as array<bigint>), transform(sequence(1, size(_w) - {_WINDOW - 1}), i -> xxhash64(slice(_w, i, {_WINDOW}))))").alias("_h"),
    )
    ordered = hashed.select(
        *(c for c in hashed.columns if c != "_h"),
        F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, p: int>>), array_sort(transform(_h, (h, p) -> named_struct('h', h, 'p', p))))").alias("_s"),
    )
    placed = ordered.select(
        *(c for c in ordered.columns if c != "_s"),
        F.expr("array_sort(array_distinct(flatten(filter(zip_with(_s, slice(_s, 2, size(_s)), (a, b) -> if(a.h = b.h, array(a.p, b.p), cast(null as array<int>))), x -> x is not null))))").alias("_p"),
    )
    counted = placed.select(
        *(c for c in placed.columns if c != "_p"),
        F.expr(f"aggregate(_p, named_struct('last', -{_WINDOW}, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least({_WINDOW}, p - a.last)), a -> a.n)").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def line_keys(text: Column | str, host: Column | str) -> Column:
    """Per line with a word: its key (hash of host and normalised line) and its number of words."""
    text, host = (F.col(c) if isinstance(c, str) else c for c in (text, host))
    plain = F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))))
    return F.transform(
        F.filter(plain, lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(host, x).alias("key"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")),
    )


def _above(lines: DataFrame, most_docs: int) -> DataFrame:
    """Keys of ``lines`` (doc_id, key) in more than ``most_docs`` distinct documents.

    Distinct pairs are spread by both columns and counted before the keys meet, so
    that a line of very many documents sends one row for each task.
    """
    seen = lines.select("key", F.xxhash64("doc_id").alias("d")).distinct()
    return seen.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most_docs).select("key")


def _salted(own: DataFrame, above: DataFrame, by: Column, salts: int = 16) -> DataFrame:
    """The rows of ``own`` whose key is in ``above``, each key spread over ``salts`` tasks."""
    many = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.withColumn("salt", F.pmod(by, F.lit(salts)).cast("int")).join(many, ["key", "salt"])


def judge(docs: DataFrame, *, host: str = "source", most_docs: int = 20, least_percent: int = 30) -> DataFrame:
    """doc_id, the base columns, kept, n_removed_lines and n_removed_words of ``docs`` (doc_id, text and the host column).

    Every row yields a row, also where it repeats another or has a null id or
    host. Documents of a line are counted by distinct ids, rows without an id being
    one together; a null text has no words and fails the base rules. An empty
    table gives an empty result.
    """
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(host).alias("host"), t.alias("t"))
    #: equal rows share this key and get equal verdicts
    key = F.struct(F.xxhash64("doc_id", "host", "t").alias("a"), F.xxhash64(F.lit(1), "t", "host", "doc_id").alias("b"))
    ruled = cut(base_rules(rows.select("doc_id", key.alias("row"), line_keys("t", "host").alias("lines"), "t")))
    above = _above(ruled.select("doc_id", F.explode(F.array_distinct(F.col("lines.key"))).alias("key")), most_docs)
    own = ruled.select("row", "lines").dropDuplicates(["row"]).select("row", F.explode("lines").alias("l")).select("row", "l.key", "l.words")
    removed = _salted(own, above, F.col("row.a")).groupBy("row").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("lines"))
    out = ruled.drop("lines").join(removed, "row", "left")
    gone = F.coalesce(F.col("words"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * (F.col("n_words") - gone) >= least_percent * F.col("n_words"))).alias("kept"),
        F.coalesce(F.col("lines"), F.lit(0)).cast("long").alias("n_removed_lines"),
        gone.alias("n_removed_words"),
    )


def remove_lines(docs: DataFrame, *, host: str = "source", most_docs: int = 20) -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``; lines without a word stay, a null text stays null.

    Documents are counted as in judge; every row stays, columns may have any names.
    """
    row = docs.select(F.struct(*quoted(docs)).alias("row"))
    where = F.col("row").getField(host)
    key = F.struct(F.xxhash64("row.doc_id", where, "row.text").alias("a"), F.xxhash64(F.lit(1), "row.text", where, "row.doc_id").alias("b"))
    keyed = row.withColumn("same", key)
    own = keyed.select("same", F.col("row.doc_id").alias("doc_id"), F.explode(F.array_distinct(line_keys(F.col("row.text"), where)["key"])).alias("key"))
    above = _above(own, most_docs)
    gone = _salted(own.dropDuplicates(["same", "key"]), above, F.col("same.a")).groupBy("same").agg(F.collect_set("key").alias("gone"))

    def stays(line: Column) -> Column:
        norm = F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))
        return (norm == "") | ~F.array_contains("gone", F.xxhash64(where, norm))

    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), stays), "\n"))
    cut_ = keyed.join(gone, "same", "left").withColumn("text", text)
    return cut_.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
