"""Entity resolution: tax ids, exact names, contained words and aliases, as rules in turn over what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions import address as A

Rule = Callable[[DataFrame], DataFrame]


def _grams(text: Column) -> Column:
    """All pieces of one to three characters of a text, once each."""
    def of(n: int) -> Column:
        ends = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(ends, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _pieces(word: Column) -> Column:
    """The pieces of three characters of a word, or a shorter word itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(word, i, F.lit(3)))


def by_sorting(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, by sorting both.

    Sizes that are guessed from files know nothing of exploded pieces and repeated words, so a
    join that is left to them may send gigabytes through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def contained(texts: DataFrame, words: DataFrame, on: str) -> DataFrame:
    """All pairs of a distinct text and a distinct array of words of one ``on`` in which every word is a substring of the text.

    ``texts`` has the tenant and text, ``words`` the tenant and an array of words; rows that
    repeat a text or its words are met once. A text holds all pieces of the words it
    contains, so both meet at the words' piece that the fewest texts of the tenant hold, and only
    these pairs are tested. An array without words or null matches nothing.
    """
    t, w = texts.select(on, "text").distinct(), words.select(on, "words").distinct()
    own = w.select(on, "words", F.explode(F.array_distinct(F.flatten(F.transform("words", _pieces)))).alias("gram"))
    held = t.select(on, "text", F.explode(_grams(F.col("text"))).alias("gram"))
    counts = held.groupBy(on, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = by_sorting(own, counts, [on, "gram"]).groupBy(on, "words").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("n"))
    pieces = own.groupBy(on, "words").agg(F.count(F.lit(1)).alias("n"))  # words with a piece that no text has match nothing
    rarest = by_sorting(rarest, pieces, [on, "words", "n"], "left_semi").select(on, "words", "gram")
    return by_sorting(rarest, held, [on, "gram"]).where(A.all_within(F.col("words"), F.col("text"))).select(on, "text", "words")


def by_tax_id(docs: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """doc_id and match_id by the first tax id of a document that a row of the tenant has; of several rows the smallest id.

    ``docs`` has tax_ids (digits, in order), ``dim`` match_id and tax_id (digits).
    """
    asked = docs.select(on, "doc_id", F.posexplode("tax_ids").alias("at", "tax_id"))
    hits = by_sorting(asked, dim.select(on, "match_id", "tax_id"), [on, "tax_id"])
    return hits.groupBy("doc_id").agg(F.min(F.struct("at", "match_id")).alias("m")).select("doc_id", "m.match_id")


def by_name(docs: DataFrame, dim: DataFrame, on: str, name: str = "name") -> DataFrame:
    """doc_id and match_id where the tenant has a row of the same name; blank names match nothing."""
    named = dim.where(F.col(name) != "").groupBy(on, name).agg(F.min("match_id").alias("match_id"))
    return by_sorting(docs, named, [on, name]).select("doc_id", "match_id")


def by_words(docs: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """doc_id, match_id and n_matches where a document's text holds all words of a row (match_id, words): the smallest id, and of how many rows."""
    rows = dim.groupBy(on, "words").agg(F.min("match_id").alias("match_id"), F.count(F.lit(1)).alias("n"))
    told = by_sorting(contained(docs, rows, on), rows, [on, "words"]).groupBy(on, "text").agg(F.min("match_id").alias("match_id"), F.sum("n").alias("n_matches"))
    return by_sorting(docs, told, [on, "text"]).select("doc_id", "match_id", "n_matches")


def by_alias(docs: DataFrame, aliases: DataFrame, on: str) -> DataFrame:
    """doc_id and match_id (of each way the smallest) where an alias equals the name, lies within the text, or holds all words of the name.

    ``aliases`` has one row for each alias: match_id, name, text and words.
    """
    same = by_name(docs, aliases, on)
    inside = by_words(docs, aliases, on).select("doc_id", "match_id")
    named = docs.select(on, "doc_id", A.tokens(A.tokens_text(F.col("name"))).alias("words"))
    texts = aliases.groupBy(on, "text").agg(F.min("match_id").alias("match_id"))
    around = by_sorting(contained(texts, named, on), texts, [on, "text"]).groupBy(on, "words").agg(F.min("match_id").alias("match_id"))
    return same.union(inside).union(by_sorting(named, around, [on, "words"]).select("doc_id", "match_id"))


def by_part_of_name(docs: DataFrame, dim: DataFrame, on: str, *, least: int = 5) -> DataFrame:
    """doc_id and match_id (of each way the smallest) where a row's name holds a document's name of ``least`` characters or more, or that holds the row's first ``least``.

    Names are normalised on both sides; blank ones match nothing.
    """
    long = docs.where(F.length("name") >= least).select(on, "doc_id", F.col("name").alias("text"), F.array("name").alias("words"))
    rows = dim.where(F.col("name") != "")
    names = rows.groupBy(on, F.col("name").alias("text")).agg(F.min("match_id").alias("match_id"))
    within = by_sorting(contained(names, long, on), names, [on, "text"]).groupBy(on, "words").agg(F.min("match_id").alias("match_id"))
    holds = by_words(long, rows.select(on, "match_id", F.array(F.substring("name", 1, least)).alias("words")), on)
    return by_sorting(long, within, [on, "words"]).select("doc_id", "match_id").union(holds.select("doc_id", "match_id"))


def in_turn(docs: DataFrame, rules: list[tuple[int, Rule]], settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, match_id and rule of the documents that a rule matches: each rule sees only what those before it left.

    Of several matches of one rule the smallest id is taken. ``settle`` writes a
    rule's result, so that no later rule computes it again.
    """
    found = None
    for number, rule in rules:
        left = docs if found is None else by_sorting(docs, found.select("doc_id"), "doc_id", "left_anti")
        mine = settle(rule(left).groupBy("doc_id").agg(F.min("match_id").alias("match_id")).withColumn("rule", F.lit(number)))
        found = mine if found is None else found.union(mine)
    return found
