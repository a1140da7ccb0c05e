"""Runs' summaries as stored JSON: both shapes read, added up, logged, counted and spread into usage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions import shown as S
from billforge.functions.address import let
from billforge.operators.jobs import is_quota_error, trimmed_error

# The counts of a summary.
COUNTS = {
    "total_found": "totalFound", "processed": "processed", "skipped": "skipped",
    "failed": "failed", "unassigned": "unassigned", "duplicates": "duplicatesDetected",
}
TOKENS = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "total_tokens": "totalTokens"}
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _number(v: Column | str, path: str) -> Column:
    """A number, a text that is one, or true as 1; 0 for anything else."""
    x = F.try_variant_get(v, path, "double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0)).cast("long")


def _text(v: Column, path: str, default: str) -> Column:
    return F.when(_kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")).otherwise(default)


def _tokens(v: Column) -> Column:
    """The three counts of a breakdown's entry; a bare number, as older runs stored it, is the total."""
    bare = F.struct(F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), _number(v, "$").alias("total_tokens"))
    return F.when(_kind(v).rlike(_NUMBER), bare).when(_kind(v).startswith("OBJECT"), F.struct(*(_number(v, f"$.{t}").alias(n) for n, t in TOKENS.items())))


def _breakdown(v: Column, name: str) -> Column:
    entries = F.try_variant_get(v, f"$.tokenUsage.{name}", "map<string,variant>")
    entries = F.map_filter(F.transform_values(entries, lambda _, e: _tokens(e)), lambda _, e: e.isNotNull())
    return F.coalesce(entries, F.create_map().cast("map<string,struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>"))


def with_summary(rows: DataFrame, json: str, summary: str = "summary") -> DataFrame:
    """``rows`` with a stored summary as a struct instead of its text, null where that is no JSON object; missing and odd counts are 0."""

    def told(v: Column) -> Column:
        errors = F.filter(F.coalesce(F.try_variant_get(v, "$.errors", "array<variant>"), F.array().cast("array<variant>")), lambda e: _kind(e).rlike("^(OBJECT|ARRAY)"))
        errors = F.transform(errors, lambda e: F.struct(_text(e, "$.fileId", "unknown").alias("file_id"), _text(e, "$.fileName", "unknown").alias("file_name"), _text(e, "$.error", "Unknown error").alias("error")))
        fields = [_number(v, f"$.{t}").alias(n) for n, t in COUNTS.items()] + [_number(v, f"$.tokenUsage.{t}").alias(n) for n, t in TOKENS.items()]
        read = F.struct(*fields, errors.alias("errors"), _breakdown(v, "byProvider").alias("by_provider"), _breakdown(v, "byModel").alias("by_model"))
        return F.when(_kind(v).startswith("OBJECT"), read)

    return rows.withColumn(summary, let(F.try_parse_json(json), told)).drop(json)  # a text is parsed once


def added_up(rows: DataFrame, summary: str) -> DataFrame:
    """One row: how many rows have a summary, and the sums of its counts, tokens and errors."""
    s = rows.where(F.col(summary).isNotNull())
    sums = [F.coalesce(F.sum(f"{summary}.{n}"), F.lit(0)).alias(n) for n in (*COUNTS, *TOKENS)]
    return s.agg(F.count(F.lit(1)).alias("n_summaries"), *sums, F.coalesce(F.sum(F.size(f"{summary}.errors")), F.lit(0)).cast("long").alias("n_errors"))


def folded(rows: DataFrame, summary: str, order: list[str]) -> DataFrame:
    """One row with the sums of all summaries, maps and errors included: counts and tokens, by_provider and by_model added
    up entry by entry, and the errors of all in the ``order`` of their rows.

    Entries are added up by their name before maps are made of them. Errors are one list, as in a summary: their number is that of failed files.
    """
    s = rows.where(F.col(summary).isNotNull())
    out = added_up(rows, summary)
    for name in ("by_provider", "by_model"):
        entry = s.select(F.explode(F.map_entries(f"{summary}.{name}")).alias("e"))
        sums = entry.groupBy("e.key").agg(*(F.sum(f"e.value.{t}").alias(t) for t in TOKENS))
        pairs = sums.agg(F.array_sort(F.collect_list(F.struct("key", F.struct(*TOKENS).alias("value")))).alias("m"))
        out = out.join(pairs.select(F.map_from_entries("m").alias(name)))
    listed = s.select(F.struct(*order).alias("o"), F.posexplode(f"{summary}.errors").alias("i", "e"))
    errors = listed.agg(F.array_sort(F.collect_list(F.struct("o", "i", "e"))).alias("l"))
    return out.join(errors.select(F.transform("l", lambda x: x["e"]).alias("errors")))


# The vendors whose quota is told, and the words in an error that name each.
QUOTA_VENDORS = {"gemini": ("gemini", "generativelanguage"), "openai": ("openai",)}
USED = "Consumo detectado en la ultima ejecucion."


def quota_patch(summary: Column, error: Column) -> Column:
    """By vendor, the status and note that a run leaves: map of vendor to struct<status, note>.

    Of a run with a summary: usage says 'ok', and after it each error of an exhausted
    quota that names the vendor says 'limited', the last one with its text. Of a run without one its error does, where it names
    the vendor itself. A vendor that nothing is said of has no entry.
    """

    def last_error(words: tuple[str, ...]) -> Column:
        named = F.filter(summary["errors"], lambda e: is_quota_error(e["error"]) & _names(e["error"], words))
        return F.try_element_at(named, F.lit(-1))["error"]

    def patch(vendor: str, words: tuple[str, ...]) -> Column:
        used = F.coalesce(F.try_element_at(summary["by_provider"], F.lit(vendor))["total_tokens"] > 0, F.lit(False))
        said = F.when(summary.isNotNull(), last_error(words)).when(is_quota_error(error) & _names(error, (vendor,)), error)
        status = F.when(said.isNotNull(), "limited").when(used, "ok")
        note = F.when(said.isNotNull(), trimmed_error(said)).when(used, USED)
        return F.when(status.isNotNull(), F.struct(F.lit(vendor).alias("key"), F.struct(status.alias("status"), note.alias("note")).alias("value")))

    return F.map_from_entries(F.array_compact(F.array(*(patch(v, w) for v, w in QUOTA_VENDORS.items()))))


def _names(message: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(message).contains(w)
    return out


def quota_states(log: DataFrame, by: str, summary: str, error: str, order: list[str]) -> DataFrame:
    """by, vendor, status and note after all runs of ``log``: for each vendor what the last run says that says something."""
    said = log.select(by, F.struct(*order).alias("o"), F.explode(quota_patch(F.col(summary), F.col(error))).alias("vendor", "p"))
    return said.groupBy(by, "vendor").agg(F.max_by("p", "o").alias("p")).select(by, "vendor", "p.status", "p.note")


def usage_rows(rows: DataFrame, summary: str) -> DataFrame:
    """``rows`` once for each metered count of their summary: grain, provider, model and the three token counts.

    The aggregate has a row only where its total is above 0; a model's provider is
    told by its name. Rows without a summary give none.
    """

    def row(grain: str, provider: Column, model: Column, of: Column) -> Column:
        return F.struct(F.lit(grain).alias("grain"), provider.alias("provider"), model.cast("string").alias("model"), *(of[t].alias(t) for t in TOKENS))

    def told(s: Column) -> Column:
        whole = F.when(s["total_tokens"] > 0, F.array(row("aggregate", F.lit("aggregate"), F.lit(None), s)))
        by_provider = F.transform(F.map_entries(s["by_provider"]), lambda e: row("provider", e["key"], F.lit(None), e["value"]))
        by_model = F.transform(F.map_entries(s["by_model"]), lambda e: row("model", S.vendor_of_model(e["key"]), e["key"], e["value"]))
        return F.when(s.isNotNull(), F.concat(F.coalesce(whole, F.slice(by_provider, 1, 0)), by_provider, by_model))

    return rows.select(*(c for c in rows.columns if c != summary), F.explode(let(F.col(summary), told)).alias("_u")).select(*(c for c in rows.columns if c != summary), "_u.*")


def counters(log: DataFrame, by: str, summary: str, at: Column, *, stored: DataFrame | None = None) -> DataFrame:
    """Counters of each ``by`` after the runs of ``log`` (with trigger and error) were added to the ``stored`` ones.

    The last trigger and error are those of the largest ``at``; a run without a
    summary counts as a run and adds nothing else. Sums are combined before they are shuffled.
    """
    names = ("total_runs", *COUNTS, *TOKENS)
    sums = [F.count(F.lit(1)).alias("total_runs")] + [F.coalesce(F.sum(f"{summary}.{n}"), F.lit(0)).alias(n) for n in names[1:]]
    last = F.max_by(F.struct("trigger", "error"), at)
    new = log.groupBy(by).agg(*sums, last.alias("_last")).select(by, *names, F.col("_last.trigger").alias("last_trigger"), F.col("_last.error").alias("last_error"))
    if stored is None:
        return new
    n, o = new.withColumn("_new", F.lit(True)).alias("n"), stored.alias("o")
    plus = [(F.coalesce(F.col(f"n.{c}"), F.lit(0)) + F.coalesce(F.col(f"o.{c}"), F.lit(0))).alias(c) for c in names]
    told = [F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("last_trigger", "last_error")]
    return n.join(o, by, "full").select(by, *plus, *told)
