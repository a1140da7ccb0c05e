"""Short forms of ids, texts, errors and durations as they are shown or stored, as Column expressions. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billforge.functions.text import js_trim


def _ends(c: Column, most: int, kept: int, between: str) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, kept), F.lit(between), F.right(c, F.lit(kept))))


def short_id(c: Column) -> Column:
    return _ends(c, 10, 4, "…")


def short_hash(c: Column) -> Column:
    return _ends(c, 12, 6, "...")


def shortened(c: Column, most: int) -> Column:
    """The first ``most`` characters, with three points where more follow."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def short_key(c: Column) -> Column:
    return shortened(c, 70)


def duration(ms: Column) -> Column:
    """'250ms', '42s' or '3m 5s' of milliseconds."""
    s = F.floor(ms / 1000)
    long = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(long)


def run_millis(started: Column, ended: Column) -> Column:
    """Milliseconds between two times, none where the end comes first."""
    return F.greatest(F.unix_millis(ended) - F.unix_millis(started), F.lit(0))


def compact_error(message: Column) -> Column:
    """The first line of an error in 220 characters, after its HTTP code where it names one in brackets."""
    line = js_trim(F.element_at(F.split(message, "\n"), 1))
    code = F.regexp_extract(line, r"\[([0-9]{3})\s", 1)
    return F.when(code != "", F.concat(F.lit("HTTP "), code, F.lit(": "), shortened(line, 220))).otherwise(shortened(line, 220))


def vendor_of_model(model: Column) -> Column:
    """The vendor that a model's name tells, 'unknown' for others."""
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(m.contains("gemini"), "gemini").when(m.contains("gpt") | m.contains("o1") | m.contains("o3"), "openai").otherwise("unknown")


def or_default(link: Column, default: Column) -> Column:
    """A trimmed link, or the default where it is null or blank."""
    return F.coalesce(F.nullif(js_trim(link), F.lit("")), default)


def manual_hash(*parts: Column) -> Column:
    """sha256 of 'manual' and the parts joined by colons, nulls as empty; the caller gives the clock as a part."""
    return F.sha2(F.concat_ws(":", F.lit("manual"), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def shown_amount(c: Column) -> Column:
    """'$ 1.234,50' with a no-break space, a minus sign in front, and a dash for none."""
    grouped = F.translate(F.format_number(F.abs(c.cast("double")), 2), ",.", ".,")
    return F.coalesce(F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$ "), grouped), F.lit("—"))


def shown_date(c: Column) -> Column:
    """'5/3/2024' of a date, a dash for none."""
    return F.coalesce(F.date_format(c, "d/M/yyyy"), F.lit("—"))


def input_date(iso: Column) -> Column:
    return F.substring(F.coalesce(iso, F.lit("")), 1, 10)
