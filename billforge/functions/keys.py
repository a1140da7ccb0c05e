"""Business keys, amounts, dates and tax ids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billforge.functions.address import let
from billforge.functions.text import js_trim

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
# Month names.
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")


def two_decimals(c: Column) -> Column:
    """Fixed two decimals of a double, without thousands separators."""
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))


def number_prefix(c: Column) -> Column:
    """The number that a text begins with, null without one."""
    return let(F.regexp_extract(c, _NUMBER, 0), lambda found: F.when(found != "", found.cast("double")))


def business_text(c: Column) -> Column:
    return F.lower(js_trim(F.coalesce(c, F.lit(""))))


def business_amount(c: Column) -> Column:
    """'n.nn' of an amount in es-AR, en-US or plain form; other texts trimmed and lower-cased."""

    def of(raw: Column, bare: Column) -> Column:
        comma = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        plain = F.when(bare.rlike(r"^[0-9.]+,[0-9]{1,2}$"), comma).otherwise(F.replace(bare, F.lit(","), F.lit("")))
        return F.coalesce(two_decimals(number_prefix(plain)), F.lower(raw))

    return let(js_trim(F.coalesce(c, F.lit(""))), lambda raw: let(js_trim(F.replace(raw, F.lit("$"), F.lit(""))), lambda bare: of(raw, bare)))


def extracted_amount(c: Column) -> Column:
    """Amount of a model's answer, to two decimals: every comma reads as a point."""
    bare = F.replace(F.regexp_replace(c, "[^0-9.,-]", ""), F.lit(","), F.lit("."))
    return two_decimals(number_prefix(bare)).cast("double")


def business_date(c: Column) -> Column:
    """ISO dates as they are; other known forms as ISO dates; other texts lower-cased. Known: month/day/year, 'Mon d, yyyy', ISO date-times."""
    raw = js_trim(F.coalesce(c, F.lit("")))
    forms = ("M/d/yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    parsed = F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) for f in forms))
    return F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw).otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lower(raw)))


def parsed_date(c: Column) -> Column:
    """The date of a text that business_date turns into one, else null."""
    told = business_date(c)
    return F.when(told.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), told.try_cast("date"))


def business_key(number: Column, tax_id: Column, due: Column, amount: Column) -> Column:
    """The four normalised parts joined by bars, null where all are empty; amounts and dates come as text."""
    return joined_key(business_text(number), business_text(tax_id), business_date(due), business_amount(amount))


def joined_key(*parts: Column) -> Column:
    joined = F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.nullif(joined, F.lit("|" * (len(parts) - 1)))


def stored_key(key: Column, content_hash: Column) -> Column:
    return F.coalesce(key, F.concat(F.lit("__hash__"), content_hash))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def tax_id(c: Column) -> Column:
    """Eleven digits as NN-NNNNNNNN-N, anything else trimmed, blank as null."""
    d = digits(c)
    dashed = F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 8), F.substring(d, 11, 1))
    return F.when(F.length(d) == 11, dashed).otherwise(F.nullif(js_trim(c), F.lit("")))


def usable_tax_ids(c: Column) -> Column:
    return F.filter(F.transform(c, digits), lambda x: F.length(x) >= 10)


_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# Fixed value: legal forms of companies, first match wins.
LEGAL_FORMS = r"s\.?r\.?l\.?|s\.?a\.?|s\.?a\.?s\.?|s\.?c\.?s?\.?|s\.?h\.?|ltda?\.?|e\.?i\.?r\.?l\.?|s\.?a\.?u\.?"


def provider_name(c: Column) -> Column:
    """Lower case without legal forms and punctuation, white space collapsed."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{_EDGE}({LEGAL_FORMS}){_EDGE}", " ")
    return js_trim(F.regexp_replace(F.regexp_replace(plain, "[.,_-]", " "), r"\s+", " "))


def client_number(c: Column) -> Column:
    """Leading zeros off, null where nothing is left."""
    return F.nullif(F.regexp_replace(c, "^0+", ""), F.lit(""))


def period_label(month: Column, year: Column) -> Column:
    return F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("/"), year.cast("string"))


def month_name(month: Column) -> Column:
    """The name of a month, null where it is null (element_at alone may take the last one then)."""
    return F.when(month.isNotNull(), F.element_at(F.array(*(F.lit(m) for m in MONTHS)), month))


def receipts_folder(building: Column, month: Column, year: Column) -> Column:
    """The folder of a receipt below the tenant's: the building and the period in capitals, or what stands for a missing one."""
    period = F.concat(F.upper(month_name(month)), F.lit(" "), year.cast("string"))
    return F.concat_ws("/", F.coalesce(building, F.lit("Sin Consorcio")), F.coalesce(period, F.lit("Sin Período")))


def pesos(c: Column) -> Column:
    """'$ 118.000,00'."""
    return F.concat(F.lit("$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a zero-based index below 18,278."""
    n = index + 1
    one = F.chr(F.lit(65) + F.pmod(n - 1, F.lit(26)))
    m = F.floor((n - 1) / 26)
    two = F.chr(F.lit(65) + F.pmod(m - 1, F.lit(26)))
    k = F.floor((m - 1) / 26)
    return F.when(m == 0, one).when(k == 0, F.concat(two, one)).otherwise(F.concat(F.chr(F.lit(64) + k), two, one))


def column_index(letters: Column) -> Column:
    upper = F.upper(js_trim(letters))
    return F.aggregate(F.filter(F.split(upper, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1
