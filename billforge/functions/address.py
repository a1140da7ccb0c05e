"""Building names and street addresses as Column expressions.

Word edges are ASCII, as in the data's own rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billforge.functions.text import js_trim

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Openings of owners' associations, taken off in this order.
PREFIXES = (
    r"^\s*CONSORCIO\s+DE\s+COPROPIETARIOS\b[\s.:,-]*", r"^\s*CONSORCIO\s+DE\s+PROPIETARIOS\b[\s.:,-]*",
    r"^\s*CONSORCIO\s+COPROPIETARIOS\b[\s.:,-]*", r"^\s*CONSORCIO\s+PROPIETARIOS\b[\s.:,-]*",
    r"^\s*CONS\.\s*COPROPIET\.?\b[\s.:,-]*", r"^\s*CONS\.\s*PROPIET\.?\b[\s.:,-]*", r"^\s*CONS\.\s*PROP\.?\b[\s.:,-]*",
    r"^\s*CONSORCIO\s+CALLE\b[\s.:,-]*", r"^\s*CONSORCIO\b[\s.:,-]*",
)
# Abbreviations in street names; a trailing point is optional but for those marked with !.
ABBREVIATIONS = (
    ("ALMTE", "ALMIRANTE"), ("GRAL", "GENERAL"), ("GRL", "GENERAL"), ("CNEL", "CORONEL"), ("CORONEL", "CORONEL"),
    ("DR", "DOCTOR"), ("ING", "INGENIERO"), ("PRES", "PRESIDENTE"), ("STA", "SANTA"), ("STO", "SANTO"), ("SAN!", "SAN"),
    ("BV", "BOULEVARD"), ("HNOS", "HERMANOS"), ("GOB", "GOBERNADOR"), ("TTE", "TENIENTE"), ("CAP", "CAPITAN"),
    ("MARTIN!", "MARTIN"), ("SGTO", "SARGENTO"), ("CTE", "COMANDANTE"), ("INT", "INTENDENTE"), ("PROF", "PROFESOR"),
)
# Kinds of streets, and words between street and number.
STREET_KIND = r"^\s*(?:AV(?:DA?)?|AVENIDA|CALLE|BLVD|BOULEVARD|DIAGONAL|DIAG|PASAJE|PJE|RUTA|RN|RPC|AUTOPISTA|ACCESO|CAMINO|COSTANERA)\.?\s+"
NOISE = r"\b(?:NUMEROS?|N[RU]OS?\.?|N[º°]\.?|NUM\.?)\s*"
# Postal codes with what follows, localities, floors and units.
POSTAL = (
    r"\s+[A-Z][0-9]{4}[A-Z]{3}\b.*$", r"\s+[0-9]{4}\s+(CAPITAL|BUENOS|CABA|CAPI)\b.*$",
    r"\s+(CAPITAL\s+FEDERAL|CABA|BUENOS\s+AIRES|BS\.?\s*AS\.?)$",
)
FLOOR = (
    r"\s+(?:PB|PA|EP|SS|PISO\s*[0-9]*|P\s*[0-9]+|DPTO\.?\s*[A-Za-z0-9_]*|DTO\.?\s*[A-Za-z0-9_]*|UF\.?\s*[0-9]*|UNID\.?\s*[A-Za-z0-9_]*)(?:\s+[A-Z])?$",
    r"\s+[0-9]{1,2}\s+[A-Z]$",
)
LEADING_ZEROS = r"\b0+([0-9]+)\b"
SUFFIX = r"^(.+\s[0-9]{1,5})\s+[0-9]{1,3}$"


def abbreviation_patterns() -> list[tuple[str, str]]:
    return [(rf"\b{short.rstrip('!')}\b" if short.endswith("!") else rf"\b{short}\.?\b", full) for short, full in ABBREVIATIONS]


def let(c: Column, body) -> Column:
    """``body`` of ``c``, which is evaluated once however often the body names it; the optimiser doesn't fold it back."""
    return F.element_at(F.transform(F.array(c), body), 1)


def sub(c: Column, pattern: str, by: str = "") -> Column:
    """Replace all matches, regardless of case; \\b is an ASCII word edge."""
    return F.regexp_replace(c, "(?i)" + pattern.replace(r"\b", _EDGE), by)


def spaced(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, r"\s+", " "))


def without_prefix(c: Column) -> Column:
    for p in PREFIXES:
        c = sub(c, p)
    return js_trim(c)


def expanded(c: Column) -> Column:
    for p, full in abbreviation_patterns():
        c = sub(c, p, full)
    return spaced(c)


def without_zeros(c: Column) -> Column:
    return sub(c, LEADING_ZEROS, "$1")


def building_name(raw: Column) -> Column:
    """Street and number in upper case, '' for a blank name; a name without a number loses its street kind only.

    Applying it twice may take off more, so normalise once.
    """
    def told_name(name: Column) -> Column:
        for p in POSTAL:
            name = sub(name, p)
        name = js_trim(name)
        for p in FLOOR:
            name = sub(name, p)
        return sub(js_trim(name), SUFFIX, "$1")

    def parts(name: Column, kindless: Column) -> Column:
        return let(
            F.struct(js_trim(sub(kindless, NOISE)).alias("told"), F.when(kindless != "", kindless).otherwise(name).alias("rest")),
            lambda x: let(
                F.struct(spaced(F.regexp_extract(x["told"], r"^(.*?)([0-9][0-9/-]*)", 1)).alias("street"), F.regexp_extract(x["told"], r"^(.*?)([0-9]+)[0-9/-]*", 2).alias("number"), x["rest"].alias("rest")),
                lambda y: F.when((y["street"] != "") & (y["number"] != ""), F.concat(y["street"], F.lit(" "), y["number"])).otherwise(spaced(y["rest"])),
            ),
        )

    start = js_trim(F.coalesce(raw, F.lit("")))
    full = let(start, lambda s: let(without_prefix(s), lambda bare: F.when(bare != "", bare).otherwise(s)))
    return F.upper(let(told_name(without_zeros(expanded(full))), lambda name: let(js_trim(sub(name, STREET_KIND)), lambda kindless: parts(name, kindless))))


def tokens_text(c: Column) -> Column:
    return spaced(F.regexp_replace(F.upper(c), r"[^A-ZÁÉÍÓÚÑ0-9\s]", " "))


def match_text(c: Column) -> Column:
    """A name as the substring match reads it."""
    return tokens_text(without_zeros(expanded(c)))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def all_within(words: Column, text: Column) -> Column:
    """Whether every word is a substring of the text; true without words."""
    return F.forall(words, lambda w: text.contains(w))


def packed_list(c: Column) -> Column:
    """The trimmed, non-blank parts of a list packed with bars."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), js_trim), lambda x: x != "")
