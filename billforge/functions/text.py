"""Text cleaning, document routing and line rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's trim and \s have it.
JS_SPACE = r"[\t\n\x0B\f\r\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_JS_SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Keywords that mark a utility bill (any of them), in upper case.
UTILITY_WORDS = (
    "LIQUIDACIÓN DE SERVICIOS PÚBLICOS", "LIQUIDACION DE SERVICIOS PUBLICOS", "LSP ", "EMPRESA DISTRIBUIDORA",
    "METROGAS", "AYSA", "AY.S.A", "AGUA Y SANEAMIENTOS", "EDESUR", "EDENOR", "NATURGY", "CAMUZZI", "LITORAL GAS",
    "ABSA", "PERSONAL", "TELECOM",
)
# Label of the first company whose words are found, in order; words joined by + must all be there.
COMPANY_WORDS = (
    ("EDESUR", ("EDESUR",)),
    ("EDENOR", ("EDENOR",)),
    ("AYSA", ("AYSA", "AY.S.A", "AGUA Y SANEAMIENTOS")),
    ("METROGAS", ("METROGAS",)),
    ("NATURGY", ("NATURGY",)),
    ("CAMUZZI", ("CAMUZZI",)),
    ("LITORAL_GAS", ("LITORAL GAS",)),
    ("ABSA", ("ABSA", "AGUAS+ARGENTINAS")),
    ("PERSONAL", ("PERSONAL", "TELECOM")),
)
# Display names of companies that no master row names.
COMPANY_NAMES = {
    "EDESUR": "EDESUR S.A.", "EDENOR": "EDENOR S.A.", "AYSA": "AYSA", "METROGAS": "METROGAS S.A.",
    "NATURGY": "NATURGY BAN S.A.", "CAMUZZI": "CAMUZZI GAS PAMPEANA S.A.", "LITORAL_GAS": "LITORAL GAS S.A.",
    "ABSA": "ABSA", "PERSONAL": "PERSONAL",
}
ROUTED_CHARS = 4000
PROMPT_LINES = 80


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_JS_SPACES))


def clean_text(c: Column) -> Column:
    """Carriage returns to newlines, three or more newlines to two, tabs and runs of spaces to one space, trimmed."""
    c = F.replace(c, F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    return js_trim(c)


def _holds(c: Column, word: str) -> Column:
    out = F.lit(True)
    for w in word.split("+"):
        out = out & c.contains(w)
    return out


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | _holds(c, w)
    return out


def is_utility_bill(c: Column) -> Column:
    """Whole text where it has no lower-case letter, else its first 4000 characters."""
    upper = F.when(c == F.upper(c), c).otherwise(F.upper(F.substring(c, 1, ROUTED_CHARS)))
    return _any(upper, (*UTILITY_WORDS, "AGUAS+ARGENTINAS"))


def utility_company(c: Column) -> Column:
    """Label of the company that issued the bill, GENERIC_LSP for an unknown one, null for any other text."""
    head = F.upper(F.substring(F.coalesce(c, F.lit("")), 1, ROUTED_CHARS))
    label = F.when(~_any(head, (*UTILITY_WORDS, "AGUAS+ARGENTINAS")), F.lit(None))
    for name, words in COMPANY_WORDS:
        label = label.when(_any(head, words), name)
    return label.otherwise("GENERIC_LSP")


def company_name(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in COMPANY_NAMES.items() for x in kv))[label]


def relevant_lines(c: Column, most: int = PROMPT_LINES) -> Column:
    lines = F.transform(F.split(F.replace(c, F.lit("\r"), F.lit("\n")), "\n"), js_trim)
    return F.array_join(F.slice(F.filter(lines, lambda x: x != ""), 1, most), "\n")


def plain_lines(c: Column) -> Column:
    """Lines with white space collapsed, blank ones left out."""
    lines = F.split(F.replace(c, F.lit("\r"), F.lit("\n")), "\n")
    return F.filter(F.transform(lines, lambda x: js_trim(F.regexp_replace(x, f"{JS_SPACE}+", " "))), lambda x: x != "")


def is_numeric_line(c: Column) -> Column:
    return F.regexp_replace(c, f"{JS_SPACE}+", "").rlike(r"^[0-9./-]+$")


# Fixed value: first words of lines that describe the bill.
METADATA_WORDS = (
    r"cuit|iva|fecha|cae|comprobante|subtotal|total|domicilio|condici[oó]n|ingresos|inicio|punto de venta|c[oó]digo|regimen|otros impuestos|hys"
)


def is_metadata_line(c: Column) -> Column:
    return c.rlike(f"(?i)^({METADATA_WORDS})(?![A-Za-z0-9_])")


def has_letters(c: Column) -> Column:
    return c.rlike("[A-Za-zÁÉÍÓÚáéíóúÑñ]")


def is_generic_building(c: Column) -> Column:
    """Missing, or only the words for an owners' association."""
    plain = F.lower(js_trim(F.regexp_replace(F.regexp_replace(c, "[.,:;]+", " "), f"{JS_SPACE}+", " ")))
    return F.coalesce((c == "") | plain.rlike(r"^(cons|consorcio)(\s+de)?\s+prop(ietarios)?$"), F.lit(True))


def building_from_lines(lines: Column) -> Column:
    """The value of the first line that names a business ("...social...:"); a generic value gets the next telling line of seven."""

    def value(x: Column) -> Column:
        return js_trim(F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), r"(?i)^raz.{0,2}n\s*social\s*:\s*", ""))

    found = F.transform(lines, lambda x, i: F.struct(F.when(F.lower(x).contains("social") & x.contains(":"), value(x)).alias("v"), i.alias("i")))
    first = F.try_element_at(F.filter(found, lambda s: s["v"] != ""), F.lit(1))
    near = F.filter(F.slice(lines, first["i"] + 2, 7), lambda x: ~is_metadata_line(x) & ~is_numeric_line(x) & has_letters(x))
    more = F.try_element_at(near, F.lit(1))
    return F.when(first.isNotNull() & is_generic_building(first["v"]), F.concat_ws(" ", first["v"], more)).otherwise(first["v"])


# The prompt that each company's bills get; bills of other companies get 'utility', other texts 'invoice'.
PROMPTS = {"EDESUR": "edesur", "EDENOR": "edenor", "AYSA": "aysa", "METROGAS": "gas", "NATURGY": "gas", "CAMUZZI": "gas", "LITORAL_GAS": "gas", "PERSONAL": "personal"}


def prompt_name(text: Column) -> Column:
    """Which of the seven prompts a text is sent with."""
    company = utility_company(text)
    out = F.when(company.isNull(), "invoice")
    for label, prompt in PROMPTS.items():
        out = out.when(company == label, prompt)
    return out.otherwise("utility")


def prompt(text: Column, templates: Column) -> Column:
    """The template of the text's prompt (``templates`` is a map by name, kept as configuration) and the text's telling lines below it."""
    return F.concat_ws("\n", F.try_element_at(templates, prompt_name(text)), relevant_lines(text))
