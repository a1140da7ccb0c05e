"""Tenants' configs as JSON: folder diagnosis, sparse patches, and the ranges of request fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billforge.functions.address import let
from billforge.functions.secret import decrypted
from billforge.functions.text import js_trim

# The fields of a patch: kind, least and most (of a number, or of a text's length), and whether null is a value.
PATCH_RULES = {
    "name": ("text", 2, None, False), "isActive": ("flag", None, None, False), "consortiumsEnabled": ("flag", None, None, False),
    "batchSize": ("whole", 1, 500, False), "intervalMinutes": ("whole", 1, 1440, False), "sheetsId": ("text", 10, None, False),
    "altaSheetsId": ("text", 10, None, True), "sheetName": ("text", 1, None, False), "googleProjectId": ("text", 2, None, False),
    "googleClientEmail": ("mail", None, None, False), "googlePrivateKey": ("text", 50, None, False), "driveFolderPending": ("text", 5, None, False),
    "driveFolderScanned": ("text", 5, None, False), "driveFolderUnassigned": ("text", 0, None, True), "driveFolderFailed": ("text", 0, None, True),
    "driveFolderReceipts": ("text", 0, None, True), "geminiApiKey": ("text", 10, None, True), "openaiApiKey": ("text", 10, None, True),
}
MAIL = r"(?i)^(?!\.)(?!.*\.\.)([A-Z0-9_'+\-.]*)[A-Z0-9_+\-]@([A-Z0-9][A-Z0-9-]*\.)+[A-Z]{2,}$"


def no_entries() -> Column:
    return F.create_map().cast("map<string,string>")


def as_map(json: Column) -> Column:
    """A JSON object's entries as texts; other texts and nulls have none."""
    return F.coalesce(F.from_json(json, "map<string,string>"), no_entries())


def patched(base: Column, patch: Column) -> Column:
    """``base`` with the entries of ``patch`` over it; a null there takes the entry out."""
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(rest, F.map_filter(patch, lambda _, v: v.isNotNull()))


def folder_issues(json: Column) -> Column:
    """The issues of a folder config, in order: no_folders, and for pending and scanned missing or invalid ('.'), or same_folder."""
    m = as_map(json)
    pending, scanned = (js_trim(F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(""))) for n in ("pending", "scanned"))

    def of(c: Column, name: str) -> Column:
        return F.when(c == "", f"{name}_missing").when(c == ".", f"{name}_invalid")

    same = F.when((pending != "") & (pending == scanned), "same_folder")
    return F.array_compact(F.array(F.when(json.isNull(), "no_folders"), of(pending, "pending"), of(scanned, "scanned"), same))


def violations(body: Column, rules: dict[str, tuple] = PATCH_RULES) -> Column:
    """Names, in alphabetical order, of the fields of a JSON object that break their rule.

    A field that isn't given breaks none, a null only where null is no value, and
    a value of another kind always does; whole numbers may be written with a zero
    fraction. A text that is no JSON object breaks 'body'.
    """

    def broken(x: Column, name: str, kind: str, least: int | None, most: int | None, nullable: bool) -> Column:
        is_null = F.coalesce(F.is_variant_null(x), F.lit(False))
        told = F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
        text, number = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
        if kind == "flag":
            ok = told == "BOOLEAN"
        elif kind == "whole":
            ok = told.rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$") & let(number, lambda y: (y == F.floor(y)) & y.between(least, most))
        elif kind == "mail":
            ok = (told == "STRING") & text.rlike(MAIL)
        else:
            ok = (told == "STRING") & (F.length(text) >= least)
        return F.when(x.isNull(), None).when(is_null, F.lit(None) if nullable else F.lit(name)).when(~F.coalesce(ok, F.lit(False)), name)

    def judged(v: Column) -> Column:
        def of(name: str) -> Column:
            return let(F.try_variant_get(v, f"$.{name}", "variant"), lambda x: broken(x, name, *rules[name]))

        found = F.array_compact(F.array(*map(of, sorted(rules))))
        return F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), found).otherwise(F.array(F.lit("body")))

    return let(F.try_parse_json(body), judged)  # a text is parsed once, not for each field


# What a tenant's config must have to be processed, in the order of asking.
CONFIG_ERRORS = (
    "Missing required client config: driveFoldersJson.pending", "Missing required client config: driveFoldersJson.scanned",
    "Invalid client config: pending and scanned folders must be different", "Missing required client config: sheetName",
    "Missing required client config: google credentials (projectId/clientEmail/privateKey/sheetsId)",
)
GOOGLE_FIELDS = ("projectId", "clientEmail", "privateKey", "sheetsId")


def config_error(folders: Column, google: Column, sheet_name: Column, *, pending: str = "", scanned: str = "") -> Column:
    """The first thing that keeps a tenant from being processed, else null; ``pending`` and ``scanned`` stand where the tenant has none."""
    f, g = as_map(folders), as_map(google)

    def cell(m: Column, name: str, default: str = "") -> Column:
        return F.coalesce(F.nullif(js_trim(F.try_element_at(m, F.lit(name))), F.lit("")), F.lit(default))

    p, s = cell(f, "pending", pending), cell(f, "scanned", scanned)
    whole = F.lit(True)
    for name in GOOGLE_FIELDS:
        whole = whole & (cell(g, name) != "")
    wrong = (p == "", s == "", p == s, js_trim(F.coalesce(sheet_name, F.lit(""))) == "", ~whole)
    out = F.lit(None).cast("string")
    for test, said in reversed(list(zip(wrong, CONFIG_ERRORS, strict=True))):
        out = F.when(test, said).otherwise(out)
    return out


def google_config(json: Column, secret: Column) -> Column:
    """The credentials of a config as a struct, the private key decrypted; null where one of the four is missing or blank."""

    def told(c: Column) -> Column:
        whole = F.lit(True)
        for n in GOOGLE_FIELDS:
            whole = whole & c[n].isNotNull()
        return F.when(whole, F.struct(*((decrypted(c[n], secret) if n == "privateKey" else c[n]).alias(n) for n in GOOGLE_FIELDS)))

    return let(as_map(json), lambda m: let(_cells(m, GOOGLE_FIELDS), told))


def _cells(m: Column, names: tuple[str, ...]) -> Column:
    """The trimmed entries of a map as a struct, null where missing or blank."""
    return F.struct(*(F.nullif(js_trim(F.try_element_at(m, F.lit(n))), F.lit("")).alias(n) for n in names))


# What a config says of the extractors' vendors.
AI_KEYS, AI_MODELS = ("geminiApiKey", "openaiApiKey"), ("geminiModel", "openaiModel")


def ai_config(json: Column, secret: Column) -> Column:
    """Keys (decrypted) and models of a config as a struct, each null where it is missing or blank; null where all are."""
    names = (*AI_KEYS, *AI_MODELS)

    def told(c: Column) -> Column:
        read = F.struct(*((F.when(c[n].isNotNull(), decrypted(c[n], secret)) if n in AI_KEYS else c[n]).alias(n) for n in names))
        return F.when(F.coalesce(*(c[n] for n in names)).isNotNull(), read)

    return let(as_map(json), lambda m: let(_cells(m, names), told))


# The fields that a column mapping must name.
MAPPED_FIELDS = ("boletaNumber", "provider", "consortium", "providerTaxId", "detail", "observation", "dueDate", "amount", "alias", "clientNumber", "sourceFileUrl", "isDuplicate", "period")


def mapping_config(json: Column) -> Column:
    """The column mapping of a config as a map, null where a field is missing, blank or no text."""

    def told(raw: Column) -> Column:
        whole = F.lit(True)
        for name in MAPPED_FIELDS:
            filled = let(F.try_variant_get(raw, f"$.{name}", "variant"), lambda x: (F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == "STRING") & (js_trim(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))) != ""))
            whole = whole & filled
        return F.when(whole, F.try_variant_get(raw, "$", "map<string,string>"))

    return let(F.try_variant_get(F.try_parse_json(json), "$.columnMapping", "variant"), told)
