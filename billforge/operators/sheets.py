"""Positional sheet rows from a tenant's column mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions import keys as K
from billforge.functions.address import let
from billforge.operators.numbering import numbered

# The default columns of a sheet row.
DEFAULT_MAPPING = {
    "boletaNumber": "A", "provider": "B", "consortium": "C", "providerTaxId": "D", "detail": "E", "observation": "F", "dueDate": "G",
    "amount": "H", "alias": "I", "clientNumber": "J", "paymentMethod": "K", "period": "L", "sourceFileUrl": "M",
}


# The headings of a sheet's columns.
HEADERS = {
    "boletaNumber": "NUMERO DE BOLETA", "provider": "PROVEEDOR", "consortium": "CONSORCIO", "providerTaxId": "CUIT DEL PROVEEDOR", "detail": "DETALLE",
    "observation": "OBSERVACION", "dueDate": "FECHA DE VENCIMIENTO", "amount": "MONTO", "alias": "ALIAS", "clientNumber": "NRO CLIENTE",
    "sourceFileUrl": "URL_ARCHIVO", "isDuplicate": "ES_DUPLICADO", "period": "PERIODO",
}


def mapping_of(config: dict | None, fields: dict[str, str] = DEFAULT_MAPPING) -> dict[str, str]:
    """The tenant's mapping, or the default where it is missing a field or has a wrong letter."""
    ok = isinstance(config, dict) and all(isinstance(config.get(k), str) and config[k].strip().isalpha() for k in fields)
    return {k: config[k].strip().upper() for k in fields} if ok else dict(fields)


def sheet_row(rows: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, and one string column per letter from A to the last mapped one; nulls and letters without a field are empty, the amount is in pesos."""

    def cell(name: str) -> Column:
        c = K.pesos(F.col(name).cast("double")) if name == "amount" else F.col(name).cast("string")
        return F.coalesce(c, F.lit(""))

    place = {_number(letter): name for name, letter in mapping.items()}
    letters = {_number(letter): letter for letter in mapping.values()}
    cells = []
    for n in range(1, max(place, default=0) + 1):
        name = place.get(n)
        cells.append((cell(name) if name in rows.columns else F.lit("")).alias(letters.get(n) or _letters(n)))
    return rows.select(*keep, *cells)


def used_columns(mapping: dict[str, str]) -> tuple[str, str]:
    """The first and the last letters of a mapping."""
    places = [_number(x) for x in mapping.values()]
    return _letters(min(places)), _letters(max(places))


def written_range(mapping: dict[str, str], row: Column) -> Column:
    """The range of one row, 'A7:M7'."""
    first, last = used_columns(mapping)
    n = row.cast("string")
    return F.concat(F.lit(first), n, F.lit(f":{last}"), n)


def header_row(mapping: dict[str, str]) -> dict[str, str]:
    """Heading by letter; letters without a heading are blank."""
    told = {letter: HEADERS.get(name, "") for name, letter in mapping.items()}
    return {_letters(n): told.get(_letters(n), "") for n in range(1, _number(used_columns(mapping)[1]) + 1)}


def appended(sheet: DataFrame, rows: DataFrame, mapping: dict[str, str], settle: Callable[[DataFrame], DataFrame], *, tenant: str, order: list[str]) -> DataFrame:
    """``sheet`` (tenant, row_number, a text column for each letter) with ``rows`` below each tenant's last row, in order.

    Where row 1 of a tenant that gets rows has only blank cells it is set to the headings; the
    first row of data is 2. Rows get their numbers without one task for a tenant
    (numbering). Rows that are equal in ``order`` come in any order.
    """
    heads = header_row(mapping)
    letters = list(heads)
    new = numbered(settle(rows), tenant, order, settle)
    cells = sheet_row(new.withColumns({"_t": F.col(tenant), "_p": F.col("place")}), mapping, keep=("_t", "_p"))
    ends = sheet.groupBy(F.col(tenant).alias("_t")).agg(F.max("row_number").alias("_last"))
    below = F.greatest(F.coalesce(F.col("_last"), F.lit(0)), F.lit(1)) + 1 + F.col("_p")
    placed = cells.join(ends, "_t", "left").select(F.col("_t").alias(tenant), below.alias("row_number"), *letters)
    blank = F.lit(True)
    for x in letters:
        blank = blank & (F.trim(F.coalesce(x, F.lit(""))) == "")
    headed = sheet.where("row_number = 1").where(~blank).select(tenant)
    head = new.select(tenant).distinct().join(headed, tenant, "left_anti").select(tenant, F.lit(1).cast("long").alias("row_number"), *(F.lit(v).alias(k) for k, v in heads.items()))
    old = sheet.join(head.select(tenant, F.lit(1).cast("long").alias("row_number")), [tenant, "row_number"], "left_anti")
    return old.select(tenant, "row_number", *letters).union(placed).union(head)


def cleared(sheet: DataFrame, tenants: DataFrame, tenant: str) -> DataFrame:
    """``sheet`` where ``tenants`` keep their headings alone."""
    return sheet.where("row_number = 1").unionByName(sheet.where("row_number > 1").join(tenants.select(tenant).distinct(), tenant, "left_anti"))


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def duplicate_keys(sheet: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Distinct business keys of a sheet's rows; a zero amount counts as none."""
    parts = (
        K.business_text(F.col(mapping["boletaNumber"])), K.business_text(F.col(mapping["providerTaxId"])), K.business_date(F.col(mapping["dueDate"])),
        let(K.business_amount(F.col(mapping["amount"])), lambda x: F.when(x != "0.00", x)),
    )
    # a key is computed once, where a filter behind it would compute it again
    return sheet.select(F.explode(F.array_compact(F.array(K.joined_key(*parts)))).alias("business_key")).distinct()
