"""Parsing of extractors' JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billforge.functions import keys as K

# The fields of an answer, and the ways to pay.
TEXT_FIELDS = ("boletaNumber", "provider", "consortium", "providerTaxId", "detail", "observation", "dueDate", "alias", "clientNumber", "paymentMethod")
PAYMENT_METHODS = ("DEBITO_AUTOMATICO", "TRANSFERENCIA", "EFECTIVO")
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def parse_answer(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column for each field (snake case) and route: 'parsed', or 'failed' with all fields null.

    The answer, without a code fence, must be a JSON object in which text fields
    are strings, amount a number or a string, paymentMethod one of the known ways
    and allTaxIds an array of strings; absent fields and nulls are null, other
    fields are ignored.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(column), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    r = rows.withColumn("_v", F.try_parse_json(bare))
    names = (*TEXT_FIELDS, "amount", "allTaxIds")
    r = r.withColumns({f"_t_{n}": F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")), F.lit("VOID")) for n in names})

    def kind(name: str) -> Column:
        return F.col(f"_t_{name}")

    text = F.lit(True)
    for n in TEXT_FIELDS:
        text = text & kind(n).isin("STRING", "VOID")
    method = F.try_variant_get("_v", "$.paymentMethod", "string")
    ok = (
        F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
        & text
        & (kind("amount").isin("STRING", "VOID") | kind("amount").rlike(_NUMBER))
        & kind("allTaxIds").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
        & (method.isNull() | method.isin(*PAYMENT_METHODS))
    )
    r = r.withColumn("_ok", ok)

    def value(name: str, kind_: str = "string") -> Column:
        return F.when(F.col("_ok"), F.try_variant_get("_v", f"$.{name}", kind_))

    shaped = {"providerTaxId": K.tax_id, "dueDate": K.business_date}
    fields = [(F.when(value(n).isNotNull(), shaped[n](value(n))) if n in shaped else value(n)).alias(_snake(n)) for n in TEXT_FIELDS]
    return r.select(
        *rows.columns,
        *fields,
        K.extracted_amount(value("amount")).alias("amount"),
        value("allTaxIds", "array<string>").alias("all_tax_ids"),
        F.when(F.col("_ok"), "parsed").otherwise("failed").alias("route"),
    )
