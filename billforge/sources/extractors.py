"""Pluggable extractors of structured records from text, tried in turn, with their usage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "answer string, provider string, model string, input_tokens long, output_tokens long, total_tokens long, errors array<string>"


@dataclass
class Extraction:
    """An answer (JSON, as extract.parse_answer reads it) and what it has used."""

    answer: str
    input_tokens: int = 0
    output_tokens: int = 0
    total_tokens: int | None = None


class Extractor(Protocol):
    """``provider`` and ``model`` name it in usage rows; it raises where it can't answer. It is pickled to the executors."""

    provider: str
    model: str

    def extract(self, text: str) -> Extraction: ...


# How a bill's lines name their fields, in ASCII classes; the first line that does so counts.
PATTERNS = {
    "consortium": r"(?i)raz[oó]n social: *([^\n]*[^\n ])",
    "boletaNumber": r"(?i)(?:boleta|factura) n[º°ro.]* *([0-9][0-9-]*)",
    "dueDate": r"(?i)vencimiento: *([0-9]{4}-[0-9]{2}-[0-9]{2})",
    "amount": r"(?i)total: *\$? *([0-9][0-9.,]*)",
    "clientNumber": r"(?i)(?:cliente|suministro) n[º°ro.]* *([0-9]+)",
}
TAX_ID = r"[0-9]{2}-[0-9]{8}-[0-9]"


@dataclass
class Rules:
    """Reads labelled lines by regular expressions; a text without the ``needed`` fields is an error. Tokens are words."""

    needed: tuple[str, ...] = ()
    provider: str = "rules"
    model: str = "labelled-lines"

    def extract(self, text: str) -> Extraction:
        found = {k: m[1] for k, p in PATTERNS.items() if (m := re.search(p, text, re.ASCII))}
        missing = [k for k in self.needed if k not in found]
        if missing:
            raise ValueError(f"no {missing[0]} in the text")
        ids = list(dict.fromkeys(re.findall(TAX_ID, text, re.ASCII)))
        record = {**found, "providerTaxId": ids[0] if ids else None, "allTaxIds": ids}
        if "amount" in record:
            record["amount"] = record["amount"].replace(".", "").replace(",", ".")
        return Extraction(json.dumps(record, ensure_ascii=False), len(text.split()), len(record))


def extract(docs: DataFrame, chain: list[Extractor], *, text: str = "text") -> DataFrame:
    """``docs`` with the answer of the first extractor of ``chain`` that gives one, its provider, model and tokens, and the errors of those before it.

    Null texts ask nobody; where all fail the answer is null. Each extractor sees each text once, in one
    pass; write the result before it is used twice. All columns of ``docs`` stay, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["_text"]:
                errors, got, by = [], None, None
                for x in chain if t is not None else ():
                    try:
                        got, by = x.extract(t), x
                        break
                    except Exception as e:  # noqa: BLE001 - any failure goes to the next extractor, and into the row
                        errors.append(f"{x.provider}: {e}")
                total = None if got is None else got.total_tokens if got.total_tokens is not None else got.input_tokens + got.output_tokens
                rows.append((got.answer, by.provider, by.model, got.input_tokens, got.output_tokens, total, errors) if got else (None, None, None, None, None, None, errors))
            out = pd.DataFrame(rows, columns=["answer", "provider", "model", "input_tokens", "output_tokens", "total_tokens", "errors"], index=batch.index)
            for c in ("input_tokens", "output_tokens", "total_tokens"):
                out[c] = out[c].astype("Int64")
            yield pd.concat([batch["row"], out], axis=1)

    quoted = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("row"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(SCHEMA).fields])
    return rows.mapInPandas(run, schema).select("row.*", *(c.split()[0] for c in SCHEMA.split(", ")))


def usage_of(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """A usage row for each answer of extract(): the columns ``keep``, provider, model and tokens."""
    return extracted.where("provider is not null").select(*keep, "provider", "model", "input_tokens", "output_tokens", "total_tokens")
