"""Places of rows in a total order; tables between are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from billforge.llm.shared import cut
from billforge.operators import numbering


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """operators.numbering.numbered, with ``place``."""
    return numbering.numbered(rows, group, order, cut)
