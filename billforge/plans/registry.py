"""Name -> query and name -> SQL of the reference's own operators."""

from __future__ import annotations

from billforge.plans import imports, pipeline, records, sinks, streams, syncs  # noqa: F401 - registers its queries
from billforge.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
