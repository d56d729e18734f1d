"""All registered queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from tomewright.catalog import corpus_text, figures, logs, retrieval, round_trips

_FAMILIES = (retrieval, corpus_text, logs, figures, round_trips)

QUERIES = {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}
SQL = {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
