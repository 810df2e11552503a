"""All queries of the text operators and the corpus pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from elastiq.llm import queries, sql

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE_SQL = {**sql.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
