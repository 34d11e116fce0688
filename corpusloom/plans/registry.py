"""All registered queries outside the training-data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from corpusloom.plans import corpus, flows, search, services, tables

FLAGSHIP = "hybrid_search"
QUERIES = tables.QUERIES | corpus.QUERIES | search.QUERIES | flows.QUERIES | services.QUERIES
ORACLE_SQL = tables.ORACLE_SQL | corpus.ORACLE_SQL | search.ORACLE_SQL | flows.ORACLE_SQL | services.ORACLE_SQL
