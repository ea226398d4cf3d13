"""The library's queries over the test tables, by name, and their SQL equivalents."""

from __future__ import annotations

from lemniscate.plans import data_queries, formula_queries, search_queries, source_queries, text_queries
from lemniscate.plans.catalog import Catalog, Query

CATALOGS: tuple[Catalog, ...] = (search_queries.C, text_queries.C, data_queries.C, formula_queries.C, source_queries.C)
QUERIES: dict[str, Query] = {k: f for c in CATALOGS for k, f in c.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for c in CATALOGS for k, s in c.sql.items()}
FLAGSHIP = "fusion_max"
