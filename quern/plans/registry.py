"""All queries of the core, with their SQL twins."""

from quern.plans import analytics_queries, answer_queries, fixture_queries, index_queries, instant_queries, pipeline_queries, search_queries, web_queries

MODULES = (index_queries, search_queries, analytics_queries, fixture_queries, instant_queries, web_queries, answer_queries, pipeline_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
