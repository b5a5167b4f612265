"""All queries of the engine, by name, and their SQL."""

from . import answer_queries, graph_queries, job_queries, lookup_queries, pack_queries, render_queries, search_queries, source_queries, stats_queries

_MODULES = [lookup_queries, search_queries, graph_queries, pack_queries, stats_queries, source_queries, render_queries, answer_queries, job_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
