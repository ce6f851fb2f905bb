"""All registered queries with their oracle SQL."""

from . import dimension_queries, learning_queries, model_queries, panel_queries, serving_queries, source_queries, standard_queries, trip_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (trip_queries, standard_queries, source_queries, dimension_queries, panel_queries, serving_queries, learning_queries, model_queries):
    QUERIES |= part.query
    ORACLE_SQL |= part.query.sql
