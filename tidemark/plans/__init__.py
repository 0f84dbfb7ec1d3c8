"""Registered queries of the log-analytics operators, with SQL for the same results."""

from . import event_queries, history_queries, log_queries, statement_queries, text_queries

_MODULES = (event_queries, history_queries, log_queries, statement_queries, text_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
