"""Registered queries over the driver's tables, with their SQL."""

from lodesift.plans import compaction, documents, logs, questions, ranking, records, retrieval, scoring, sessions, values

_ALL = (documents, ranking, logs, compaction, questions, records, retrieval, scoring, sessions, values)
QUERIES: dict = {name: query for part in _ALL for name, query in part.QUERIES.items()}
SQL: dict = {name: sql for part in _ALL for name, sql in part.SQL.items()}
if len(QUERIES) != sum(len(part.QUERIES) for part in _ALL):
    raise ImportError("two queries have the same name")
