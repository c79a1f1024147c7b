"""Registered queries of the fine-mapping engine and SQL for those that SQL can express."""

from . import fits, oracles, relational

QUERIES = {**fits.QUERIES, **relational.QUERIES}
ORACLE_SQL = {name: text for name, text in oracles.ORACLE_SQL.items() if name in QUERIES}
