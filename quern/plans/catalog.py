"""The registered queries of the library and the SQL that checks them."""

from . import content, corpus, evaluation, files, quality, query_log, retrieval
from .inputs import sql

QUERIES: dict = {}
SQL: dict = {}
for module in (retrieval, query_log, quality, evaluation, corpus, content, files):
    QUERIES |= module.QUERIES
    SQL |= {name: sql(text) for name, text in module.SQL.items()}
