"""The queries of this subpackage."""

from . import decontaminate, html_text, line_dedup, lm_score, merkle, near_dedup, pieces, pii, quality, quality_rules, secrets_scan, spelling, url_filter

QUERIES: dict = {}
SQL: dict = {}
for module in (url_filter, pieces, pii, line_dedup, near_dedup, quality_rules, decontaminate, quality, lm_score, secrets_scan, spelling, merkle, html_text):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
