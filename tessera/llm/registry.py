"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, exact_dedup, html_text, interleave, language, packing, pii, simhash, toxicity, warc

MODULES = (simhash, warc, interleave, decontaminate, html_text, exact_dedup, language, pii, toxicity, packing)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
