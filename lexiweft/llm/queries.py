"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, htmltext, mixing, neardup, pii, quality, secretscan, tokencount, topk, urlfilter

MODULES = [pii, neardup, topk, htmltext, secretscan, urlfilter, bpe, quality, tokencount, mixing]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
