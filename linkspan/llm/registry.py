"""The contract queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, language_id, license_scan, mixing, packing, quality_model, quality_rules, sharding, simhash_dedup, token_store

MODULES = (exact_dedup, language_id, token_store, license_scan, sharding, simhash_dedup, packing, quality_rules, quality_model, mixing)

QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
