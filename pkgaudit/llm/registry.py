"""The registered queries of this subpackage."""

from __future__ import annotations

from pkgaudit.llm import (
    byte_bpe,
    chat,
    exact_dedup,
    fim,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    whitening,
)

MODULES = (
    mixing, chat, quality_rules, near_dedup, exact_dedup, quality_classifier, secrets, byte_bpe, sharding, pii,
    fim, whitening, packing,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
