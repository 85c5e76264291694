"""Every registered query, by name."""

from chartledger.plans import (
    extraction_queries,
    governance_queries,
    ledger_queries,
    longitudinal_queries,
    promotion_queries,
    rule_queries,
    source_queries,
    stream_queries,
    trace_queries,
    utterance_queries,
)

MODULES = (
    longitudinal_queries, ledger_queries, rule_queries, extraction_queries, utterance_queries,
    governance_queries, trace_queries, promotion_queries, source_queries,
    stream_queries,
)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.REG.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.REG.oracles.items()}
