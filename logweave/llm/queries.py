"""All queries of this subpackage with their SQL; each operator's module has its own in QUERIES and ORACLE_SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "decontaminate", "chat", "permutation_index", "line_spread", "tensor_minhash", "host_suffixes", "licences", "repeats", "mixing", "filter_audit", "middle", "packing")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
