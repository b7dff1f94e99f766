"""All queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("suffix", "embeddings", "secrets", "mixing", "decontaminate", "tokencount", "minhash", "lines", "toxicity", "extract")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracles() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").ORACLES.items()}
