"""Collects the queries and oracle SQL of the core (non-llm) modules."""

from __future__ import annotations

from importlib import import_module

#: Modules that each define QUERIES (name -> callable(spark, sf_dir)) and ORACLE (name -> DuckDB SQL).
MODULES: list[str] = ["retrieval", "safety", "web", "history", "trees", "vectors", "field", "pages", "labels", "forms", "results", "hydration", "hypervectors", "interaction", "feedback"]


def collect() -> tuple[dict, dict]:
    """All core queries and their oracle SQL; a name may be defined once only."""
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = import_module(f"heddle.plans.{name}")
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names defined twice: {sorted(clash)}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
