"""Registry of named queries: a Spark builder (spark, sf_dir) -> DataFrame and, where the
operator is SQL-expressible on whole tables, an equivalent DuckDB SQL text."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from labelflow.plans import q_augment, q_embeddings, q_evaluate, q_generate, q_grid, q_identity, q_learned, q_residues, q_sitestats, q_tokens_rbm  # noqa: F401
