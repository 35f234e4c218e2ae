"""Every query of the library by name, with its SQL twin where there is one."""

from __future__ import annotations

from . import alike, audit, clusters, consolidation, cycles, differences, documents, items, markdown, memory, metrics, network, retrieval, scorecard, store, streams, structure, vectors

MODULES = (retrieval, audit, memory, documents, structure, items, markdown, metrics, store, scorecard, network, vectors, alike, clusters, streams, consolidation, differences, cycles)


def queries() -> dict:
    """name -> (spark, sf_dir) -> DataFrame."""
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL over the same tables."""
    return {k: v for m in MODULES for k, v in m.SQL.items()}
