"""Queries of the engine's operators over the driver's tables, each with DuckDB SQL where SQL can express it.

The tables hold no video; each query names the stand-in signal that it reads.
"""

from . import blocks, clips, files, frames, tables

MODULES = (blocks, clips, files, frames, tables)


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
