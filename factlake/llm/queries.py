"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "tokens",
    "decontaminate",
    "linededup",
    "secrets",
    "html",
    "minhash",
    "vectors",
    "quality",
    "pii",
    "mixing",
    "trie",
    "clusters",
    "shards",
)

QUERIES, SQL = {}, {}
for _name in MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
