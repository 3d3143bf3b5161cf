"""Registered queries and their SQL equivalents: one for each operator."""

from __future__ import annotations

from . import design, evidence, learned, maps, partitions

MODULES = (design, maps, partitions, evidence, learned)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
