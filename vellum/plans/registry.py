"""Queries over the driver's tables and their SQL, gathered from the plan modules."""

from __future__ import annotations

from vellum.plans import evidence, gaps, graph, knowledge, loop, pipeline, relational, retrieval, sections, stages, validation

MODULES = [evidence, gaps, graph, knowledge, loop, pipeline, relational, retrieval, sections, stages, validation]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
