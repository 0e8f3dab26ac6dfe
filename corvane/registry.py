"""All queries over the driver's tables and the DuckDB SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from corvane.catalog import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]

FLAGSHIP = "retrieve_hybrid"

#: Modules that register queries.
MODULES = [
    "functions.text",
    "functions.folds",
    "functions.terms",
    "functions.numbers",
    "functions.vectors",
    "sources.readers",
    "sources.sinks",
    "operators.filters",
    "operators.joins",
    "operators.fuzzy",
    "operators.scans",
    "operators.aggregates",
    "operators.windows",
    "operators.structure",
    "operators.artifact_graph",
    "operators.quality",
    "operators.inference",
    "operators.cells",
    "operators.index_audit",
    "operators.retrieval",
    "operators.ranking",
    "operators.routing",
    "operators.evidence",
    "operators.evidence_compile",
    "operators.feedback",
    "plans.pipelines",
    "streaming.state",
]

for _name in MODULES:
    import_module(f"corvane.{_name}")
