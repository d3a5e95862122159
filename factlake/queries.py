"""All queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import asking, assignment, checks, citing, evidence, filters, guard, ingest, layout, listings, matching, news, reconcile, retrieval, rules, series, similar, tables, text, validation
from .plans import formulas
from .streaming import delivery, jobs, ordered

REGISTRIES = (formulas.registry, series.registry, validation.registry, text.registry, evidence.registry, tables.registry, filters.registry, rules.registry, ingest.registry, matching.registry, listings.registry, similar.registry, assignment.registry, reconcile.registry, guard.registry, retrieval.registry, jobs.registry, ordered.registry, delivery.registry, layout.registry, news.registry, asking.registry, citing.registry, checks.registry)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _registry in REGISTRIES:
    QUERIES |= _registry.queries
    SQL |= _registry.sql


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: gross margins of each entity and year."""
    return QUERIES["formula_gross_margin"](spark, sf_dir)
