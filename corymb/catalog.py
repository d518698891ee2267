"""All queries of the engine's own operators, with SQL twins for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corymb.plans import archives, closed_forms, divergence, imaging, models, pixels, registry, relational, runs, tiles  # noqa: F401  (each module registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()
