"""Every registered query of the library, with its oracle, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import entity
from tessella.registered import analytics, families, logs, tables, vocabulary  # noqa: F401  they register themselves
from tessella.registered.base import BEHAVIOUR, ORACLES, QUERIES, ev

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity table of three families at the end of a day, with its derived column: the five highest order values."""
    built = entity.build(ev(spark, sf_dir), BEHAVIOUR, "2024-01-15")
    return built.orderBy(F.desc_nulls_last("avg_order_value"), "entity_id").limit(5)
