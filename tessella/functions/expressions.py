"""The expression vocabulary: names Spark has itself, and the three it writes otherwise.

Column declarations, derived columns and metrics take Spark SQL expressions as they are. ``sum_if``, ``avg_if`` and
``count_distinct`` have no function of that name in Spark; they are conditional and distinct aggregates here.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def sum_if(x: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, x))


def avg_if(x: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, x))


def count_distinct(x: Column) -> Column:
    return F.count_distinct(x)


def register(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A user's function, as a SQL function: Spark inlines its body, so it costs what the expression costs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
