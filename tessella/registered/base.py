"""What the registered queries share: the tables, the example entity table, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PrependList
from tessella.operators import entity
from tessella.plans.spec import EntityTable, Family
from tessella.sources.events import derive_partition
from tessella.sources.shared import work_dir  # noqa: F401  for the queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; None: SQL cannot express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: ds and hour from ts, attribute k, and event_timestamp (= ts)."""
    rows = derive_partition(table(spark, sf_dir, "events"), "ts")
    return rows.withColumns({"k": F.get_json_object("props", "$.k"), "event_timestamp": F.col("ts")})


EV = "ev AS (SELECT *, strftime(ts, '%Y-%m-%d') AS ds, strftime(ts, '%H') AS hour, json_extract_string(props, '$.k') AS k FROM events)"
DAY = "CAST(CAST(ds AS DATE) - DATE '1970-01-01' AS BIGINT)"

def bits_sql(days: str, last: int, n: int) -> str:
    return f"list_aggregate(list_transform(range({last - n + 1}, {last + 1}), lambda s: CASE WHEN list_contains({days}, s) THEN '1' ELSE '0' END), 'string_agg', '')"


KEYS = {"user_id": "entity_id"}
BROWSING = Family("browsing", {"view_count": Lifetime("count"), "view_value": Lifetime("sum", "value")}, KEYS, "event_type = 'view'")
ENGAGEMENT = Family("engagement", {"recent": PrependList("k", 50), "active": BitmapActivity("day", 30)}, KEYS, "event_type = 'click'")
COMMERCE = Family("commerce", {"spend": Lifetime("sum", "value"), "purchases": Lifetime("count")}, KEYS, "event_type = 'purchase'")
BEHAVIOUR = EntityTable("behaviour", ("entity_id",), (BROWSING, ENGAGEMENT, COMMERCE), {"avg_order_value": "try_divide(spend, purchases)"})


def states(spark, sf_dir, family: Family) -> DataFrame:
    return entity.cumulate(entity.family_delta(ev(spark, sf_dir), family), family, list(family.keys.values()))


def loads(spark, sf_dir) -> list[DataFrame]:
    """The three families over the whole log, as loads to be stitched."""
    rows = ev(spark, sf_dir)
    v, c, p = (entity.map_keys(rows.where(f.where), KEYS) for f in (BROWSING, ENGAGEMENT, COMMERCE))
    return [
        v.groupBy("entity_id").agg(F.count(F.lit(1)).alias("view_count"), F.round(F.sum("value"), 2).alias("view_value")),
        c.groupBy("entity_id").agg(F.count(F.lit(1)).alias("clicks"), F.max("k").alias("top_k")),
        p.groupBy("entity_id").agg(F.round(F.sum("value"), 2).alias("spend"), F.count(F.lit(1)).alias("purchases")),
    ]


LOADS = f"""{EV},
v AS (SELECT user_id AS entity_id, count(*) AS view_count, round(sum(value), 2) AS view_value FROM ev WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT user_id AS entity_id, count(*) AS clicks, max(k) AS top_k FROM ev WHERE event_type = 'click' GROUP BY 1),
p AS (SELECT user_id AS entity_id, round(sum(value), 2) AS spend, count(*) AS purchases FROM ev WHERE event_type = 'purchase' GROUP BY 1),
st AS (SELECT entity_id, view_count, view_value, clicks, top_k, spend, purchases FROM v FULL JOIN c USING (entity_id) FULL JOIN p USING (entity_id))"""

