"""Versions and time travel, as queries over commit records.

commits(table_name, version, load_id, columns, committed_at); column_loads(table_name, column_name, ds, hour, load_id,
version, committed_at); manifests(table_name, version, column_name, load_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.entity import stitch


def carry_forward(loads: DataFrame) -> DataFrame:
    """The full column to load map at each version: what a version loads overrides, the rest stays (``loads``: the changes).

    A row of the result is (table_name, version, column_name, load_id). Versions and columns are metadata; their grid is
    joined on the table's name.
    """
    versions = loads.select("table_name", "version").distinct()
    columns = loads.select("table_name", "column_name").distinct()
    grid = versions.join(columns, "table_name").join(loads, ["table_name", "version", "column_name"], "left")
    w = Window.partitionBy("table_name", "column_name").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.select("table_name", "version", "column_name", F.last("load_id", ignorenulls=True).over(w).alias("load_id"))
    return full.where("load_id is not null")


def _at(manifests: DataFrame, picked: DataFrame) -> DataFrame:
    return manifests.join(picked, ["table_name", "version"]).select("table_name", "version", "column_name", "load_id")


def resolve_latest(commits: DataFrame, manifests: DataFrame) -> DataFrame:
    """The map of each table's newest version."""
    return _at(manifests, commits.groupBy("table_name").agg(F.max("version").alias("version")))


def resolve_wall_time(commits: DataFrame, manifests: DataFrame, time: str) -> DataFrame:
    """The map of the newest version committed at a time or before."""
    done = commits.where(F.col("committed_at") <= F.lit(time).cast("timestamp_ntz"))
    return _at(manifests, done.groupBy("table_name").agg(F.max_by("version", F.struct("committed_at", "version")).alias("version")))


def latest_column_loads(loads: DataFrame) -> DataFrame:
    """One load for each (column, ds, hour): a rerun replaces the old one; a null hour is a value."""
    w = Window.partitionBy("table_name", "column_name", "ds", "hour").orderBy(F.col("version").desc())
    return loads.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def resolve_ds(loads: DataFrame, ds: str, hour: int | None = None) -> DataFrame:
    """Each column's load of a day: of exactly that hour, or else of its latest hour, null being the earliest."""
    day = latest_column_loads(loads).where(F.col("ds") == ds)
    if hour is not None:
        return day.where(F.col("hour") == hour)
    w = Window.partitionBy("table_name", "column_name").orderBy(F.coalesce("hour", F.lit(-1)).desc())
    return day.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def missing_columns(asked: DataFrame, resolved: DataFrame) -> DataFrame:
    """Asked columns without a load."""
    return asked.join(resolved, ["table_name", "column_name"], "left_anti")


def rollback(commits: DataFrame, manifests: DataFrame, version: int, committed_at: str) -> tuple[DataFrame, DataFrame]:
    """One more commit of each table, which points at the map of an older version."""
    top = commits.groupBy("table_name").agg((F.max("version") + 1).cast("int").alias("next"))
    old = commits.where(F.col("version") == version).join(top, "table_name")
    commit = old.select(*(F.col("next").alias(c) if c == "version" else F.lit(committed_at).cast("timestamp_ntz").alias(c) if c == "committed_at" else F.col(c) for c in commits.columns))
    maps = manifests.where(F.col("version") == version).join(top, "table_name")
    again = maps.select(*(F.col("next").alias(c) if c == "version" else F.col(c) for c in manifests.columns))
    return commits.unionByName(commit), manifests.unionByName(again)


def dedupe_commits(commits: DataFrame) -> DataFrame:
    """The same load of a table counts once, with its lowest version."""
    w = Window.partitionBy("table_name", "load_id").orderBy("version")
    return commits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def orphan_loads(written: DataFrame, manifests: DataFrame, now: str, grace_hours: int = 1) -> DataFrame:
    """Loads that no version names, older than a grace time (``written``: load_id, written_at)."""
    old = F.col("written_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(grace_hours))
    return written.join(manifests, "load_id", "left_anti").where(old)


def columns_by_load(resolved: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The asked columns of each load, so that a load is read once."""
    rows = resolved if columns is None else resolved.where(F.col("column_name").isin(list(columns)))
    return rows.groupBy("table_name", "load_id").agg(F.sort_array(F.collect_set("column_name")).alias("columns"))


def write_loads(data: DataFrame, path: str) -> None:
    """Writes loads, each a folder under ``path`` by its load_id; they are never changed afterwards, so a load is written once. Spark gathers
    the rows of small loads into one file each and divides large ones."""
    data.hint("rebalance", "load_id").write.mode("append").partitionBy("load_id").parquet(path)


def read_loads(data: DataFrame, resolved: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The stitched rows of the resolved loads. ``data``: load_id, keys and columns of all loads. Each asked column has one load at most,
    whose name is looked up first: the filter on it is known when the read is planned, so only the folders of those loads are read,
    and of each only its own columns. A column without a load is null for every key."""
    named = resolved.where(F.col("column_name").isin(list(columns))).select("column_name", "load_id").distinct()
    owner = {r.column_name: r.load_id for r in named.limit(len(columns)).collect()}
    parts = [data.where(F.col("load_id") == load).select(*keys, *(c for c in columns if owner.get(c) == load)) for load in sorted(set(owner.values()))]
    found = stitch(parts, keys) if parts else data.where(F.lit(False)).select(*keys)
    kinds = dict(data.dtypes)
    return found.select(*keys, *(F.col(c) if c in owner else F.lit(None).cast(kinds[c]).alias(c) for c in columns))
