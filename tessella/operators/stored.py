"""Entity tables that are written: loads that answer lookups from one file, and states that a late correction changes no further than it must."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.entity import cumulate, overwrite_period
from tessella.plans.spec import Family
from tessella.sources.shared import remove

#: Bytes of a row group: small, so that a lookup in a sorted file reads little of it.
ROW_GROUP = 4 << 20


def write_ranged(df: DataFrame, path: str, keys: Sequence[str], files: int, bloom: Sequence[str] = ()) -> None:
    """A load in ``files`` files by ranges of its keys, rows in order, so that row groups and pages have narrow ranges too, with a table of
    what each file holds. ``bloom``: columns that get Bloom filters, for lookups by columns the rows are not in order of."""
    writer = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.option("parquet.block.size", ROW_GROUP)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows").select(F.input_file_name().alias("file"), F.col(keys[0]).alias("first"))
    held = rows.groupBy("file").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.count(F.lit(1)).alias("rows"))
    held.coalesce(1).sortWithinPartitions("low").write.parquet(f"{path}/files")


def lookup(spark: SparkSession, path: str, key: str, *, equals=None, among: Sequence | None = None, between: tuple | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a ranged load by its first key. Only files that may hold one are opened; in those the filter reaches row groups and pages.
    A null is equal to nothing."""
    values = [equals] if equals is not None else list(among or ())
    wanted = F.col(key).between(*between) if between else F.col(key).isin(values)
    if between:
        may = (F.col("low") <= F.lit(between[1])) & (F.col("high") >= F.lit(between[0]))
    else:
        may = reduce(lambda a, b: a | b, (F.lit(v).between(F.col("low"), F.col("high")) for v in values), F.lit(False))
    files = [r.file for r in spark.read.parquet(f"{path}/files").where(may).select("file").collect()]
    every = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)
    found = rows.where(wanted)
    return found if columns is None else found.select(*columns)


# --- deltas, states and snapshots by day ----------------------------------------------------------------------------------


def deltas(spark: SparkSession, path: str) -> DataFrame:
    return _by_day(spark, f"{path}/deltas")


def states(spark: SparkSession, path: str) -> DataFrame:
    return _by_day(spark, f"{path}/states")


def _by_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows.withColumn("ds", F.col("ds").cast("string"))  # Spark takes the folders' names for dates


def store(rows: DataFrame, family: Family, keys: Sequence[str], path: str) -> None:
    """Deltas, written by day, and the states that follow from them, each on the days on which its key has a delta."""
    overwrite_period(rows, f"{path}/deltas")
    done = deltas(rows.sparkSession, path)
    overwrite_period(cumulate(done, family, keys).select(*keys, "ds", *family.columns), f"{path}/states")


def snapshot(spark: SparkSession, family: Family, keys: Sequence[str], path: str, day: str) -> None:
    """The state of every key at the end of a day, from the snapshot before and the deltas since. Later cascades start from it."""
    overwrite_period(_state(spark, family, keys, path, day).withColumn("ds", F.lit(day)), f"{path}/snapshots")


def _state(spark: SparkSession, family: Family, keys: Sequence[str], path: str, day: str) -> DataFrame:
    """Every key's state at the end of a day: what was snapshot before, if anything, and the deltas since."""
    last = _last_snapshot(spark, path, day)
    since = deltas(spark, path).where(F.col("ds") <= day)
    parts = since.where(F.col("ds") > last) if last else since
    rows = parts.select(*keys, *(F.col(f"{n}__delta").alias(n) for n in family.columns))
    if last:
        rows = rows.unionByName(_by_day(spark, f"{path}/snapshots").where(F.col("ds") == last).select(*keys, *family.columns))
    return rows.groupBy(*keys).agg(*(s.combine(F.col(n)).alias(n) for n, s in family.columns.items()))


def _last_snapshot(spark: SparkSession, path: str, day: str) -> str | None:
    return max((d for d in _snapshots(spark, path) if d <= day), default=None)


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots/ds=*")
    found = glob.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(glob) or []
    return sorted(str(f.getPath().getName()).removeprefix("ds=") for f in found)


def cascade(spark: SparkSession, family: Family, keys: Sequence[str], path: str, fresh: DataFrame, start: str, end: str) -> list[str]:
    """Puts corrected deltas of [start, end] in place of the stored ones and brings the states up to date; gives the days that were written.

    The state before ``start`` comes from the last snapshot and the deltas since; of stored deltas only those from there on are read, and no
    source is. States are made anew from ``start`` on, compared with the stored ones, and only the days on which some key's state is another
    are written: a correction that later days do not see, such as one of a value that is overwritten, ends there. Snapshots from ``start`` on
    are removed. A key that a correction takes off a day altogether changes that day.
    """
    before_start = spark.range(1).select(F.date_format(F.date_sub(F.to_date(F.lit(start)), 1), "yyyy-MM-dd")).first()[0]
    known = _state(spark, family, keys, path, before_start).withColumn("ds", F.lit(before_start))
    columns = [*keys, "ds", *(f"{n}__delta" for n in family.columns)]
    later = deltas(spark, path).where((F.col("ds") >= start) & ~F.col("ds").between(start, end)).select(*columns)
    new = cumulate(later.unionByName(fresh.select(*columns)), family, keys, before=known).select(*keys, "ds", *family.columns)
    made = f"{path}/made-{start}-{end}"
    new.write.mode("overwrite").parquet(made)
    new, old = spark.read.parquet(made), states(spark, path).where(F.col("ds") >= start).select(*new.columns)
    content = lambda df: df.select("ds", F.struct(*keys).alias("keys"), F.to_json(F.struct(*family.columns)).alias("s"))
    both = content(new).unionByName(content(old)).groupBy("ds", "keys").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("kinds"))
    days = sorted(r.ds for r in both.where("n <> 2 or kinds <> 1").select("ds").distinct().collect())
    gone = [d for d in days if new.where(F.col("ds") == d).isEmpty()]
    overwrite_period(new.where(F.col("ds").isin(days)), f"{path}/states")
    for d in gone:  # no key has a state of that day any more
        remove(spark, f"{path}/states/ds={d}")
    _replace_deltas(spark, path, fresh.select(*columns), start, end)
    for d in [d for d in _snapshots(spark, path) if d >= start]:
        remove(spark, f"{path}/snapshots/ds={d}")
    remove(spark, made)
    return days


def _replace_deltas(spark: SparkSession, path: str, fresh: DataFrame, start: str, end: str) -> None:
    """Dynamic overwrite replaces the days that ``fresh`` has; stored days of the range that it lacks go."""
    have = {r.ds for r in fresh.select("ds").distinct().collect()}
    stored = [r.ds for r in deltas(spark, path).where(F.col("ds").between(start, end)).select("ds").distinct().collect()]
    overwrite_period(fresh, f"{path}/deltas")
    for d in stored:
        if d not in have:
            remove(spark, f"{path}/deltas/ds={d}")
