"""Entity tables: per-period deltas, cumulative states, backfill, and the stitched table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.functions.states import ORDER, BitmapActivity, Life, Lifetime, PackedActivity, PrependList
from tessella.plans.spec import EntityTable, Family


def map_keys(df: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Source columns renamed to the table's key columns."""
    return df.withColumnsRenamed({a: b for a, b in keys.items() if a != b})


def family_delta(events: DataFrame, family: Family, period: Sequence[str] = ("ds",)) -> DataFrame:
    """One row for each key and period: every column of the family aggregated over that period, named ``<column>__delta``.

    Many periods are done in one job. List columns first keep each group's newest rows (a limit that Spark applies before the
    shuffle), so a hot key never gathers more than its list holds.
    """
    rows = map_keys(events if family.where is None else events.where(family.where), family.keys)
    group = [*family.keys.values(), *period]
    lists = {n: s for n, s in family.columns.items() if isinstance(s, PrependList)}
    plain = {n: s for n, s in family.columns.items() if n not in lists}
    parts = []
    if plain:
        parts.append(rows.groupBy(*group).agg(*(s.delta().alias(f"{n}__delta") for n, s in plain.items())))
    for length in sorted({s.length for s in lists.values()}):
        newest = Window.partitionBy(*group).orderBy(*(F.col(c).desc() for c in ORDER))
        top = rows.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= length)
        parts.append(top.groupBy(*group).agg(*(s.delta().alias(f"{n}__delta") for n, s in lists.items() if s.length == length)))
    if len(parts) == 1:
        return parts[0]
    return stitch(parts, group)


def seed(delta: DataFrame, family: Family) -> DataFrame:
    """The first load: the cumulative state is the delta."""
    return delta.withColumns({n: F.col(f"{n}__delta") for n in family.columns})


def day_number(day: str) -> int:
    return (date.fromisoformat(day) - date(1970, 1, 1)).days


def merge(previous: DataFrame, delta: DataFrame, family: Family, keys: Sequence[str]) -> DataFrame:
    """Cumulative states and one period's deltas: every key of either, with both columns kept."""
    old = previous.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(n).alias(f"__{n}") for n in family.columns))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    # a key that is null on both sides is the same key; the flags tell it from a missing side
    both = old.withColumn("__old", F.lit(1)).join(delta.withColumn("__new", F.lit(1)), same, "full_outer")
    out = [F.when(F.col("__new") == 1, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    for n, s in family.columns.items():
        d, o = F.col(f"{n}__delta"), F.col(f"__{n}")
        out += [d, s.merge(o, d).alias(n)]
    return both.select(*out)


def cumulate(deltas: DataFrame, family: Family, keys: Sequence[str], period: str = "ds", before: DataFrame | None = None) -> DataFrame:
    """Every period's cumulative states in one pass: a window over each key's periods instead of a loop of merges.

    ``before``: the states of each key at an earlier period (with that period), which count as its first row. Exact counts of distinct values
    are not sets here but numbers: every value counts in the period in which it is first seen, and the counts are added up.
    """
    rows = deltas.withColumn("__kept", F.lit(True))
    if before is not None:
        rows = before.select(*keys, period, *(F.col(n).alias(f"{n}__delta") for n in family.columns), F.lit(False).alias("__kept")).unionByName(rows)
    sets = [n for n, s in family.columns.items() if isinstance(s, Lifetime) and s.fn == "count_distinct"]
    if sets:
        firsts = [first_seen(rows.select(*keys, period, F.explode(f"{n}__delta").alias("v")), [*keys, "v"], period) for n in sets]
        news = [f.groupBy(*keys, period).agg(F.count(F.lit(1)).alias(f"{n}__new")) for n, f in zip(sets, firsts, strict=True)]
        rows = stitch([rows, *news], [*keys, period], zero=[f"{n}__new" for n in sets])
    life = Life(tuple(keys), period, F.datediff(F.to_date(F.substring(F.col(period), 1, 10)), F.lit("1970-01-01").cast("date")))
    anchors = {f"{n}__anchor": a for n, s in family.columns.items() if (a := s.anchor(F.col(f"{n}__delta"), life)) is not None}
    running = {n: s.running(F.col(f"{n}__delta"), life, F.col(f"{n}__anchor") if f"{n}__anchor" in anchors else None) for n, s in family.columns.items() if n not in sets}
    running |= {n: F.sum(f"{n}__new").over(life.all) for n in sets}
    states = rows.withColumns(anchors).select(*keys, period, "__kept", *(F.col(f"{n}__delta") for n in family.columns), *(running[n].alias(n) for n in family.columns))
    return (states if before is None else states.where("__kept")).drop("__kept")


def first_seen(rows: DataFrame, values: Sequence[str], period: str) -> DataFrame:
    """The period in which each value was first seen. Such tables merge by taking the lesser period, and grow with the values, not with
    values times periods."""
    return rows.groupBy(*values).agg(F.min(period).alias(period))


def running_distinct(events: DataFrame, keys: Sequence[str], value: str, period: str = "ds") -> DataFrame:
    """(keys, period, new, total): how many values of each key are first seen in a period, and up to it; periods without a new one have no
    row. No set is held, so a key may have any number of values: they are spread over all tasks by value."""
    rows = events.where(F.col(value).isNotNull()).select(*keys, value, period)
    new = first_seen(rows, [*keys, value], period).groupBy(*keys, period).agg(F.count(F.lit(1)).alias("new"))
    return new.withColumn("total", F.sum("new").over(Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)))


def render(states: DataFrame, family: Family, as_of: str | None = None, period: str = "ds") -> DataFrame:
    """States as readers see them; bitmaps end at ``as_of``, or at each row's own period."""
    day = F.lit(day_number(as_of)) if as_of else F.datediff(F.to_date(F.col(period)), F.lit("1970-01-01").cast("date"))

    def shown(n: str, s) -> Column:
        if isinstance(s, (BitmapActivity, PackedActivity)):
            return s.bits(F.col(n), s.last(day))
        return F.col(n) if isinstance(s, Lifetime) and s.fn == "count_distinct" and states.schema[n].dataType == LongType() else s.read(F.col(n))

    return states.withColumns({n: shown(n, s) for n, s in family.columns.items()})


def state_at(events: DataFrame, family: Family, day: str, period: str = "ds") -> DataFrame:
    """The newest state of each key at the end of a day, and its period: from the events up to then, as if they were one period."""
    dated = replace(family, columns={**family.columns, period: Lifetime("max", period)})
    return total(events.where(F.col(period) <= day), dated)


def as_of(states: DataFrame, keys: Sequence[str], day: str, period: str = "ds") -> DataFrame:
    """The newest of stored states of each key at the end of a day; no row for each key and day is ever made. Where states are not
    stored, ``state_at`` aggregates the events up to the day, which reads less than making all days' states first."""
    names = [c for c in states.columns if c not in keys]
    top = states.where(F.col(period) <= day).groupBy(*keys).agg(F.max_by(F.struct(*names), period).alias("s"))
    return top.select(*keys, "s.*")


def backfill(events: DataFrame, family: Family, keys: Sequence[str], start: str, end: str, before: DataFrame | None = None) -> DataFrame:
    """Deltas of [start, end] from the source in one job, and their cumulative states from the state at start - 1."""
    rows = events.where(F.col("ds").between(start, end))
    return cumulate(family_delta(rows, family), family, keys, before=before)


def cascade(stored: DataFrame, fresh: DataFrame, family: Family, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Cumulative states after a backfill of [start, end]: fresh deltas there, stored deltas elsewhere; no source is read."""
    delta = [*keys, "ds", *(f"{n}__delta" for n in family.columns)]
    outside = stored.where(~F.col("ds").between(start, end)).select(*delta)
    return cumulate(outside.unionByName(fresh.select(*delta)), family, keys)


def backfill_check(events: DataFrame, start: str, today: str, lookback_days: int = 30) -> DataFrame:
    """Whether a backfill starts before the lookback, or before the source's first day."""
    allowed = F.date_format(F.date_sub(F.to_date(F.lit(today)), lookback_days), "yyyy-MM-dd")
    return events.agg(F.min("ds").alias("first_ds")).select("first_ds", (F.lit(start) < allowed).alias("before_lookback"), (F.lit(start) < F.col("first_ds")).alias("before_source"))


def overwrite_period(df: DataFrame, path: str, period: str = "ds") -> None:
    """Writes periods so that a second run of the same period replaces it and leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


# --- the stitched table ---------------------------------------------------------------------------------------------------


def stitch(families: Sequence[DataFrame], keys: Sequence[str], zero: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One row for each key of any family; columns of an absent family are null (0 for those in ``zero``).

    A union and one grouped pass instead of a chain of full outer joins: one shuffle, null keys are keys like any other, and
    filters on the keys reach every scan. A column must belong to one family. A family has one row a key; where a load may have
    more, ``order`` names the columns (of each load) by which its newest row is taken, whole; they are not in the result.
    """
    if order:
        families = [newest_row(df, keys, order).drop(*order) for df in families]
    owned = [c for df in families for c in df.columns if c not in keys]
    if twice := sorted({c for c in owned if owned.count(c) > 1}):
        raise ValueError(f"{twice} are in several families")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)
    out = both if len(families) == 1 else both.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in owned)) if owned else both.distinct()
    return out.fillna({c: 0 for c in zero}) if zero else out


def stitch_joined(families: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The same by full outer joins, for families that are bucketed alike on their keys (no shuffle there). Rows with a null in their
    key, which such a join would not match, are stitched on their own."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    joined = reduce(lambda a, b: a.join(b, list(keys), "full_outer"), [df.where(known) for df in families])
    return joined.unionByName(stitch([df.where(~known) for df in families], keys))


def select_columns(families: Mapping[str, DataFrame], keys: Sequence[str], columns: Sequence[str], all_keys: bool = False) -> DataFrame:
    """The asked columns of a stitched table. Only families that hold one are read (``all_keys``: every family's keys too)."""
    chosen = []
    for df in families.values():
        own = [c for c in columns if c in df.columns]
        if own or all_keys or not columns:
            chosen.append(df.select(*keys, *own))
    return stitch(chosen, keys).select(*keys, *columns)


def only_keys(families: Sequence[DataFrame], key: str, *, equals=None, among: Sequence | DataFrame | None = None, between: tuple | None = None) -> list[DataFrame]:
    """A key filter on every family before the stitch, where it reaches the scan. A DataFrame of keys is a semi join."""

    def keep(df: DataFrame) -> DataFrame:
        if equals is not None:
            df = df.where(F.col(key) == equals)
        if isinstance(among, DataFrame):
            df = df.join(among.select(key), key, "left_semi")
        elif among is not None:
            df = df.where(F.col(key).isin(list(among)))
        return df if between is None else df.where(F.col(key).between(*between))

    return [keep(df) for df in families]


def newest_row(load: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key of a load, the newest in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return load.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def derive(df: DataFrame, derived: Mapping[str, str]) -> DataFrame:
    """Derived columns over the stitched ones; write divisions with try_divide, so that nothing divided by zero is null."""
    return df.withColumns({n: F.expr(e) for n, e in derived.items()})


def total(events: DataFrame, family: Family) -> DataFrame:
    """The states of one whole range of events, as if it were a single period: no state of a day in between is made."""
    whole = family_delta(events, family, ())
    return whole.select(*family.keys.values(), *(F.col(f"{n}__delta").alias(n) for n in family.columns))


def build(events: DataFrame, table: EntityTable, day: str) -> DataFrame:
    """A whole table at the end of a day: each family aggregated on its own, stitched, with derived columns."""
    rows = events.where(F.col("ds") <= day)
    keys = list(table.primary_key)
    parts = [render(total(rows, f), f, day).select(*keys, *f.columns) for f in table.families]
    return derive(stitch(parts, keys, table.zero), table.derived)
