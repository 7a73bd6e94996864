"""The semantic layer: metrics by dimensions, over entity tables and event logs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric(source: DataFrame, measures: Mapping[str, str], dims: Sequence[str] = (), where: str | None = None) -> DataFrame:
    """Aggregate expressions by dimensions; without dimensions one row."""
    rows = source if where is None else source.where(where)
    return rows.groupBy(*dims).agg(*(F.expr(e).alias(n) for n, e in measures.items()))


def with_dimension(facts: DataFrame, entity: DataFrame, on: Mapping[str, str], dims: Mapping[str, str], prefix: str = "") -> DataFrame:
    """Facts with an entity's dimensions (name in the result to source column), looked up by key; absent keys give null.

    ``on`` maps the fact's column to the entity's key. The same entity may be joined again under another role. Spark
    broadcasts the entity table if its size allows.
    """
    keys = {f: f"__{prefix}{e}" for f, e in on.items()}
    side = entity.select(*(F.col(e).alias(f"__{prefix}{e}") for e in on.values()), *(F.expr(c).alias(prefix + n) for n, c in dims.items()))
    return facts.join(side, [F.col(f) == F.col(k) for f, k in keys.items()], "left").drop(*keys.values())


def composed(parts: Sequence[DataFrame], dims: Sequence[str], name: str, expression: str) -> DataFrame:
    """A metric of metrics: each is aggregated on its own, they meet on the dimensions, then the expression is applied."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(dims), "full_outer")
    return out.withColumn(name, F.expr(expression))


def reconcile(a: DataFrame, b: DataFrame, dims: Sequence[str], column: str) -> DataFrame:
    """Two calculations of one metric and their difference, for each value of the dimensions."""
    left, right = a.withColumnRenamed(column, "first"), b.withColumnRenamed(column, "second")
    return left.join(right, list(dims), "full_outer").withColumn("difference", F.coalesce("first", F.lit(0)) - F.coalesce("second", F.lit(0)))


def cube(source: DataFrame, dims: Sequence[str], measures: Mapping[str, str], kind: str = "groupBy") -> DataFrame:
    """Precomputed measures by dimensions: ``groupBy``, or ``cube`` and ``rollup`` with the number of the grouping set."""
    more = [] if kind == "groupBy" else [F.grouping_id().alias("grouping_id")]
    return getattr(source, kind)(*dims).agg(*(F.expr(e).alias(n) for n, e in measures.items()), *more)


#: How a cube's measures are aggregated again: by name of the function, or for sketches what is read from their union.
AGAIN = {
    "sum": F.sum, "min": F.min, "max": F.max,
    "distinct": lambda m: F.theta_sketch_estimate(F.theta_union_agg(m)),
}


def from_cube(pre: DataFrame, cube_dims: Sequence[str], dims: Sequence[str], again: Mapping[str, str | float]) -> DataFrame:
    """A query answered from a cube: its dimensions must be among the cube's, its measures sums, counts, minima or maxima (``again``: measure
    to sum, min or max), or sketches: ``distinct`` reads a distinct count from theta sketches, a number from 0 to 1 that percentile from
    KLL sketches."""
    if not set(dims) <= set(cube_dims):
        raise ValueError(f"the cube has no {sorted(set(dims) - set(cube_dims))}")
    if bad := [f for f in again.values() if isinstance(f, str) and f not in AGAIN]:
        raise ValueError(f"{bad} cannot be aggregated again")

    def read(m: str, f: str | float) -> Column:
        return AGAIN[f](F.col(m)) if isinstance(f, str) else F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(m), F.lit(float(f)))

    return pre.groupBy(*dims).agg(*(read(m, f).alias(m) for m, f in again.items()))


def value_slices(facts: DataFrame, column: str, size: int) -> Column:
    """A slice for each value, in the values' order. Of values that lie between two bounds there are at most 5/8 of ``size``, as the percentiles that
    bound them are off by no more than 1/accuracy of the rows; a value that is a bound has a slice to itself, however often it occurs."""
    n = facts.where(F.col(column).isNotNull()).count()
    parts = math.ceil(2 * n / size)
    marks = [k / parts for k in range(1, parts)]
    found = facts.agg(F.percentile_approx(column, marks, 8 * parts)).first()[0] if marks else None
    bounds = np.unique(np.array(found or [], dtype="float64"))

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype="float64")
        return pd.Series(np.searchsorted(bounds, v, "left") + np.searchsorted(bounds, v, "right"))

    return of(F.col(column).cast("double"))


def sliced_cube(source: DataFrame, dims: Sequence[str], measures: Mapping[str, str], slices: Mapping[str, Column]) -> DataFrame:
    """A cube whose sketches are exact however many facts there are. A sketch has a row for each slice of its facts (``slices``: by measure),
    of which there are so many that none outgrows it; the other measures are in rows without a slice."""
    plain = {m: e for m, e in measures.items() if m not in slices}
    parts = [cube(source, dims, plain)]
    for m, s in slices.items():
        facts = source.withColumn("slice", s.cast("int"))
        parts.append(cube(facts.where("slice is not null").repartition("slice"), [*dims, "slice"], {m: measures[m]}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def from_sliced_cube(pre: DataFrame, cube_dims: Sequence[str], dims: Sequence[str], again: Mapping[str, str | float], size: int = 12, most: int = 4096) -> DataFrame:
    """``from_cube`` of a ``sliced_cube``. Distinct counts of slices add up (``size``: that of their sketches, as a power of two). A percentile
    lies in the slice in which the running count of values comes to its rank, and is read there (``most``: as many values as these sketches hold exactly)."""
    plain = {m: f for m, f in again.items() if isinstance(f, str) and f != "distinct"}
    parts = [from_cube(pre.where("slice is null"), cube_dims, dims, plain)]
    for m, f in again.items():
        here = pre.where(F.col(m).isNotNull()).groupBy(*dims, "slice")
        if f == "distinct":
            counts = here.agg(F.theta_sketch_estimate(F.theta_union_agg(m, size)).alias(m))
            parts.append(counts.groupBy(*dims).agg(F.sum(m).alias(m)))
        elif m not in plain:
            one = here.agg(F.kll_merge_agg_double(m).alias("s")).withColumn("n", F.kll_sketch_get_n_double("s")).where("n > 0")
            group = Window.partitionBy(*dims)
            upto = one.withColumns({"upto": F.sum("n").over(group.orderBy("slice")), "all": F.sum("n").over(group)})
            at = F.greatest(F.ceil(F.lit(Decimal(str(f))) * F.col("all")).cast("long"), F.lit(1)) - F.col("upto") + F.col("n")
            within = upto.withColumn("at", at).where("at between 1 and n")
            # ranks must be constants: a grid of them as fine as the largest sketch hits every row of it, nearest to the middle between two ranks
            grid = F.split(F.lit(",".join(str((i + 0.5) / most) for i in range(most))), ",").cast("array<double>")
            step = F.floor((2 * F.col("at") - 1) * most / (2 * F.col("n"))).cast("int")
            parts.append(within.select(*dims, F.get(F.kll_sketch_get_quantile_double("s", grid), step).alias(m)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.groupBy(*dims).agg(*(F.max(m).alias(m) for m in again))


@dataclass(frozen=True)
class Cube:
    """A written cube: its rows by its dimensions, with the measures it has, and how many rows there are."""

    rows: DataFrame
    dims: tuple[str, ...]
    measures: tuple[str, ...]
    size: int


def smallest_cube(cubes: Sequence[Cube], dims: Sequence[str], measures: Sequence[str]) -> Cube:
    """Of the cubes that have all dimensions and measures of a question the one with the fewest rows."""
    able = [c for c in cubes if set(dims) <= set(c.dims) and set(measures) <= set(c.measures)]
    if not able:
        raise ValueError(f"no cube has {sorted({*dims, *measures})}")
    return min(able, key=lambda c: c.size)


def history(steps: DataFrame, keys: Sequence[str], periods: Sequence[str], attributes: Sequence[str], measures: Sequence[str], period: str = "ds") -> DataFrame:
    """Totals of measures by attributes as they were, for each of some periods: (period, attributes, measures, entities).

    ``steps`` has a row for each change of an entity: keys, period, attributes and measures as they are from then on; a null attribute is a
    value like any other. Each change takes the entity's measures from the total of its attributes before and adds them to that of its
    attributes now, so rows grow with changes, never with entities times periods. Measures are added up in decimals, which do not drift.
    """
    life = Window.partitionBy(*keys).orderBy(period)
    exact = {m: F.col(m).cast("decimal(28, 6)") for m in measures}
    before = {f"__{c}": F.lag(exact.get(c, F.col(c))).over(life) for c in (*attributes, *measures)}
    moved = steps.withColumns(before).withColumn("__first", F.row_number().over(life) == 1)
    added = moved.select(period, *attributes, *(F.coalesce(exact[m], F.lit(0)).alias(m) for m in measures), F.lit(1).alias("entities"))
    taken = moved.where("not __first").select(period, *(F.col(f"__{a}").alias(a) for a in attributes), *((-F.coalesce(F.col(f"__{m}"), F.lit(0))).alias(m) for m in measures), F.lit(-1).alias("entities"))
    changes = added.unionByName(taken).groupBy(period, *attributes).agg(*(F.sum(m).alias(m) for m in (*measures, "entities")))
    # every period of the question has a row for all attributes there are, so that what does not change is carried on
    seen = changes.select(*attributes).distinct().select(F.explode(F.array(*map(F.lit, periods))).alias(period), *attributes)
    marks = changes.withColumn("__asked", F.lit(False)).unionByName(seen.withColumns({**{m: F.lit(0) for m in measures}, "entities": F.lit(0), "__asked": F.lit(True)}))
    upto = Window.partitionBy(*attributes).orderBy(period).rangeBetween(Window.unboundedPreceding, 0)
    totals = marks.withColumns({m: F.sum(m).over(upto) for m in (*measures, "entities")})
    return totals.where("__asked and entities > 0").select(period, *attributes, *(F.col(m).cast("double").alias(m) for m in measures), F.col("entities").cast("long").alias("entities"))


def as_they_were(facts: DataFrame, entity: DataFrame, on: Mapping[str, str], dims: Sequence[str], time: str, since: str) -> DataFrame:
    """Facts with an entity's dimensions as they were at each fact's time: of the entity's rows up to then (column ``since``) the newest.
    Absent entities and facts before the first row give null.

    Facts and the entity's rows are put in one table in order of time, and each fact takes what the last row before it left: one shuffle,
    and no fact meets more than one row. Facts without a key keep their own partitions, being no entity's.
    """
    keys = list(on)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    left = facts.where(known).withColumns({"__at": F.col(time), "__dims": F.lit(None), "__order": F.lit(1)})
    right = entity.select(*(F.col(e).alias(f) for f, e in on.items()), F.col(since).alias("__at"), F.struct(*dims).alias("__dims"), F.lit(0).alias("__order"))
    both = left.drop("__dims").unionByName(right, allowMissingColumns=True)
    life = Window.partitionBy(*keys).orderBy("__at", "__order").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__dims", F.last("__dims", ignorenulls=True).over(life)).where("__order = 1")
    names = [F.col(f"__dims.{c}").alias(c) for c in dims]
    rest = facts.where(~known).select(*facts.columns, *(F.lit(None).cast(entity.schema[c].dataType).alias(c) for c in dims))
    return seen.select(*facts.columns, *names).unionByName(rest)


def logs_joined(*_: DataFrame) -> DataFrame:
    """Two event logs are never joined through an entity: build an entity table from each and stitch them."""
    raise ValueError("two event logs meet only in an entity table")
