"""Activity of entities: active users, streaks, churn, retention."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.states import PackedActivity, current_streak, longest_streak, masked

EPOCH = "1970-01-01"


def active_days(events: DataFrame, key: str) -> DataFrame:
    """(key, day number), once each."""
    return events.select(key, F.datediff(F.to_date("ds"), F.lit(EPOCH).cast("date")).alias("day")).where(F.col(key).isNotNull()).distinct()


def active_users(days: DataFrame, key: str, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """For each day of the log: entities active in the trailing windows of days.

    An active day counts on the days from itself up to the entity's next active day or the window's end, whichever is
    first; so each entity adds +1 and -1 at two days and a running sum does the rest. Rows stay proportional to active days.
    """
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    calendar = span.select(F.explode(F.sequence("a", "z")).alias("day"))
    after = F.lead("day").over(Window.partitionBy(key).orderBy("day"))
    out = calendar
    for w in windows:
        ends = days.select("day", F.least(F.coalesce(after, F.col("day") + w), F.col("day") + w).alias("end"))
        steps = ends.select("day", F.lit(1).alias("s")).union(ends.select("end", F.lit(-1))).groupBy("day").agg(F.sum("s").alias("s"))
        run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a calendar day
        out = out.join(calendar.join(steps, "day", "left").select("day", F.sum(F.coalesce("s", F.lit(0))).over(run).alias(f"active_{w}")), "day")
    return out


def streaks(days: DataFrame, key: str, last: int) -> DataFrame:
    """Longest run of active days of each entity, and the run that ends on day ``last`` (0 if none does)."""
    island = F.col("day") - F.row_number().over(Window.partitionBy(key).orderBy("day"))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count(F.lit(1)).alias("length"), F.max("day").alias("end"))
    return runs.groupBy(key).agg(F.max("length").alias("longest"), F.coalesce(F.max(F.when(F.col("end") == last, F.col("length"))), F.lit(0)).alias("current"))


def churn(days: DataFrame, key: str, last: int, width: int) -> DataFrame:
    """Entities by what they did in the window that ends on ``last`` against the window before: retained, churned, new
    (never active before) or resurrected."""
    flags = days.where(F.col("day") <= last).groupBy(key).agg(
        F.max((F.col("day") > last - width).cast("int")).alias("now"),
        F.max(((F.col("day") <= last - width) & (F.col("day") > last - 2 * width)).cast("int")).alias("before"),
        F.max((F.col("day") <= last - 2 * width).cast("int")).alias("ever"),
    )
    state = F.when((F.col("now") == 1) & (F.col("before") == 1), "retained").when(F.col("before") == 1, "churned").when((F.col("now") == 1) & (F.col("ever") == 1), "resurrected").when(F.col("now") == 1, "new").otherwise("inactive")
    return flags.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("entities"))


def active_slots(bits: Column) -> Column:
    """Number of ones of a bit string."""
    return F.length(F.replace(bits, F.lit("0"), F.lit("")))


def retention(days: DataFrame, key: str) -> DataFrame:
    """Entities by first active day and days since then."""
    first = days.withColumn("cohort", F.min("day").over(Window.partitionBy(key)))
    return first.groupBy("cohort", (F.col("day") - F.col("cohort")).alias("offset")).agg(F.count(F.lit(1)).alias("entities"))


# --- from states: no event is read again ----------------------------------------------------------------------------------


def slices_for(events: DataFrame, key: str, size: int) -> int:
    """In how many slices by hash the entities are dealt out so that the set of a slice, over all days, fills about half a sketch of that size."""
    n = events.agg(F.approx_count_distinct(key)).first()[0]
    return max(1, math.ceil(n / (1 << size - 1)))


def slice_of(key: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices)).alias("slice")


def sketches_by_day(events: DataFrame, key: str, size: int = 12) -> DataFrame:
    """(day, slice, s): theta sketches of each day's active entities, the logarithm of whose size is given. An entity has one slice on all days,
    and there are so many slices that no set outgrows its sketch: what is read slice by slice and added up is exact."""
    known = events.where(F.col(key).isNotNull())
    day = F.datediff(F.to_date("ds"), F.lit(EPOCH).cast("date")).alias("day")
    return known.groupBy(day, slice_of(key, slices_for(known, key, size))).agg(F.theta_sketch_agg(key, size).alias("s"))


def churn_from_sketches(days: DataFrame, last: int, width: int, size: int = 12) -> DataFrame:
    """``churn`` from the sketches of days alone: retained, churned, resurrected, new and inactive entities by unions, intersections and
    differences within each slice. ``size``: the sketches' own, which their unions need too."""
    def of(condition: Column) -> Column:
        return F.coalesce(F.theta_union_agg(F.when(condition, F.col("s")), size), F.theta_sketch_agg(F.lit(None).cast("long"), size))

    day = F.col("day")
    sets = days.where(day <= last).groupBy("slice").agg(of(day > last - width).alias("now"), of((day <= last - width) & (day > last - 2 * width)).alias("before"), of(day <= last - 2 * width).alias("ever"))
    both, only = F.theta_intersection, F.theta_difference
    kinds = {"retained": both("now", "before"), "churned": only("before", "now"), "resurrected": both(only("now", "before"), F.col("ever")), "new": only(only("now", "before"), F.col("ever")), "inactive": only(only("ever", "now"), F.col("before"))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("state"), F.theta_sketch_estimate(s).alias("entities")) for k, s in kinds.items()))).alias("r")
    return sets.select(each).groupBy("r.state").agg(F.sum("r.entities").alias("entities")).where("entities > 0")


def retention_from_sketches(days: DataFrame, size: int = 12) -> DataFrame:
    """``retention`` from the sketches of days alone. A cohort is a day's set without those of all days before; it meets each later day's set
    of its slice. Each cohort goes to all days from its own on; what is joined is a sketch a day and slice."""
    own = Window.partitionBy("slice")
    earlier = own.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.theta_union_agg("s", size).over(earlier), F.theta_sketch_agg(F.lit(None).cast("long"), size).over(earlier))
    cohorts = days.select("slice", F.col("day").alias("cohort"), F.theta_difference("s", seen).alias("c"), F.max("day").over(own).alias("end"))
    met = cohorts.select("slice", "cohort", "c", F.explode(F.sequence("cohort", "end")).alias("day")).join(days, ["slice", "day"])
    here = met.select("cohort", (F.col("day") - F.col("cohort")).alias("offset"), F.theta_sketch_estimate(F.theta_intersection("c", "s")).alias("n"))
    return here.groupBy("cohort", "offset").agg(F.sum("n").alias("entities")).where("entities > 0")


def reached(sketches: Sequence[Column], size: int = 12) -> dict[str, Column]:
    """How many entities several sketches hold together, and all of them hold. ``size``: the sketches' own, which their union needs too."""
    union, common = reduce(lambda a, b: F.theta_union(a, b, size), sketches), reduce(F.theta_intersection, sketches)
    return {"any": F.theta_sketch_estimate(union), "all": F.theta_sketch_estimate(common)}


def days_of(states: DataFrame, key: str, column: str, activity: PackedActivity, last: int) -> DataFrame:
    """(key, day number) of the active days that packed states hold, of the window that ends on ``last``."""

    def slots(back: int) -> Column:
        """Of the 64 slots that end ``back`` before the last, the active ones."""
        word, width = activity.word(F.col(column), F.lit(last), back), min(64, activity.window - back)
        every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.getbit(word, i) == 1, F.lit(last - back) - i))
        return F.filter(every, lambda s: s.isNotNull())

    return states.where(F.col(key).isNotNull()).select(key, F.explode(F.concat(*(slots(k) for k in range(0, activity.window, 64)))).alias("day"))


def streaks_from_states(states: DataFrame, key: str, column: str, activity: PackedActivity, last: int) -> DataFrame:
    """``streaks`` by bit operations on packed states, whose window must have 64 days at most: streaks are those within it."""
    if activity.window > 64:
        raise ValueError("streaks are read from one word: a window of 64 slots at most")
    word = masked(activity.word(F.col(column), F.lit(last)), activity.window)
    found = states.select(key, word.alias("x")).where("x <> 0")
    return found.select(key, longest_streak(F.col("x")).cast("long").alias("longest"), current_streak(F.col("x")).cast("long").alias("current"))


def churn_from_states(states: DataFrame, key: str, column: str, activity: PackedActivity, last: int, width: int) -> DataFrame:
    """``churn`` by counts of bits in the two windows and before, as far as the states' own window goes back."""
    n = lambda w, back: activity.active(F.col(column), F.lit(last), w, back) > 0
    flags = states.select(n(width, 0).alias("now"), n(width, width).alias("before"), n(activity.window - 2 * width, 2 * width).alias("ever")).where("now or before or ever")
    state = F.when(F.col("now") & F.col("before"), "retained").when(F.col("before"), "churned").when(F.col("now") & F.col("ever"), "resurrected").when(F.col("now"), "new").otherwise("inactive")
    return flags.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("entities"))
