"""States: sketches, packed bits, counts of distinct values over time, and what is read from them."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.states import Lifetime, PackedActivity, current_streak, longest_streak
from tessella.operators import activity, entity, metrics
from tessella.plans.spec import Family

DAY0 = 19700


def event_rows(spark, rows):
    """(id, event_id, day, hour, value)"""
    df = spark.createDataFrame(rows, "id long, event_id long, day int, hour int, value double")
    at = F.timestamp_seconds(F.col("day").cast("long") * 86400 + F.col("hour") * 3600)
    return df.withColumns({"event_timestamp": at, "ds": F.date_format(at, "yyyy-MM-dd")})


def some(rng, n, users, days):
    return [(rng.choice([None, *range(users)]), i, DAY0 + rng.randrange(days), rng.randrange(24), float(rng.randrange(50))) for i in range(n)]


@pytest.mark.parametrize("window", [1, 10, 63, 64, 65, 130])
@pytest.mark.parametrize("granularity", ["day", "hour"])
def test_packed_bits(spark, window, granularity):
    """Delta, merge in any order, combine and running states all draw the same bits, at the last day and at later ones."""
    rng = random.Random(window)
    kind = PackedActivity(granularity, window)
    rows = some(rng, 300, 6, 150 if granularity == "day" else 12)
    f = Family("f", {"a": kind}, {"id": "id"})
    df = event_rows(spark, rows)
    slots = {}
    for i, _, day, hour, _ in rows:
        slots.setdefault(i, set()).add(day if granularity == "day" else day * 24 + hour)
    last_day = max(r[2] for r in rows)

    def want(day):
        last = day if granularity == "day" else day * 24 + 23
        return {i: "".join("1" if s in own else "0" for s in range(last - window + 1, last + 1)) for i, own in slots.items()}

    deltas = entity.family_delta(df, f)
    ways = [
        entity.total(df, f),
        entity.as_of(entity.cumulate(deltas, f, ["id"]), ["id"], "9999"),
        deltas.groupBy("id").agg(kind.combine(F.col("a__delta")).alias("a")),
    ]
    odd, even = (entity.total(df.where(F.col("event_id") % 2 == k), f) for k in (0, 1))
    ways.append(entity.merge(even, odd.withColumnRenamed("a", "a__delta"), f, ["id"]))
    for states in ways:
        for later in (0, 3):
            last = last_day + later
            shown = states.select("id", kind.bits(F.col("a"), kind.last(F.lit(last))).alias("bits"), kind.active(F.col("a"), kind.last(F.lit(last))).alias("n"))
            got = {r.id: (r.bits, r.n) for r in shown.collect()}
            assert got == {i: (b, b.count("1")) for i, b in want(last).items()}


def test_streaks_by_bits(spark):
    rng = random.Random(3)
    words = [0, -1, (1 << 63) - 1, -(1 << 63), 1, 2, 3, -2] + [rng.getrandbits(64) - (1 << 63) | rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    rows = spark.createDataFrame([(w,) for w in words], "w long").select("w", current_streak(F.col("w")).alias("c"), longest_streak(F.col("w")).alias("l")).collect()
    for r in rows:
        bits = f"{r.w % (1 << 64):064b}"
        assert r.c == len(bits) - len(bits.rstrip("1")) and r.l == max(map(len, bits.split("0")))


def test_states_answer_like_events(spark):
    """Active users, streaks and churn from packed states and from sketches equal those from the events."""
    rng = random.Random(4)
    df = event_rows(spark, [(rng.randrange(40) if rng.random() < 0.98 else None, i, DAY0 + int(rng.triangular(0, 30, 25)), 1, 1.0) for i in range(260)])
    kind, last = PackedActivity("day", 60), DAY0 + 29
    f = Family("f", {"a": kind}, {"id": "id"})
    states, days = entity.total(df, f).where("id is not null"), activity.active_days(df, "id")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(activity.days_of(states, "id", "a", kind, last), days)
    assert same(activity.streaks(days, "id", last).select("id", "longest", "current"), activity.streaks_from_states(states, "id", "a", kind, last))
    sketches = activity.sketches_by_day(df, "id")
    for width in (1, 3, 7):
        want = activity.churn(days, "id", last, width)
        assert same(want, activity.churn_from_states(states, "id", "a", kind, last, width)) and same(want, activity.churn_from_sketches(sketches, last, width))
    assert same(activity.retention(days, "id"), activity.retention_from_sketches(sketches))


def test_sketches_in_slices_are_exact(spark):
    """Many more entities than a sketch holds: churn, retention and the reach of two families equal those from the events."""
    size, last = 10, DAY0 + 11
    rows = spark.range(12_000).select((F.col("id") % 5_000).alias("id"), (F.xxhash64("id") % 6).alias("x"))
    df = rows.select("id", F.date_format(F.date_from_unix_date((F.lit(DAY0 + 6) + F.col("x")).cast("int")), "yyyy-MM-dd").alias("ds"))
    days, sketches = activity.active_days(df, "id"), activity.sketches_by_day(df, "id", size)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert sketches.select("slice").distinct().count() > 5
    assert same(activity.churn(days, "id", last, 3), activity.churn_from_sketches(sketches, last, 3, size))
    assert same(activity.retention(days, "id"), activity.retention_from_sketches(sketches, size))


def test_reach_beyond_one_sketch(spark, tmp_path):
    from tessella.queries import QUERIES

    at = F.lit("2024-01-05 10:00:00").cast("timestamp_ntz")
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 20_000).alias("user_id"), F.when(F.col("id") < 15_000, "view").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["any"], r["all"]) for r in QUERIES["a3_reached_by_families"](spark, str(tmp_path)).collect()] == [(20_000, 10_000)]


def test_sketches_within_their_bounds(spark):
    """More values than a theta sketch keeps: union, intersection and difference within four standard errors; a percentile's rank within three."""
    size, n = 10, 60_000
    df = spark.range(n).select("id", (F.col("id") % 7).alias("g"), F.rand(5).alias("x"))
    a, b = (F.theta_sketch_agg(F.when(c, F.col("id")), size) for c in (F.col("id") < 40_000, F.col("id") >= 20_000))
    sets = df.agg(a.alias("a"), b.alias("b"))
    got = sets.select(*(c.alias(k) for k, c in activity.reached([F.col("a"), F.col("b")]).items()), F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("only")).first()
    error = 4 / (1 << size) ** 0.5
    assert abs(got["any"] - n) < error * n and abs(got["all"] - 20_000) < error * n and abs(got["only"] - 20_000) < error * n
    f = Family("f", {"p": Lifetime("percentile", "x", rank=0.9)}, {"g": "g"})
    parts = [df.where(F.col("id") % 3 == k).groupBy("g").agg(f.columns["p"].delta().alias("p")) for k in range(3)]
    both = parts[0].union(parts[1]).union(parts[2]).groupBy("g").agg(f.columns["p"].combine(F.col("p")).alias("p"))
    values = {}
    for r in df.select("g", "x").collect():
        values.setdefault(r.g, []).append(r.x)
    for r in both.select("g", f.columns["p"].read(F.col("p")).alias("p")).collect():
        own = sorted(values[r.g])
        assert abs(bisect.bisect_right(own, r.p) / len(own) - 0.9) < 0.03


def test_distinct_values_over_time(spark):
    """Running counts equal unions of sets, with a state before and null values and keys, and no window holds a set."""
    rng = random.Random(5)
    rows = some(rng, 400, 5, 12)
    df = event_rows(spark, rows).withColumn("v", F.when(F.col("value") > 3, F.col("value")))
    f = Family("f", {"d": Lifetime("count_distinct", "v"), "n": Lifetime("count")}, {"id": "id"})
    states = entity.cumulate(entity.family_delta(df, f), f, ["id"])
    name = {r.day: r.ds for r in df.select("day", "ds").distinct().collect()}
    seen = lambda i, day: {v for j, _, t, _, v in rows if j == i and t <= day and v > 3}
    want = {(i, name[t]): len(seen(i, t)) for i, _, t, _, _ in rows}
    assert {(r.id, r.ds): r.d for r in states.collect()} == want
    assert {(r.id, r.ds): r.d for r in entity.render(states, f).collect()} == want
    assert "collect_list" not in states._jdf.queryExecution().executedPlan().toString()
    mid = name[DAY0 + 6]
    later = entity.backfill(df, f, ["id"], name[DAY0 + 7], name[DAY0 + 11], entity.state_at(df, f, mid))
    assert {(r.id, r.ds): r.d for r in later.collect()} == {k: v for k, v in want.items() if k[1] > mid}
    total = {(r.id, r.ds): r.total for r in entity.running_distinct(df, ["id"], "v").collect()}
    assert total == {(i, name[t]): len(seen(i, t)) for i, t in {(i, t) for i, _, t, _, _ in rows} if seen(i, t) - seen(i, t - 1)}


def test_percentiles_of_nothing(spark):
    f = Family("f", {"p": Lifetime("percentile", "value", "value > 1000"), "t": Lifetime("theta", "value", "value > 1000")}, {"id": "id"})
    got = entity.render(entity.total(event_rows(spark, some(random.Random(1), 30, 3, 3)), f), f, "2024-01-01").collect()
    assert all(r.p is None and r.t == 0 for r in got) and got
    with pytest.raises(ValueError):
        Lifetime("mode", "value")


def test_history_by_dimension(spark):
    """Entities that change their segment, come late, or have none."""
    rng = random.Random(6)
    steps, now = [], {}
    for day in range(12):
        for i in range(15):
            if rng.random() < 0.3:
                old = now.get(i, (None, 0.0))
                now[i] = (rng.choice(["a", "b", None]), old[1] + rng.randrange(5))
                steps.append((i, f"d{day:02d}", *now[i]))
    df = spark.createDataFrame(steps, "id long, ds string, segment string, revenue double")
    days = [f"d{d:02d}" for d in (0, 4, 5, 11, 20)]
    got = {(r.ds, r.segment): (r.revenue, r.entities) for r in metrics.history(df, ["id"], days, ["segment"], ["revenue"]).collect()}
    want = {}
    for day in days:
        at = {i: (s, v) for i, d, s, v in steps if d <= day}  # steps are in order of days
        for s, v in at.values():
            r = want.get((day, s), (0.0, 0))
            want[day, s] = (r[0] + v, r[1] + 1)
    assert got == want


def test_dimensions_as_they_were(spark):
    facts = spark.createDataFrame([(1, 5, "x"), (1, 10, "y"), (1, 2, "z"), (2, 9, "n"), (None, 9, "u")], "id long, t long, f string")
    dims = spark.createDataFrame([(1, 3, "a"), (1, 10, "b"), (3, 1, "c"), (None, 1, "d")], "k long, since long, tier string")
    got = {(r.f, r.tier) for r in metrics.as_they_were(facts, dims, {"id": "k"}, ["tier"], "t", "since").collect()}
    assert got == {("x", "a"), ("y", "b"), ("z", None), ("n", None), ("u", None)}


def test_smallest_cube(spark):
    rows = spark.range(1)
    a, b = metrics.Cube(rows, ("x", "y", "z"), ("n", "s"), 900), metrics.Cube(rows, ("x", "y"), ("n",), 40)
    assert metrics.smallest_cube([a, b], ["x"], ["n"]) is b and metrics.smallest_cube([a, b], ["x"], ["s"]) is a
    with pytest.raises(ValueError):
        metrics.smallest_cube([a, b], ["w"], ["n"])
    with pytest.raises(ValueError):
        metrics.from_cube(rows, ["x"], ["x"], {"n": "avg"})


def test_cubes_of_sketches_in_slices_are_exact(spark):
    """More entities and values in a group than a sketch holds, one value very often, a group without values: counts and percentiles are exact."""
    from tessella.operators import metrics

    price = F.when(F.col("id") % 5 == 0, 7.5).when(F.col("id") % 3 != 2, (F.xxhash64("id") % 100_000).cast("double"))
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("h"), (F.col("id") % 9_000).alias("who"), price.alias("price"))
    measures = {"n": "count(*)", "users": "theta_sketch_agg(who, 10)", "prices": "kll_sketch_agg_double(price, 1024)"}
    slices = {"users": activity.slice_of("who", activity.slices_for(rows, "who", 10)), "prices": metrics.value_slices(rows, "price", 1024)}
    pre = metrics.sliced_cube(rows, ["g", "h"], measures, slices).localCheckpoint()
    for q in (0.01, 0.5, 0.95, 1.0):
        got = metrics.from_sliced_cube(pre, ["g", "h"], ["g"], {"n": "sum", "users": "distinct", "prices": q}, 10, 1024)
        want = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("who").alias("users"), F.expr(f"percentile_disc({q}) within group (order by price)").alias("prices"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
