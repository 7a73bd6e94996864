"""Queries on column families: deltas, states, merges, backfill."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PackedActivity, PrependList
from tessella.operators import entity, stored
from tessella.plans.spec import Family
from tessella.registered.base import BEHAVIOUR, DAY, EV, KEYS, bits_sql, ev, query, states, work_dir

BUY = "event_type = 'purchase'"
ID = ["entity_id"]


def fam(where=BUY, **columns) -> Family:
    return Family("f", columns, KEYS, where)


def delta(spark, d, family, *keep):
    return entity.family_delta(ev(spark, d), family).select("entity_id", "ds", *keep)


def r2(c, a=None):
    return F.round(c, 2).alias(a or c)


PER = "user_id AS entity_id, ds"


@query(f"WITH {EV} SELECT event_id, user_id AS entity_id, value FROM ev WHERE {BUY}")
def c1_map_keys(spark, d):
    return entity.map_keys(ev(spark, d).where(BUY), KEYS).select("event_id", "entity_id", "value")


@query(f"WITH {EV} SELECT {PER}, round(sum(value), 2) AS spend, count(*) AS purchases, max(value) AS top FROM ev WHERE {BUY} GROUP BY ALL")
def c2_family_delta(spark, d):
    f = fam(spend=Lifetime("sum", "value"), purchases=Lifetime("count"), top=Lifetime("max", "value"))
    return delta(spark, d, f, r2("spend__delta", "spend"), F.col("purchases__delta").alias("purchases"), F.col("top__delta").alias("top"))


@query(f"WITH {EV} SELECT {PER}, round(sum(value), 2) AS s, count(*) AS n, count(k) FILTER (WHERE k <> '3') AS nk FROM ev WHERE {BUY} GROUP BY ALL")
def c3_sum_count(spark, d):
    f = fam(s=Lifetime("sum", "value"), n=Lifetime("count"), nk=Lifetime("count", "nullif(k, '3')"))
    return delta(spark, d, f, r2("s__delta", "s"), F.col("n__delta").alias("n"), F.col("nk__delta").alias("nk"))


@query(f"WITH {EV} SELECT {PER}, min(value) AS low, max(value) AS high FROM ev WHERE {BUY} GROUP BY ALL")
def c4_min_max(spark, d):
    f = fam(low=Lifetime("min", "value"), high=Lifetime("max", "value"))
    return delta(spark, d, f, F.col("low__delta").alias("low"), F.col("high__delta").alias("high"))


def whole(spark, d, family, *keep, day="2024-01-30"):
    """The family's columns at the end of the log, as readers see them."""
    s = entity.as_of(states(spark, d, family), ID, day)
    return entity.render(s, family, day).select("entity_id", *keep)


@query(f"WITH {EV} SELECT user_id AS entity_id, round(avg(value), 8) AS a FROM ev GROUP BY ALL")
def c5_avg(spark, d):
    return whole(spark, d, fam(None, a=Lifetime("avg", "value")), F.round("a", 8).alias("a"))


@query(f"WITH {EV} SELECT user_id AS entity_id, arg_max(k, (ts, event_id)) AS latest, arg_min(k, (ts, event_id)) AS earliest FROM ev WHERE event_type = 'signup' GROUP BY ALL")
def c6_latest_earliest(spark, d):
    return whole(spark, d, fam("event_type = 'signup'", latest=Lifetime("last", "k"), earliest=Lifetime("first", "k")), "latest", "earliest")


def once(spark, d, family, *keep, day="2024-01-30"):
    """The same in one grouped pass over the log, for states that are as large as what they have seen."""
    return entity.render(entity.total(ev(spark, d).where(F.col("ds") <= day), family), family, day).select("entity_id", *keep)


@query(f"WITH {EV} SELECT user_id AS entity_id, count(DISTINCT k) AS ks FROM ev GROUP BY ALL")
def c7_count_distinct(spark, d):
    return once(spark, d, fam(None, ks=Lifetime("count_distinct", "k")), "ks")


@query(f"WITH {EV} SELECT user_id AS entity_id, count(DISTINCT k) AS e, true AS near FROM ev GROUP BY ALL")
def c7_sketch(spark, d):
    near = F.abs(F.col("a") - F.col("e")) <= F.greatest(F.lit(1), F.col("e") * 0.1)
    exact = once(spark, d, fam(None, e=Lifetime("count_distinct", "k")), "e")
    return whole(spark, d, fam(None, a=Lifetime("approx_count_distinct", "k")), "a").join(exact, "entity_id").select("entity_id", "e", near.alias("near"))


@query(f"WITH {EV} SELECT user_id AS entity_id, count(DISTINCT k) AS ks, count(DISTINCT props) FILTER (WHERE value > 50) AS p FROM ev GROUP BY ALL")
def c7_theta(spark, d):
    """Theta sketches count exactly up to the number of hashes they keep, which no entity here exceeds."""
    return whole(spark, d, fam(None, ks=Lifetime("theta", "k"), p=Lifetime("theta", "props", "value > 50", size=14)), "ks", "p")


_FIRST = f"{EV}, first AS (SELECT user_id AS entity_id, k, min(ds) AS ds FROM ev WHERE k IS NOT NULL GROUP BY ALL), new AS (SELECT entity_id, ds, count(*) AS new FROM first GROUP BY ALL)"


@query(f"WITH {_FIRST} SELECT entity_id, ds, new, CAST(sum(new) OVER (PARTITION BY entity_id ORDER BY ds) AS BIGINT) AS total FROM new")
def c7_running_distinct(spark, d):
    return entity.running_distinct(entity.map_keys(ev(spark, d), KEYS), ID, "k")


@query(f"WITH {_FIRST}, a AS (SELECT DISTINCT user_id AS entity_id, ds FROM ev) SELECT a.entity_id, a.ds, CAST(sum(coalesce(new, 0)) OVER (PARTITION BY a.entity_id ORDER BY a.ds) AS BIGINT) AS ks FROM a LEFT JOIN new ON a.entity_id = new.entity_id AND a.ds = new.ds")
def c7_distinct_each_day(spark, d):
    return states(spark, d, fam(None, ks=Lifetime("count_distinct", "k"))).select("entity_id", "ds", "ks")


@query(f"WITH {EV} SELECT user_id AS entity_id, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM ev GROUP BY ALL")
def c9_percentile(spark, d):
    """KLL sketches hold all of an entity's values, up to about k of them."""
    return whole(spark, d, fam(None, median=Lifetime("percentile", "value"), p95=Lifetime("percentile", "value", rank=0.95)), "median", "p95")


@query(f"WITH {EV} SELECT user_id AS entity_id, count(*) FILTER (WHERE value > 50) AS n, round(sum(value) FILTER (WHERE k > '3'), 2) AS s, round(avg(value) FILTER (WHERE k > '3'), 8) AS a FROM ev GROUP BY ALL")
def c8_conditional(spark, d):
    f = fam(None, n=Lifetime("count_if", "value > 50"), s=Lifetime("sum", "value", "k > '3'"), a=Lifetime("avg", "value", "k > '3'"))
    return whole(spark, d, f, "n", r2("s"), F.round("a", 8).alias("a"))


@query(f"WITH {EV} SELECT user_id AS entity_id, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 2) AS var FROM ev WHERE {BUY} GROUP BY ALL")
def c9_moments(spark, d):
    return whole(spark, d, fam(sd=Lifetime("stddev", "value"), var=Lifetime("variance", "value")), F.round("sd", 4).alias("sd"), r2("var"))


LIST = "array_to_string(list(k ORDER BY ts DESC, event_id DESC)[1:{n}], ',')"


def joined(c):
    """A list state as text."""
    return F.array_join(F.transform(F.col(c), lambda p: p["v"]), ",").alias("ks")


@query(f"WITH {EV} SELECT {PER}, {LIST.format(n=5)} AS ks FROM ev GROUP BY ALL")
def c10_prepend_list(spark, d):
    return delta(spark, d, fam(None, ks=PrependList("k", 5)), joined("ks__delta"))


LAST = entity.day_number("2024-01-30")


@query(f"WITH {EV} SELECT user_id AS entity_id, {bits_sql(f'list(DISTINCT {DAY})', LAST, 30)} AS active FROM ev WHERE event_type = 'click' GROUP BY ALL")
def c11_bitmap_day(spark, d):
    return whole(spark, d, fam("event_type = 'click'", active=BitmapActivity("day", 30)), "active")


@query(f"WITH {EV} SELECT user_id AS entity_id, {bits_sql('list(DISTINCT epoch_us(ts) // 3600000000)', LAST * 24 + 23, 72)} AS active FROM ev GROUP BY ALL")
def c12_bitmap_hour(spark, d):
    return whole(spark, d, fam(None, active=BitmapActivity("hour", 72)), "active")


@query(f"WITH {EV} SELECT user_id AS entity_id, {bits_sql('list(DISTINCT epoch_us(ts) // 3600000000)', LAST * 24 + 23, 72)} AS active FROM ev GROUP BY ALL")
def c12_bitmap_hour_whole(spark, d):
    return once(spark, d, fam(None, active=BitmapActivity("hour", 72)), "active")


@query(f"WITH {EV} SELECT user_id AS entity_id, {bits_sql(f'list(DISTINCT {DAY})', LAST, 30)} AS active FROM ev WHERE event_type = 'click' GROUP BY ALL")
def c11_packed_day(spark, d):
    return whole(spark, d, fam("event_type = 'click'", active=PackedActivity("day", 30)), "active")


@query(f"WITH {EV} SELECT user_id AS entity_id, {bits_sql('list(DISTINCT epoch_us(ts) // 3600000000)', LAST * 24 + 23, 72)} AS active FROM ev GROUP BY ALL")
def c12_packed_hour(spark, d):
    return whole(spark, d, fam(None, active=PackedActivity("hour", 72)), "active")


BUILT = f"""WITH {EV}, u AS (SELECT * FROM ev WHERE ds <= '2024-01-15'),
v AS (SELECT user_id AS entity_id, count(*) AS view_count, sum(value) AS view_value FROM u WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT user_id AS entity_id, {LIST.format(n=50)} AS recent, {bits_sql(f'list(DISTINCT {DAY})', LAST - 15, 30)} AS active FROM u WHERE event_type = 'click' GROUP BY 1),
p AS (SELECT user_id AS entity_id, sum(value) AS spend, count(*) AS purchases FROM u WHERE event_type = 'purchase' GROUP BY 1)
SELECT entity_id, view_count, round(view_value, 2) AS view_value, recent, active, round(spend, 2) AS spend, purchases, round(spend / purchases, 8) AS avg_order_value
FROM v FULL JOIN c USING (entity_id) FULL JOIN p USING (entity_id)"""


def shown(df):
    return df.select("entity_id", "view_count", r2("view_value"), F.array_join("recent", ",").alias("recent"), "active", r2("spend"), "purchases", F.round("avg_order_value", 8).alias("avg_order_value"))


@query(BUILT)
def c13_build_entity_table(spark, d):
    return shown(entity.build(ev(spark, d), BEHAVIOUR, "2024-01-15"))


@query(f"SELECT entity_id, coalesce(view_count, 0) AS view_count, view_value, coalesce(purchases, 0) AS purchases, spend, avg_order_value FROM ({BUILT}) t")
def c13_build_zero(spark, d):
    counted = replace(BEHAVIOUR, zero=("view_count", "purchases"))
    return shown(entity.build(ev(spark, d), counted, "2024-01-15")).select("entity_id", "view_count", "view_value", "purchases", "spend", "avg_order_value")


@query(f"WITH {EV}, h AS (SELECT user_id AS entity_id, ds || hour AS period, sum(value) AS s FROM ev WHERE {BUY} GROUP BY ALL) SELECT entity_id, period, round(sum(s) OVER (PARTITION BY entity_id ORDER BY period), 2) AS spend FROM h")
def c14_hourly(spark, d):
    f = fam(spend=Lifetime("sum", "value"))
    deltas = entity.family_delta(ev(spark, d).withColumn("period", F.concat("ds", "hour")), f, ("period",))
    return entity.cumulate(deltas, f, ID, "period").select("entity_id", "period", r2("spend"))


@query(f"WITH {EV}, u AS (SELECT user_id, arg_max(k, (ts, event_id)) AS k, sum(value) AS total FROM ev GROUP BY 1) SELECT k AS group_id, count(*) AS users, round(sum(total), 2) AS total FROM u GROUP BY 1")
def c15_table_as_source(spark, d):
    users = whole(spark, d, fam(None, k=Lifetime("last", "k"), total=Lifetime("sum", "value")), "k", "total")
    f = Family("groups", {"users": Lifetime("count"), "total": Lifetime("sum", "total")}, {"k": "group_id"})
    return entity.family_delta(users, f, ()).select("group_id", F.col("users__delta").alias("users"), F.round("total__delta", 2).alias("total"))


# --- merging -------------------------------------------------------------------------------------------------------------

SUMS = fam(spend=Lifetime("sum", "value"), purchases=Lifetime("count"), low=Lifetime("min", "value"), high=Lifetime("max", "value"))


def day(spark, d, family, ds):
    return entity.family_delta(ev(spark, d).where(F.col("ds") == ds), family, ())


@query(f"WITH {EV} SELECT user_id AS entity_id, count(*) AS delta, count(*) AS purchases, round(sum(value), 2) AS spend FROM ev WHERE {BUY} AND ds = '2024-01-01' GROUP BY 1")
def m1_seed(spark, d):
    return entity.seed(day(spark, d, SUMS, "2024-01-01"), SUMS).select("entity_id", F.col("purchases__delta").alias("delta"), "purchases", r2("spend"))


def two_days(spark, d, family):
    old = entity.seed(day(spark, d, family, "2024-01-01"), family)
    return entity.merge(old, day(spark, d, family, "2024-01-02"), family, ID)


TWO = f"WITH {EV}, w AS (SELECT *, ds = '2024-01-02' AS new FROM ev WHERE ds IN ('2024-01-01', '2024-01-02'))"


@query(f"{TWO} SELECT user_id AS entity_id, nullif(count(*) FILTER (WHERE new), 0) AS delta, count(*) AS purchases FROM w WHERE {BUY} GROUP BY 1")
def m2_merge(spark, d):
    return two_days(spark, d, SUMS).select("entity_id", F.col("purchases__delta").alias("delta"), "purchases")


@query(f"{TWO} SELECT user_id AS entity_id, round(sum(value), 2) AS spend, count(*) AS purchases FROM w WHERE {BUY} GROUP BY 1")
def m3_additive(spark, d):
    return two_days(spark, d, SUMS).select("entity_id", r2("spend"), "purchases")


@query(f"{TWO} SELECT user_id AS entity_id, min(value) AS low, max(value) AS high FROM w WHERE {BUY} GROUP BY 1")
def m4_extremes(spark, d):
    return two_days(spark, d, SUMS).select("entity_id", "low", "high")


@query(f"{TWO} SELECT user_id AS entity_id, arg_max(k, (ts, event_id)) AS k FROM w GROUP BY 1")
def m5_last_writer(spark, d):
    f = fam(None, k=Lifetime("last", "k"))
    return entity.render(two_days(spark, d, f), f, "2024-01-02").select("entity_id", "k")


@query(f"{TWO} SELECT user_id AS entity_id, {LIST.format(n=4)} AS ks FROM w GROUP BY 1")
def m6_list(spark, d):
    return two_days(spark, d, fam(None, ks=PrependList("k", 4))).select("entity_id", joined("ks"))


@query(f"{TWO} SELECT user_id AS entity_id, {bits_sql(f'list(DISTINCT {DAY})', LAST - 28, 7)} AS active FROM w GROUP BY 1")
def m7_bitmap(spark, d):
    f = fam(None, active=BitmapActivity("day", 7))
    return entity.render(two_days(spark, d, f), f, "2024-01-02").select("entity_id", "active")


@query(f"{TWO} SELECT user_id AS entity_id, {bits_sql('list(DISTINCT epoch_us(ts) // 3600000000)', (LAST - 28) * 24 + 23, 30)} AS active FROM w GROUP BY 1")
def m7_bitmap_hour(spark, d):
    f = fam(None, active=BitmapActivity("hour", 30))
    return entity.render(two_days(spark, d, f), f, "2024-01-02").select("entity_id", "active")


@query(f"{TWO} SELECT user_id AS entity_id, {bits_sql('list(DISTINCT epoch_us(ts) // 3600000000)', (LAST - 28) * 24 + 23, 30)} AS active FROM w GROUP BY 1")
def m7_packed_hour(spark, d):
    f = fam(None, active=PackedActivity("hour", 30))
    return entity.render(two_days(spark, d, f), f, "2024-01-02").select("entity_id", "active")


@query(f"{TWO} SELECT user_id AS entity_id, count(DISTINCT k) AS ks, quantile_disc(value, 0.5) AS median FROM w GROUP BY 1")
def m8_sketches(spark, d):
    f = fam(None, ks=Lifetime("theta", "k"), median=Lifetime("percentile", "value"))
    return entity.render(two_days(spark, d, f), f, "2024-01-02").select("entity_id", "ks", "median")


@query(f"{TWO} SELECT user_id AS entity_id, round(avg(value), 8) AS a, round(stddev_samp(value), 4) AS sd, count(DISTINCT k) AS ks FROM w GROUP BY 1")
def m8_states(spark, d):
    f = fam(None, a=Lifetime("avg", "value"), sd=Lifetime("stddev", "value"), ks=Lifetime("count_distinct", "k"))
    return entity.render(two_days(spark, d, f), f, "2024-01-02").select("entity_id", F.round("a", 8).alias("a"), F.round("sd", 4).alias("sd"), "ks")


CUM = f"""WITH {EV}, x AS (SELECT user_id AS entity_id, ds, sum(value) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ev WHERE {BUY} GROUP BY ALL),
cum AS (SELECT entity_id, ds, sum(s) OVER w AS spend, CAST(sum(n) OVER w AS BIGINT) AS purchases, min(lo) OVER w AS low, max(hi) OVER w AS high FROM x WINDOW w AS (PARTITION BY entity_id ORDER BY ds))"""
CUM_OUT = "SELECT entity_id, ds, round(spend, 2) AS spend, purchases, low, high FROM cum"


def cum_out(df):
    return df.select("entity_id", "ds", r2("spend"), "purchases", "low", "high")


@query(f"{CUM} {CUM_OUT}")
def m9_cumulate(spark, d):
    return cum_out(states(spark, d, SUMS))


@query(f"{CUM}, t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS r FROM cum WHERE ds <= '2024-01-20') SELECT entity_id, ds, round(spend, 2) AS spend, purchases, low, high FROM t WHERE r = 1")
def m10_as_of_fill(spark, d):
    return cum_out(entity.state_at(ev(spark, d), SUMS, "2024-01-20"))


@query(f"{CUM}, t AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ds DESC) AS r FROM cum WHERE ds <= '2024-01-20') SELECT entity_id, ds, round(spend, 2) AS spend, purchases, low, high FROM t WHERE r = 1")
def m10_as_of_stored(spark, d):
    path = work_dir(spark)
    states(spark, d, SUMS).write.partitionBy("ds").parquet(path)
    stored = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    return cum_out(entity.as_of(stored.withColumn("ds", F.col("ds").cast("string")), ID, "2024-01-20"))


@query(f"{CUM} {CUM_OUT} WHERE ds BETWEEN '2024-01-10' AND '2024-01-15'")
def m11_backfill(spark, d):
    before = entity.state_at(ev(spark, d), SUMS, "2024-01-09")
    return cum_out(entity.backfill(ev(spark, d), SUMS, ID, "2024-01-10", "2024-01-15", before))


@query(f"{CUM} {CUM_OUT}")
def m12_cascade(spark, d):
    stored = entity.family_delta(ev(spark, d).withColumn("value", F.when(F.col("ds").between("2024-01-10", "2024-01-15"), -1.0).otherwise(F.col("value"))), SUMS)
    fresh = entity.family_delta(ev(spark, d).where(F.col("ds").between("2024-01-10", "2024-01-15")), SUMS)
    return cum_out(entity.cascade(stored, fresh, SUMS, ID, "2024-01-10", "2024-01-15"))


@query(f"{CUM} {CUM_OUT}")
def m12_cascade_from_state(spark, d):
    """Days whose stored deltas are wrong are corrected: from a snapshot, with the deltas since alone, on the days that change alone."""
    rows, path = ev(spark, d), work_dir(spark)
    wrong = rows.withColumn("value", F.when(F.col("ds").between("2024-01-20", "2024-01-22"), -1.0).otherwise(F.col("value")))
    stored.store(entity.family_delta(wrong, SUMS), SUMS, ID, path)
    stored.snapshot(spark, SUMS, ID, path, "2024-01-15")
    fresh = entity.family_delta(rows.where(F.col("ds").between("2024-01-20", "2024-01-22")), SUMS)
    stored.cascade(spark, SUMS, ID, path, fresh, "2024-01-20", "2024-01-22")
    return cum_out(stored.states(spark, path))


@query(f"WITH {EV} SELECT {PER}, {LIST.format(n=3)} AS ks, count(DISTINCT {DAY}) AS days FROM ev GROUP BY ALL")
def m13_parallel_deltas(spark, d):
    f = fam(None, ks=PrependList("k", 3), active=BitmapActivity("day", 30))
    return delta(spark, d, f, joined("ks__delta"), F.size("active__delta").cast("long").alias("days"))


@query(f"WITH {EV} SELECT ds, count(DISTINCT user_id) AS entities, round(sum(value), 2) AS spend FROM ev WHERE {BUY} AND ds BETWEEN '2024-01-01' AND '2024-01-05' GROUP BY ds")
def m14_idempotent(spark, d):
    path = work_dir(spark)
    deltas = entity.family_delta(ev(spark, d), SUMS).select("entity_id", "ds", "spend__delta")
    entity.overwrite_period(deltas.where("ds between '2024-01-01' and '2024-01-05'"), path)
    entity.overwrite_period(deltas.where("ds between '2024-01-03' and '2024-01-04'"), path)
    back = spark.read.parquet(path).groupBy(F.date_format("ds", "yyyy-MM-dd").alias("ds"))
    return back.agg(F.count(F.lit(1)).alias("entities"), F.round(F.sum("spend__delta"), 2).alias("spend"))


@query(f"WITH {EV} SELECT min(ds) AS first_ds, '2023-12-25' < strftime(DATE '2024-01-30' - 30, '%Y-%m-%d') AS before_lookback, '2023-12-25' < min(ds) AS before_source FROM ev")
def m15_backfill_check(spark, d):
    return entity.backfill_check(ev(spark, d), "2023-12-25", "2024-01-30")


@query(f"WITH {EV}, a AS (SELECT min(ds) AS first_ds FROM ev WHERE event_type = 'purchase'), s AS (SELECT strftime(CAST(first_ds AS DATE) + CAST(n AS INTEGER), '%Y-%m-%d') AS start, first_ds FROM a, (VALUES (-1), (0), (5)) t(n)) SELECT start, first_ds, start < strftime(DATE '2024-02-01' - 30, '%Y-%m-%d') AS before_lookback, start < first_ds AS before_source FROM s")
def m15_backfill_checks(spark, d):
    """Starts before the source's first day, on it, and within the lookback, as the log has them."""
    rows = ev(spark, d).where(BUY)
    first = rows.agg(F.min("ds")).first()[0]
    starts = [(date.fromisoformat(first) + timedelta(days=n)).isoformat() for n in (-1, 0, 5)]
    parts = [entity.backfill_check(rows, s, "2024-02-01").withColumn("start", F.lit(s)) for s in starts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
