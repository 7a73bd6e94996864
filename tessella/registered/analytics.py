"""Queries on metrics, activity, checks, and the documented ad-hoc questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PackedActivity, PrependList
from tessella.operators import activity, checks, entity, metrics
from tessella.plans.spec import Family
from tessella.registered.base import DAY, EV, KEYS, LOADS, ev, loads, query, states, table, work_dir
from tessella.registered.families import BUILT, SUMS, bits_sql, shown, whole
from tessella.registered.base import BEHAVIOUR

ID = ["entity_id"]


@query(f"WITH {LOADS} SELECT top_k, count(*) AS users, round(sum(spend), 2) AS revenue FROM st WHERE view_count > 2 GROUP BY top_k")
def q1_metric(spark, d):
    st = entity.stitch(loads(spark, d), ID)
    return metrics.metric(st, {"users": "count(*)", "revenue": "round(sum(spend), 2)"}, ["top_k"], "view_count > 2")


def _customers(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    return metrics.with_dimension(customer, nation, {"c_nationkey": "n_nationkey"}, {"nation": "n_name"})


@query("SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def q2_star(spark, d):
    facts = metrics.with_dimension(table(spark, d, "orders"), _customers(spark, d), {"o_custkey": "c_custkey"}, {"nation": "nation"})
    return metrics.metric(facts, {"orders": "count(*)", "revenue": "round(sum(o_totalprice), 2)"}, ["nation"])


@query("SELECT c_mktsegment AS segment, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def q3_log_metric(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01' and l_shipdate < timestamp_ntz'1996-01-01'")
    rows = metrics.with_dimension(rows, table(spark, d, "orders"), {"l_orderkey": "o_orderkey"}, {"custkey": "o_custkey"})
    rows = metrics.with_dimension(rows, table(spark, d, "customer"), {"custkey": "c_custkey"}, {"segment": "c_mktsegment"})
    return metrics.metric(rows, {"lines": "count(*)", "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)"}, ["segment"])


@query("SELECT cn.n_name AS buyer_nation, sn.n_name AS seller_nation, count(*) AS lines FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def q4_role_playing(spark, d):
    nation = table(spark, d, "nation")
    rows = metrics.with_dimension(table(spark, d, "lineitem"), table(spark, d, "orders"), {"l_orderkey": "o_orderkey"}, {"custkey": "o_custkey"})
    rows = metrics.with_dimension(rows, table(spark, d, "customer"), {"custkey": "c_custkey"}, {"b": "c_nationkey"})
    rows = metrics.with_dimension(rows, table(spark, d, "supplier"), {"l_suppkey": "s_suppkey"}, {"s": "s_nationkey"})
    rows = metrics.with_dimension(rows, nation, {"b": "n_nationkey"}, {"nation": "n_name"}, "buyer_")
    rows = metrics.with_dimension(rows, nation, {"s": "n_nationkey"}, {"nation": "n_name"}, "seller_")
    return metrics.metric(rows, {"lines": "count(*)"}, ["buyer_nation", "seller_nation"])


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS users, round(round(sum(o_totalprice), 2) / count(DISTINCT o_custkey), 6) AS revenue_per_user FROM orders GROUP BY 1")
def q5_composed(spark, d):
    o, dims = table(spark, d, "orders"), ["o_orderpriority"]
    parts = [metrics.metric(o, {"revenue": "round(sum(o_totalprice), 2)"}, dims), metrics.metric(o, {"users": "count(distinct o_custkey)"}, dims)]
    return metrics.composed(parts, dims, "revenue_per_user", "round(try_divide(revenue, users), 6)")


@query(f"WITH {EV} SELECT user_id AS entity_id, count(*) AS \"first\", count(*) AS \"second\", CAST(0 AS BIGINT) AS difference FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def q6_reconcile(spark, d):
    log = metrics.metric(ev(spark, d).withColumnRenamed("user_id", "entity_id"), {"n": "count(*)"}, ID, "event_type = 'purchase'")
    return metrics.reconcile(log, whole(spark, d, SUMS, F.col("purchases").alias("n")), ID, "n")


@query(f"WITH {EV} SELECT ds, count(DISTINCT user_id) AS dau, count(DISTINCT user_id) AS dau_flag FROM ev GROUP BY ds")
def q7_dau(spark, d):
    rows = ev(spark, d)
    flags = rows.select("ds", "user_id").distinct().withColumn("is_dau", F.lit(True))
    return metrics.metric(rows, {"dau": "count(distinct user_id)"}, ["ds"]).join(metrics.metric(flags, {"dau_flag": "count_if(is_dau)"}, ["ds"]), "ds")


_MEASURES = {"orders": "count(*)", "revenue": "round(sum(o_totalprice), 2)"}


def _facts(spark, d):
    return metrics.with_dimension(table(spark, d, "orders"), table(spark, d, "customer"), {"o_custkey": "c_custkey"}, {"segment": "c_mktsegment"})


@query("SELECT c_mktsegment AS segment, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS grouping_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def q8_cube(spark, d):
    return metrics.cube(_facts(spark, d), ["segment", "o_orderpriority"], _MEASURES, "cube")


@query("SELECT c_mktsegment AS segment, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, CAST(grouping(c_mktsegment, o_orderpriority) AS BIGINT) AS grouping_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def q8_rollup(spark, d):
    return metrics.cube(_facts(spark, d), ["segment", "o_orderpriority"], _MEASURES, "rollup")


@query("SELECT c_mktsegment AS segment, count(*) AS orders, max(o_totalprice) AS top FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q9_from_cube(spark, d):
    dims = ["segment", "o_orderpriority", "o_orderstatus"]
    pre = metrics.cube(_facts(spark, d), dims, {"orders": "count(*)", "top": "max(o_totalprice)"})
    return metrics.from_cube(pre, dims, ["segment"], {"orders": "sum", "top": "max"})


@query(f"WITH {EV}, x AS (SELECT ds, sum(value) AS s, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY ds) SELECT ds, round(sum(s) OVER (ORDER BY ds), 2) AS revenue, CAST(sum(n) OVER (ORDER BY ds) AS BIGINT) AS purchases FROM x")
def q10_history(spark, d):
    """Every entity's cumulative revenue on every day adds up to the running total of the days' deltas."""
    f = Family("all", SUMS.columns, {"everyone": "everyone"}, SUMS.where)
    rows = ev(spark, d).withColumn("everyone", F.lit(1))
    return entity.cumulate(entity.family_delta(rows, f), f, ["everyone"]).select("ds", F.round("spend", 2).alias("revenue"), "purchases")


TIERS = f"""{EV}, tier AS (SELECT user_id, ts, event_id, k FROM ev WHERE event_type = 'signup'),
facts AS (SELECT e.event_id, e.user_id, e.value, (SELECT arg_max(t.k, (t.ts, t.event_id)) FROM tier t WHERE t.user_id = e.user_id AND t.ts <= e.ts) AS tier FROM ev e WHERE event_type = 'purchase')"""


@query(f"WITH {TIERS} SELECT tier, count(*) AS purchases, round(sum(value), 2) AS revenue FROM facts GROUP BY 1")
def q2_dimension_as_it_was(spark, d):
    """Purchases by the tier that the buyer had at that time: the k of the last signup event up to then."""
    rows = ev(spark, d)
    tiers = rows.where("event_type = 'signup'").select(F.col("user_id").alias("id"), "ts", F.col("k").alias("tier"))
    facts = metrics.as_they_were(rows.where("event_type = 'purchase'"), tiers, {"user_id": "id"}, ["tier"], "ts", "ts")
    return metrics.metric(facts, {"purchases": "count(*)", "revenue": "round(sum(value), 2)"}, ["tier"])


@query(f"""WITH {EV}, days AS (SELECT unnest(range(0, 30)) AS n), u AS (SELECT user_id, ts, event_id, ds, k, event_type, value FROM ev),
at AS (SELECT strftime(DATE '2024-01-01' + CAST(n AS INTEGER), '%Y-%m-%d') AS day, user_id, arg_max(k, (ts, event_id)) FILTER (WHERE k IS NOT NULL) AS tier, sum(value) FILTER (WHERE event_type = 'purchase') AS revenue
  FROM days JOIN u ON u.ds <= strftime(DATE '2024-01-01' + CAST(n AS INTEGER), '%Y-%m-%d') GROUP BY ALL)
SELECT day AS ds, tier, count(*) AS users, round(coalesce(sum(revenue), 0), 2) AS revenue FROM at GROUP BY ALL""".replace("at AS (", "asof_day AS (").replace("FROM at GROUP", "FROM asof_day GROUP"))
def q10_history_by_dimension(spark, d):
    """Cumulative revenue on each of 30 days by the tier that each user had on that day; users change it as they go."""
    f = Family("f", {"tier": Lifetime("last", "k"), "revenue": Lifetime("sum", "value", "event_type = 'purchase'")}, KEYS)
    steps = entity.render(entity.cumulate(entity.family_delta(ev(spark, d), f), f, ID), f)
    month = [f"2024-01-{n:02d}" for n in range(1, 31)]
    out = metrics.history(steps.select("entity_id", "ds", "tier", "revenue"), ID, month, ["tier"], ["revenue"])
    return out.select("ds", "tier", F.col("entities").alias("users"), F.round("revenue", 2).alias("revenue"))


_SKETCHED = {"orders": "count(*)", "users": "theta_sketch_agg(o_custkey, 14)", "prices": "kll_sketch_agg_double(o_totalprice, 32768)"}


@query("SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o_custkey) AS users, quantile_disc(o_totalprice, 0.95) AS prices FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q9_sketches_from_cube(spark, d):
    """Buyers and a percentile by segment from the smaller of two written cubes. Sketches hold 16 000 buyers or 32 000 prices; buyers are dealt
    out by hash, and prices by value, in so many slices that no sketch has more."""
    facts, cubes = _facts(spark, d), []
    slices = {"users": activity.slice_of("o_custkey", activity.slices_for(facts, "o_custkey", 14)), "prices": metrics.value_slices(facts, "o_totalprice", 32768)}
    for dims in (("segment", "o_orderpriority", "o_orderstatus"), ("segment", "o_orderpriority")):
        path = work_dir(spark)
        metrics.sliced_cube(facts, dims, _SKETCHED, slices).write.parquet(path)
        rows = spark.read.parquet(path)
        cubes.append(metrics.Cube(rows, dims, tuple(_SKETCHED), rows.count()))
    best = metrics.smallest_cube(cubes, ["segment"], list(_SKETCHED))
    return metrics.from_sliced_cube(best.rows, best.dims, ["segment"], {"orders": "sum", "users": "distinct", "prices": 0.95}, 14, 32768)


# --- activity ------------------------------------------------------------------------------------------------------------


def days(spark, d):
    return activity.active_days(ev(spark, d).where("event_type = 'purchase'"), "user_id")


DAYS = f"WITH {EV}, dy AS (SELECT DISTINCT user_id, {DAY} AS day FROM ev WHERE event_type = 'purchase')"
LAST = entity.day_number("2024-01-30")


@query(f"{DAYS}, cal AS (SELECT unnest(range((SELECT min(day) FROM dy), (SELECT max(day) FROM dy) + 1)) AS day) SELECT CAST(c.day AS INTEGER) AS day, " + ", ".join(f"count(DISTINCT user_id) FILTER (WHERE dy.day > c.day - {w}) AS active_{w}" for w in (1, 7, 30)) + " FROM cal c JOIN dy ON dy.day <= c.day AND dy.day > c.day - 30 GROUP BY c.day")
def a1_active_users(spark, d):
    return activity.active_users(days(spark, d), "user_id")


@query(f"{DAYS}, i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM dy), r AS (SELECT user_id, g, count(*) AS n, max(day) AS z FROM i GROUP BY 1, 2) SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (WHERE z = {LAST}), 0) AS current FROM r GROUP BY 1")
def a2_streaks(spark, d):
    return activity.streaks(days(spark, d), "user_id", LAST)


@query(f"""{DAYS}, f AS (SELECT user_id, bool_or(day > {LAST} - 3) AS n, bool_or(day <= {LAST} - 3 AND day > {LAST} - 6) AS b, bool_or(day <= {LAST} - 6) AS e FROM dy GROUP BY 1)
SELECT CASE WHEN n AND b THEN 'retained' WHEN b THEN 'churned' WHEN n AND e THEN 'resurrected' WHEN n THEN 'new' ELSE 'inactive' END AS state, count(*) AS entities FROM f GROUP BY 1""")
def a3_churn(spark, d):
    return activity.churn(days(spark, d), "user_id", LAST, 3)


@query(f"WITH {EV} SELECT user_id AS entity_id, CAST(length(replace({bits_sql(f'list(DISTINCT {DAY})', LAST, 30)}, '0', '')) AS INTEGER) AS slots FROM ev WHERE event_type = 'click' GROUP BY 1")
def a4_active_slots(spark, d):
    f = Family("f", {"active": BitmapActivity("day", 30)}, KEYS, "event_type = 'click'")
    return whole(spark, d, f, "active").select("entity_id", activity.active_slots(F.col("active")).alias("slots"))


@query(f"{DAYS}, c AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS cohort FROM dy) SELECT CAST(cohort AS INTEGER) AS cohort, CAST(day - cohort AS INTEGER) AS \"offset\", count(*) AS entities FROM c GROUP BY 1, 2")
def a5_retention(spark, d):
    return activity.retention(days(spark, d), "user_id")


PACKED = PackedActivity("day", 60)


def packed(spark, d):
    """Stored states of the purchases' active days, the newest of each user."""
    f = Family("f", {"active": PACKED}, KEYS, "event_type = 'purchase'")
    path = work_dir(spark)
    states(spark, d, f).drop("active__delta").write.parquet(path)
    return entity.as_of(spark.read.parquet(path), ID, "2024-01-30")


@query(f"{DAYS}, cal AS (SELECT unnest(range((SELECT min(day) FROM dy), (SELECT max(day) FROM dy) + 1)) AS day) SELECT CAST(c.day AS INTEGER) AS day, " + ", ".join(f"count(DISTINCT user_id) FILTER (WHERE dy.day > c.day - {w}) AS active_{w}" for w in (1, 7, 30)) + " FROM cal c JOIN dy ON dy.day <= c.day AND dy.day > c.day - 30 GROUP BY c.day")
def a1_active_users_from_states(spark, d):
    return activity.active_users(activity.days_of(packed(spark, d), "entity_id", "active", PACKED, LAST), "entity_id")


@query(f"{DAYS}, i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM dy), r AS (SELECT user_id, g, count(*) AS n, max(day) AS z FROM i GROUP BY 1, 2) SELECT user_id AS entity_id, max(n) AS longest, coalesce(max(n) FILTER (WHERE z = {LAST}), 0) AS current FROM r GROUP BY 1")
def a2_streaks_from_states(spark, d):
    return activity.streaks_from_states(packed(spark, d), "entity_id", "active", PACKED, LAST)


_CHURN = f"""{DAYS}, f AS (SELECT user_id, bool_or(day > {LAST} - 3) AS n, bool_or(day <= {LAST} - 3 AND day > {LAST} - 6) AS b, bool_or(day <= {LAST} - 6) AS e FROM dy GROUP BY 1)
SELECT CASE WHEN n AND b THEN 'retained' WHEN b THEN 'churned' WHEN n AND e THEN 'resurrected' WHEN n THEN 'new' ELSE 'inactive' END AS state, count(*) AS entities FROM f GROUP BY 1"""


@query(_CHURN)
def a3_churn_from_states(spark, d):
    return activity.churn_from_states(packed(spark, d), "entity_id", "active", PACKED, LAST, 3)


SIZE = 14  # of sketches, as a power of two


def sketches(spark, d):
    """Written sketches of each day's buyers, in so many slices that what follows from them is exact."""
    path = work_dir(spark)
    activity.sketches_by_day(ev(spark, d).where("event_type = 'purchase'"), "user_id", SIZE).write.parquet(path)
    return spark.read.parquet(path)


@query(_CHURN)
def a3_churn_from_sketches(spark, d):
    return activity.churn_from_sketches(sketches(spark, d), LAST, 3, SIZE)


@query(f"{DAYS}, c AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS cohort FROM dy) SELECT CAST(cohort AS INTEGER) AS cohort, CAST(day - cohort AS INTEGER) AS \"offset\", count(*) AS entities FROM c GROUP BY 1, 2")
def a5_retention_from_sketches(spark, d):
    return activity.retention_from_sketches(sketches(spark, d), SIZE)


@query(f"WITH {EV}, u AS (SELECT ds, user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c FROM ev GROUP BY ALL) SELECT ds, count(*) FILTER (WHERE v OR c) AS \"any\", count(*) FILTER (WHERE v AND c) AS \"all\" FROM u WHERE v OR c GROUP BY 1")
def a3_reached_by_families(spark, d):
    """Users that views or clicks reach on a day, and that both do, from sketches for each family, day and slice of users."""
    rows = ev(spark, d).where("event_type in ('view', 'click')")
    empty = F.theta_sketch_agg(F.lit(None).cast("long"), SIZE)
    sides = [F.coalesce(F.theta_sketch_agg(F.when(F.col("event_type") == t, F.col("user_id")), SIZE), empty).alias(t) for t in ("view", "click")]
    days = rows.groupBy("ds", activity.slice_of("user_id", activity.slices_for(rows, "user_id", SIZE))).agg(*sides)
    counts = activity.reached([F.col("view"), F.col("click")], SIZE)
    return days.select("ds", *(c.alias(n) for n, c in counts.items())).groupBy("ds").agg(*(F.sum(n).alias(n) for n in counts))


@query(f"WITH {EV} SELECT user_id AS entity_id, CAST(length(replace({bits_sql(f'list(DISTINCT {DAY})', LAST, 30)}, '0', '')) AS INTEGER) AS slots FROM ev WHERE event_type = 'click' GROUP BY 1")
def a4_active_slots_packed(spark, d):
    f = Family("f", {"active": PackedActivity("day", 30)}, KEYS, "event_type = 'click'")
    at = entity.as_of(states(spark, d, f), ID, "2024-01-30")
    return at.select("entity_id", f.columns["active"].active(F.col("active"), F.lit(LAST)).cast("int").alias("slots"))


# --- checks --------------------------------------------------------------------------------------------------------------


@query(f"WITH {LOADS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_keys, (SELECT count(DISTINCT user_id) FROM ev WHERE event_type IN ('view', 'click', 'purchase')) AS source_keys FROM st")
def d1_key_invariants(spark, d):
    source = entity.map_keys(ev(spark, d).where("event_type in ('view', 'click', 'purchase')"), KEYS)
    return checks.key_invariants(entity.stitch(loads(spark, d), ID), source, ID)


@query(f"WITH {EV} SELECT round(sum(value), 2) AS table_total, round(sum(value), 2) AS source_total, true AS agree FROM ev WHERE event_type = 'purchase'")
def d2_totals_agree(spark, d):
    return checks.totals_agree(whole(spark, d, SUMS, "spend"), ev(spark, d).where("event_type = 'purchase'"), "sum(spend)", "sum(value)", 2)


@query(f"WITH {EV}, c AS (SELECT user_id, least(count(*), 50) AS recent, 30 AS active FROM ev WHERE event_type = 'click' GROUP BY 1) SELECT count(*) FILTER (WHERE recent > 50) AS recent, count(*) FILTER (WHERE active <> 30) AS active FROM c")
def d3_size_violations(spark, d):
    f = Family("f", {"recent": PrependList("k", 50), "active": BitmapActivity("day", 30)}, KEYS, "event_type = 'click'")
    return checks.size_violations(whole(spark, d, f, "recent", "active"), {"recent": 50}, {"active": 30})


# The same checks on tables that are wrong: a day is missing from the entity table, and lists and bitmaps are held to tighter bounds.


def lacking(spark, d):
    return ev(spark, d).where("ds <> '2024-01-10'")


@query(f"WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), t AS (SELECT round(sum(value) FILTER (WHERE ds <> '2024-01-10'), 2) AS table_total, round(sum(value), 2) AS source_total FROM p) SELECT *, table_total = source_total AS agree FROM t")
def d2_totals_of_a_table_that_lacks_a_day(spark, d):
    return checks.totals_agree(entity.render(entity.total(lacking(spark, d), SUMS), SUMS, "2024-01-30"), ev(spark, d).where("event_type = 'purchase'"), "sum(spend)", "sum(value)", 2)


@query(f"WITH {EV}, c AS (SELECT user_id, least(count(*), 50) AS recent, length({bits_sql(f'list(DISTINCT {DAY})', LAST, 30)}) AS active FROM ev WHERE event_type = 'click' GROUP BY 1) SELECT count(*) FILTER (WHERE recent > 12) AS recent, count(*) FILTER (WHERE active <> 28) AS active FROM c")
def d3_sizes_beyond_tighter_bounds(spark, d):
    f = Family("f", {"recent": PrependList("k", 50), "active": BitmapActivity("day", 30)}, KEYS, "event_type = 'click'")
    return checks.size_violations(whole(spark, d, f, "recent", "active"), {"recent": 12}, {"active": 28})


@query(f"WITH {EV}, n AS (SELECT user_id AS entity_id, count(*) AS a, count(*) FILTER (WHERE ds <> '2024-01-10') AS b FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT entity_id, a AS \"first\", nullif(b, 0) AS \"second\", a - b AS difference FROM n")
def q6_reconcile_with_a_table_that_lacks_a_day(spark, d):
    log = metrics.metric(ev(spark, d).withColumnRenamed("user_id", "entity_id"), {"n": "count(*)"}, ID, "event_type = 'purchase'")
    return metrics.reconcile(log, entity.total(lacking(spark, d), SUMS).select("entity_id", F.col("purchases").alias("n")), ID, "n")


@query("SELECT c_custkey, sha256(c_name) AS c_name, repeat('*', greatest(length(CAST(c_nationkey + 1000000 AS VARCHAR)) - 4, 0)) || right(CAST(c_nationkey + 1000000 AS VARCHAR), 4) AS account, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def d4_masked(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_nationkey") + 1000000).alias("account"), "c_mktsegment")
    return checks.masked(rows, {"c_name": "pii", "account": "financial", "c_mktsegment": "credentials"})


@query("SELECT (SELECT count(*) FROM events) AS rows, c AS \"column\", n AS nulls, f AS misfits FROM (SELECT 'user_id' AS c, count(*) FILTER (WHERE user_id IS NULL) AS n, CAST(0 AS BIGINT) AS f FROM events UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), count(*) FILTER (WHERE event_type IS NOT NULL) FROM events) t")
def d5_column_quality(spark, d):
    return checks.column_quality(table(spark, d, "events"), {"user_id": "int32", "event_type": "double"})


@query("""SELECT c AS "column", (SELECT count(*) FROM events) AS rows, n AS nulls, CASE WHEN c IN ('event_id', 'event_timestamp', 'ds', 'hour') THEN 'reserved' WHEN c = 'account_id' THEN 'unmapped key' END AS problem FROM (
SELECT 'event_id' AS c, count(*) FILTER (WHERE event_id IS NULL) AS n FROM events UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM events UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL) FROM events UNION ALL SELECT 'hour', NULL UNION ALL SELECT 'account_id', NULL) t""")
def d5_schema_contract(spark, d):
    return checks.schema_contract(table(spark, d, "events"), {"event_id": "int64", "user_id": "int32", "value": "double", "hour": "int32"}, ["user_id", "account_id"]).drop("misfits")


@query("SELECT l_partkey, count(*) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY 1")
def d6_unknown_keys(spark, d):
    return checks.unknown_keys(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size < 40"), {"l_partkey": "p_partkey"})


# --- documented questions ------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT ds, hour, count(*) AS n FROM ev GROUP BY 1, 2 ORDER BY 1, 2")
def h1_rows_per_hour(spark, d):
    return ev(spark, d).groupBy("ds", "hour").agg(F.count(F.lit(1)).alias("n")).orderBy("ds", "hour")


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def h2_distinct_users(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT round(sum(value), 2) AS amount FROM events WHERE event_type = 'purchase'")
def h3_sum(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").agg(F.round(F.sum("value"), 2).alias("amount"))


@query(f"WITH {LOADS} SELECT entity_id, view_count, spend FROM st ORDER BY entity_id LIMIT 10")
def h4_first_rows(spark, d):
    return entity.stitch(loads(spark, d), ID).select("entity_id", "view_count", "spend").orderBy("entity_id").limit(10)


@query(f"SELECT count(*) AS n, round(avg(view_count), 6) AS views, round(sum(spend), 2) AS spend, round(avg(CASE WHEN recent = '' THEN 0 ELSE len(string_split(recent, ',')) END), 6) AS recent FROM ({BUILT}) t")
def h5_cross_family(spark, d):
    t = shown(entity.build(ev(spark, d), BEHAVIOUR, "2024-01-15"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("view_count"), 6).alias("views"), F.round(F.sum("spend"), 2).alias("spend"), F.round(F.avg(F.size(F.split("recent", ","))), 6).alias("recent"))


@query(f"SELECT entity_id, view_count, purchases FROM ({BUILT}) t WHERE entity_id = 5")
def h6_point(spark, d):
    return entity.build(ev(spark, d).where("user_id = 5"), BEHAVIOUR, "2024-01-15").select("entity_id", "view_count", "purchases")


@query(f"SELECT entity_id, avg_order_value FROM ({BUILT}) t WHERE purchases > 1 ORDER BY avg_order_value DESC, entity_id LIMIT 5")
def h7_top_derived(spark, d):
    t = shown(entity.build(ev(spark, d), BEHAVIOUR, "2024-01-15"))
    return t.where("purchases > 1").select("entity_id", "avg_order_value").orderBy(F.desc("avg_order_value"), "entity_id").limit(5)


@query(f"WITH {LOADS} SELECT entity_id, spend FROM st WHERE spend > 500 AND clicks >= 3")
def h8_other_predicate(spark, d):
    return entity.stitch(loads(spark, d), ID).where("spend > 500 and clicks >= 3").select("entity_id", "spend")


@query(f"WITH {EV} SELECT count(DISTINCT user_id) AS rows FROM ev WHERE event_type = 'purchase' AND ds <= '2024-01-03'")
def h9_rows_as_of(spark, d):
    return entity.state_at(ev(spark, d), SUMS, "2024-01-03").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def h10_distribution(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
