"""Queries on stitched tables, versions and layout."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import entity, layout, stored, versions
from tessella.registered.base import EV, LOADS, ev, loads, query, table, work_dir

ID = ["entity_id"]
ALL = "SELECT * FROM st"


@query(f"WITH {LOADS} {ALL}")
def r1_stitch(spark, d):
    return entity.stitch(loads(spark, d), ID)


@query(f"WITH {LOADS} {ALL}")
def r1_stitch_joined(spark, d):
    return entity.stitch_joined(loads(spark, d), ID)


def named(spark, d):
    return dict(zip(("browsing", "engagement", "commerce"), loads(spark, d), strict=True))


@query(f"WITH {LOADS} SELECT entity_id, spend, purchases FROM p")
def r2_column_pruning(spark, d):
    return entity.select_columns(named(spark, d), ID, ["spend", "purchases"])


@query(f"WITH {LOADS} SELECT entity_id, spend FROM st")
def r2_all_keys(spark, d):
    return entity.select_columns(named(spark, d), ID, ["spend"], all_keys=True)


@query(f"WITH {LOADS} SELECT entity_id FROM st")
def r3_keys(spark, d):
    return entity.select_columns(named(spark, d), ID, [])


@query(f"WITH {LOADS} {ALL} WHERE entity_id = 7")
def r4_point_lookup(spark, d):
    return entity.stitch(entity.only_keys(loads(spark, d), "entity_id", equals=7), ID)


@query(f"WITH {LOADS} {ALL} WHERE entity_id IN (3, 5, 9, 1000000)")
def r5_in_list(spark, d):
    return entity.stitch(entity.only_keys(loads(spark, d), "entity_id", among=[3, 5, 9, 1000000]), ID)


@query(f"WITH {LOADS} {ALL} WHERE entity_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def r5_in_table(spark, d):
    wanted = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("entity_id"))
    return entity.stitch(entity.only_keys(loads(spark, d), "entity_id", among=wanted), ID)


@query(f"WITH {LOADS} {ALL} WHERE entity_id BETWEEN 10 AND 20")
def r6_between(spark, d):
    return entity.stitch(entity.only_keys(loads(spark, d), "entity_id", between=(10, 20)), ID)


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) FILTER (WHERE l_returnflag <> 'A') AS qty, max(l_tax) FILTER (WHERE l_returnflag <> 'R') AS tax FROM lineitem GROUP BY 1, 2")
def r7_composite_key(spark, d):
    rows = table(spark, d, "lineitem")
    k = ["l_orderkey", "l_linenumber"]
    a = rows.where("l_returnflag <> 'A'").groupBy(*k).agg(F.max("l_quantity").alias("qty"))
    b = rows.where("l_returnflag <> 'R'").groupBy(*k).agg(F.max("l_tax").alias("tax"))
    return entity.stitch([a, b, rows.select(*k)], k)


@query(f"WITH {EV}, n AS (SELECT nullif(user_id, 3) AS entity_id, event_type FROM ev) SELECT entity_id, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS views, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks FROM n WHERE event_type IN ('view', 'click') GROUP BY 1")
def r8_null_key(spark, d):
    rows = ev(spark, d).withColumn("entity_id", F.nullif(F.col("user_id"), F.lit(3)))
    parts = [rows.where(f"event_type = '{t}'").groupBy("entity_id").agg(F.count(F.lit(1)).alias(c)) for t, c in (("view", "views"), ("click", "clicks"))]
    return entity.stitch(parts, ID)


@query(f"WITH {EV} SELECT user_id AS entity_id, arg_max(value, (ts, event_id)) AS value, max(event_id) FILTER (WHERE false) AS other FROM ev GROUP BY 1")
def r9_duplicate_key(spark, d):
    rows = ev(spark, d).withColumnRenamed("user_id", "entity_id")
    return entity.newest_row(rows, ID, ["ts", "event_id"]).select("entity_id", "value", F.lit(None).cast("bigint").alias("other"))


@query(f"WITH {EV}, n AS (SELECT user_id AS entity_id, arg_max((value, k), (ts, event_id)) AS r FROM ev WHERE event_type <> 'purchase' GROUP BY 1), p AS (SELECT user_id AS entity_id, arg_max(value, (ts, event_id)) AS paid FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT entity_id, r[1] AS value, r[2] AS k, paid FROM n FULL JOIN p USING (entity_id)")
def r9_stitch_duplicate_keys(spark, d):
    """Loads with several rows a key: the newest row of each is taken whole, nulls and all."""
    rows = ev(spark, d).withColumnRenamed("user_id", "entity_id")
    a = rows.where("event_type <> 'purchase'").select("entity_id", "ts", "event_id", "value", "k")
    b = rows.where("event_type = 'purchase'").select("entity_id", "ts", "event_id", F.col("value").alias("paid"))
    return entity.stitch([a, b], ID, order=["ts", "event_id"])


@query(f"WITH {LOADS} SELECT entity_id, view_count, spend, CAST(NULL AS BIGINT) AS refunds FROM v FULL JOIN p USING (entity_id)")
def r10_missing_column(spark, d):
    v, _, p = loads(spark, d)
    return entity.stitch([v.select("entity_id", "view_count"), p.select("entity_id", "spend").withColumn("refunds", F.lit(None).cast("bigint"))], ID)


@query(f"WITH {LOADS} SELECT entity_id, coalesce(purchases, 0) AS purchases, round(spend / nullif(purchases, 0), 6) AS avg_order_value, coalesce(purchases, 0) > 10 AS frequent FROM st")
def r11_derived(spark, d):
    st = entity.stitch(loads(spark, d), ID, zero=["purchases"])
    return entity.derive(st, {"avg_order_value": "round(try_divide(spend, purchases), 6)", "frequent": "purchases > 10"}).select("entity_id", "purchases", "avg_order_value", "frequent")


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def r12_key_prefix(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(orders, "l_orderkey", "left")


@query(f"WITH {EV}, n AS (SELECT nullif(user_id, 3) AS entity_id, event_type FROM ev) SELECT entity_id, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS views, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks FROM n WHERE event_type IN ('view', 'click') GROUP BY 1")
def r8_null_key_joined(spark, d):
    rows = ev(spark, d).withColumn("entity_id", F.nullif(F.col("user_id"), F.lit(3)))
    parts = [rows.where(f"event_type = '{t}'").groupBy("entity_id").agg(F.count(F.lit(1)).alias(c)) for t, c in (("view", "views"), ("click", "clicks"))]
    return entity.stitch_joined(parts, ID)


def ranged(spark, d):
    """The three families written as loads by ranges of the key."""
    paths = []
    for load in loads(spark, d):
        paths.append(work_dir(spark))
        stored.write_ranged(load, paths[-1], ID, 8)
    return paths


def looked_up(spark, d, **how):
    return entity.stitch([stored.lookup(spark, path, "entity_id", **how) for path in ranged(spark, d)], ID)


@query(f"WITH {LOADS} {ALL} WHERE entity_id = 7")
def r4_lookup_of_written(spark, d):
    return looked_up(spark, d, equals=7)


@query(f"WITH {LOADS} {ALL} WHERE entity_id IN (3, 5, 9, 1000000)")
def r5_list_of_written(spark, d):
    return looked_up(spark, d, among=[3, 5, 9, 1000000])


@query(f"WITH {LOADS} {ALL} WHERE entity_id BETWEEN 10 AND 20")
def r6_range_of_written(spark, d):
    return looked_up(spark, d, between=(10, 20))


# --- versions: a commit for each day and family, at the next midnight ----------------------------------------------------

COLUMNS = {"view": ["view_count", "view_value"], "click": ["recent", "active"], "purchase": ["spend", "purchases"]}


def change_log(spark, d):
    """column_loads: what each commit loaded. Every third day has hourly loads as well."""
    per = ev(spark, d).where(F.col("event_type").isin(list(COLUMNS))).select("ds", "event_type").distinct()
    numbered = per.withColumn("version", F.row_number().over(Window.orderBy("ds", "event_type")))  # commit records: one row a load
    cols = F.create_map(*(x for k, v in COLUMNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    day = F.dayofmonth(F.to_date("ds"))
    return numbered.select(
        F.lit("behaviour").alias("table_name"), F.explode(cols[F.col("event_type")]).alias("column_name"), "ds",
        F.when(day % 3 == 0, F.lit(5)).cast("int").alias("hour"), F.concat("event_type", F.lit("-"), "ds").alias("load_id"), "version",
        (F.to_date("ds") + F.expr("interval 1 day")).cast("timestamp_ntz").alias("committed_at"),
    )


CHANGES = f"""{EV}, per AS (SELECT DISTINCT ds, event_type FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
num AS (SELECT *, CAST(row_number() OVER (ORDER BY ds, event_type) AS INTEGER) AS version FROM per),
names(event_type, column_name) AS (VALUES ('view', 'view_count'), ('view', 'view_value'), ('click', 'recent'), ('click', 'active'), ('purchase', 'spend'), ('purchase', 'purchases')),
cl AS (SELECT 'behaviour' AS table_name, column_name, ds, CASE WHEN day(CAST(ds AS DATE)) % 3 = 0 THEN 5 END AS hour, event_type || '-' || ds AS load_id, version, CAST(CAST(ds AS DATE) + 1 AS TIMESTAMP) AS committed_at FROM num JOIN names USING (event_type)),
mf AS (SELECT table_name, version, column_name, load_id FROM (SELECT 'behaviour' AS table_name, v.version, c.column_name, arg_max(cl.load_id, cl.version) AS load_id FROM (SELECT DISTINCT version FROM cl) v CROSS JOIN (SELECT DISTINCT column_name FROM cl) c JOIN cl ON cl.column_name = c.column_name AND cl.version <= v.version GROUP BY ALL) t),
cm AS (SELECT DISTINCT table_name, version, load_id, committed_at FROM cl)"""


def commits(changes):
    return changes.select("table_name", "version", "load_id", "committed_at").distinct()


def plain(df):
    return df.withColumn("committed_at", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss")) if "committed_at" in df.columns else df


@query(f"WITH {CHANGES} SELECT * FROM mf")
def v1_carry_forward(spark, d):
    return versions.carry_forward(change_log(spark, d))


@query(f"WITH {CHANGES} SELECT * FROM mf WHERE version = (SELECT max(version) FROM cm)")
def v2_resolve_latest(spark, d):
    c = change_log(spark, d)
    return versions.resolve_latest(commits(c), versions.carry_forward(c))


@query(f"WITH {CHANGES} SELECT * FROM mf WHERE version = (SELECT max(version) FROM cm WHERE committed_at <= TIMESTAMP '2024-01-12 10:00:00')")
def v3_resolve_wall_time(spark, d):
    c = change_log(spark, d)
    return versions.resolve_wall_time(commits(c), versions.carry_forward(c), "2024-01-12 10:00:00")


def hourly(spark, d):
    """The changes, with an earlier and a later hourly load of one day."""
    c = change_log(spark, d)
    more = c.where("ds = '2024-01-09' and column_name = 'spend'")
    extra = [more.withColumns({"hour": F.lit(h).cast("int"), "load_id": F.concat("load_id", F.lit(f"-{h}")), "version": F.col("version") + 1000 + (h or 0)}) for h in (None, 2, 17)]
    return c.unionByName(extra[0]).unionByName(extra[1]).unionByName(extra[2])


HOURLY = CHANGES + ", hl AS (SELECT * FROM cl UNION ALL SELECT table_name, column_name, ds, h AS hour, load_id || '-' || coalesce(CAST(h AS VARCHAR), 'None') AS load_id, version + 1000 + coalesce(h, 0) AS version, committed_at FROM cl CROSS JOIN (VALUES (NULL::INTEGER), (2), (17)) x(h) WHERE ds = '2024-01-09' AND column_name = 'spend')"


@query(f"WITH {HOURLY} SELECT column_name, hour, load_id, version FROM hl WHERE ds = '2024-01-09' QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY coalesce(hour, -1) DESC) = 1")
def v4_resolve_ds(spark, d):
    return versions.resolve_ds(hourly(spark, d), "2024-01-09").select("column_name", "hour", "load_id", "version")


@query(f"WITH {HOURLY} SELECT column_name, load_id, version FROM hl WHERE ds = '2024-01-09' AND hour = 2")
def v5_resolve_hour(spark, d):
    return versions.resolve_ds(hourly(spark, d), "2024-01-09", 2).select("column_name", "load_id", "version")


@query(f"WITH {HOURLY} SELECT a.column_name FROM (SELECT DISTINCT column_name FROM hl UNION ALL SELECT 'refunds') a WHERE a.column_name NOT IN (SELECT column_name FROM hl WHERE ds = '2024-01-09' AND hour = 2)")
def v6_missing_columns(spark, d):
    h = hourly(spark, d)
    asked = h.select("table_name", "column_name").distinct()
    asked = asked.union(asked.select("table_name", F.lit("refunds")).distinct())
    return versions.missing_columns(asked, versions.resolve_ds(h, "2024-01-09", 2)).select("column_name")


@query(f"WITH {CHANGES}, two AS (SELECT * FROM cl UNION ALL SELECT table_name, column_name, ds, hour, load_id || '-again', version + 500, committed_at FROM cl WHERE ds < '2024-01-05') SELECT column_name, ds, hour, load_id, version FROM two QUALIFY row_number() OVER (PARTITION BY column_name, ds, hour ORDER BY version DESC) = 1")
def v7_latest_column_loads(spark, d):
    c = change_log(spark, d)
    again = c.where("ds < '2024-01-05'").withColumns({"load_id": F.concat("load_id", F.lit("-again")), "version": F.col("version") + 500})
    return versions.latest_column_loads(c.unionByName(again)).select("column_name", "ds", "hour", "load_id", "version")


@query(f"WITH {CHANGES} SELECT column_name, load_id, (SELECT max(version) + 1 FROM cm) AS version FROM mf WHERE version = 12")
def v8_rollback(spark, d):
    c = change_log(spark, d)
    done, maps = versions.rollback(commits(c), versions.carry_forward(c), 12, "2024-02-15 00:00:00")
    return versions.resolve_latest(done, maps).select("column_name", "load_id", "version")


@query(f"WITH {CHANGES} SELECT load_id, version FROM cm")
def v9_dedupe_commits(spark, d):
    c = commits(change_log(spark, d))
    return versions.dedupe_commits(c.unionByName(c.withColumn("version", F.col("version") + 100))).select("load_id", "version")


@query(f"WITH {CHANGES}, w AS (SELECT load_id, committed_at AS written_at FROM cm UNION ALL SELECT load_id || '-lost', committed_at FROM cm) SELECT load_id FROM w WHERE load_id NOT IN (SELECT load_id FROM mf) AND written_at < TIMESTAMP '2024-01-20 01:30:00' - INTERVAL 1 HOUR")
def v10_orphan_loads(spark, d):
    c = change_log(spark, d)
    w = commits(c).select("load_id", F.col("committed_at").alias("written_at"))
    w = w.unionByName(w.withColumn("load_id", F.concat("load_id", F.lit("-lost"))))
    return versions.orphan_loads(w, versions.carry_forward(c), "2024-01-20 01:30:00").select("load_id")


@query(f"WITH {CHANGES} SELECT load_id, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM mf WHERE version = (SELECT max(version) FROM cm) AND column_name IN ('spend', 'purchases', 'recent') GROUP BY load_id")
def v11_columns_by_load(spark, d):
    c = change_log(spark, d)
    latest = versions.resolve_latest(commits(c), versions.carry_forward(c))
    return versions.columns_by_load(latest, ["spend", "purchases", "recent"]).select("load_id", F.array_join("columns", ",").alias("columns"))


READ = f"""WITH {CHANGES}, lv AS (SELECT user_id AS entity_id, event_type || '-' || ds AS load_id, count(*) AS n, round(sum(value), 2) AS s FROM ev GROUP BY ALL),
m AS (SELECT * FROM mf WHERE version = (SELECT max(version) FROM cm WHERE committed_at <= TIMESTAMP '2024-01-12 10:00:00'))
SELECT entity_id, view_count, spend FROM (SELECT entity_id, n AS view_count FROM lv WHERE load_id = (SELECT load_id FROM m WHERE column_name = 'view_count')) a FULL JOIN (SELECT entity_id, s AS spend FROM lv WHERE load_id = (SELECT load_id FROM m WHERE column_name = 'spend')) b USING (entity_id)"""


_WRITTEN: dict[tuple[str, str], str] = {}


def written(spark, d):
    """The loads of each day and event type, written under their names, and read back with them. Loads never change, so a program writes
    them once."""
    own = spark.sparkContext.applicationId, d
    if own in _WRITTEN:
        return spark.read.parquet(_WRITTEN[own])
    path = work_dir(spark)
    data = ev(spark, d).groupBy(F.col("user_id").alias("entity_id"), F.concat("event_type", F.lit("-"), "ds").alias("load_id")).agg(F.count(F.lit(1)).alias("view_count"), F.round(F.sum("value"), 2).alias("spend"))
    versions.write_loads(data, path)
    _WRITTEN[own] = path
    return spark.read.parquet(path)


@query(READ)
def v12_read_as_of(spark, d):
    c = change_log(spark, d)
    at = versions.resolve_wall_time(commits(c), versions.carry_forward(c), "2024-01-12 10:00:00")
    return versions.read_loads(written(spark, d), at, ID, ["view_count", "spend"])


@query(f"""WITH {CHANGES}, lv AS (SELECT user_id AS entity_id, event_type || '-' || ds AS load_id, count(*) AS n, round(sum(value), 2) AS s FROM ev GROUP BY ALL)
SELECT entity_id, view_count, spend FROM (SELECT entity_id, n AS view_count FROM lv WHERE load_id = 'view-2024-01-10') a FULL JOIN (SELECT entity_id, s AS spend FROM lv WHERE load_id = 'purchase-2024-01-10') b USING (entity_id)""")
def v12_write_commit_read(spark, d):
    """Loads are written, then committed as a log of changes that is a table itself, and a day is read back through it."""
    data, path = written(spark, d), work_dir(spark)
    done = data.select("load_id").distinct().join(change_log(spark, d), "load_id")
    done.repartition(1).write.parquet(path)
    return versions.read_loads(data, versions.resolve_ds(spark.read.parquet(path), "2024-01-10"), ID, ["view_count", "spend"])


# --- layout --------------------------------------------------------------------------------------------------------------

_TABLES = {"lineitem": 2, "orders": 1, "events": 3}


def _levels_sql(name, n):
    bits = "CAST(log2(least(4096, power(2, ceil(log2(greatest(1, ceil(c * 20000.0 / 134217728))))))) AS INTEGER)"
    parts = ", ".join(f"CAST(power(2, b // {n} + CASE WHEN {k} < b % {n} THEN 1 ELSE 0 END) AS BIGINT)" for k in range(n))
    return f"SELECT '{name}' AS name, array_to_string([{parts}], ',') AS levels FROM (SELECT {bits} AS b FROM (SELECT count(*) AS c FROM {name}) t) u"


@query(" UNION ALL ".join(_levels_sql(t, n) for t, n in _TABLES.items()))
def b1_bucket_levels(spark, d):
    rows = [(t, ",".join(map(str, layout.bucket_levels(table(spark, d, t).count(), 20000, n)))) for t, n in _TABLES.items()]
    return spark.createDataFrame(rows, "name string, levels string")


@query("SELECT l_orderkey, CAST(1 AS BIGINT) AS buckets, true AS in_range FROM lineitem GROUP BY 1")
def b2_bucket_id(spark, d):
    b = layout.bucket_id(["l_orderkey"], [64])
    return table(spark, d, "lineitem").select("l_orderkey", b.alias("b")).groupBy("l_orderkey").agg(F.count_distinct("b").alias("buckets"), (F.max("b") < 64).alias("in_range"))


@query("SELECT l_orderkey, l_linenumber, CAST((l_orderkey % 8) * 4 + l_linenumber % 4 AS BIGINT) AS fine, CAST((l_orderkey % 8 % 4) * 2 + l_linenumber % 4 % 2 AS BIGINT) AS coarse FROM lineitem")
def b3_align(spark, d):
    fine = layout.flat_bucket([F.col("l_orderkey"), F.col("l_linenumber")], [8, 4])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fine.alias("fine"), layout.align(fine, [8, 4], [4, 2]).alias("coarse"))


@query("WITH n AS (SELECT l_orderkey % 16 AS b, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS buckets, min(n) AS least, max(n) AS greatest, CAST(median(n) AS DOUBLE) AS median, quantile_cont(CAST(n AS DOUBLE), 0.95) AS p95, count(*) FILTER (WHERE n > 3600) AS oversized FROM n")
def b4_bucket_stats(spark, d):
    return layout.bucket_stats(table(spark, d, "lineitem"), F.col("l_orderkey") % 16, 1800)


def bucketed(spark, d, name, key, n):
    """A table dealt out by its key, under a name and in a folder of its own, so that no call meets the files of another."""
    saved = f"{name}_by_{n}_{uuid.uuid4().hex}"
    layout.save_bucketed(table(spark, d, name).withColumnRenamed(key, "k"), saved, ["k"], n, work_dir(spark))
    return spark.table(saved)


JOINED = "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def by_status(lines, orders):
    return lines.hint("merge").join(orders, "k").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def sized(spark, d, name, least):
    """As many buckets as a table's own size asks for, so that what a task sorts does not grow with it."""
    return layout.buckets_for(table(spark, d, name), least)


@query(JOINED)
def b5_co_partitioned(spark, d):
    n = sized(spark, d, "lineitem", 8)
    return by_status(bucketed(spark, d, "lineitem", "l_orderkey", n), bucketed(spark, d, "orders", "o_orderkey", n))


@query(JOINED)
def b3_join_of_unlike_buckets(spark, d):
    """Tables of which one has half the other's buckets, 8 or more: Spark reads two of these as one, and neither side is shuffled."""
    own, n = layout.session_of_unlike_buckets(spark), sized(spark, d, "lineitem", 8)
    return by_status(bucketed(own, d, "lineitem", "l_orderkey", n), bucketed(own, d, "orders", "o_orderkey", n // 2))


@query("SELECT l_orderkey AS k, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (1, 33, 70)")
def b2_bucketed_lookup(spark, d):
    """Keys of a bucketed table: only the buckets that may have them are read."""
    return bucketed(spark, d, "lineitem", "l_orderkey", sized(spark, d, "lineitem", 8)).where(F.col("k").isin(1, 33, 70)).select("k", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1")
def b1_sized_buckets(spark, d):
    """As many buckets as the table's own size asks for; a count by key then needs no shuffle."""
    return bucketed(spark, d, "lineitem", "l_orderkey", sized(spark, d, "lineitem", 1)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33")
def b6_bucket_pruning(spark, d):
    path, levels = work_dir(spark), [sized(spark, d, "lineitem", 16)]
    layout.write_load(table(spark, d, "lineitem"), path, ["l_orderkey"], levels)
    bucket = spark.range(1).select(F.lit(33).cast("bigint").alias("l_orderkey")).select(layout.bucket_id(["l_orderkey"], levels)).first()[0]
    return layout.read_load(spark, path, ["l_orderkey", "l_linenumber", "l_quantity"], bucket).where("l_orderkey = 33")
