"""Queries on event logs: sources, sinks, ingest, streams, duplicates, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PrependList
from tessella.operators import entity, layout
from tessella.plans.spec import Family
from tessella.registered.base import DAY, EV, bits_sql, ev, query, table, work_dir
from tessella.sources import events as log
from tessella.streaming import jobs

#: Flushes that a stream may take in one batch.
FLUSHES = 128

DECLARED = {"user_id": "int32", "event_type": "string", "value": "double", "referrer": "string", "props": "json"}


def _times(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def _sql_time(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"WITH {EV} SELECT event_id, user_id, event_type, value, ds, hour FROM ev WHERE ds = '2024-01-10' AND hour = '05'")
def s1_scan_events(spark, d):
    return log.scan_events(ev(spark, d), "2024-01-10", "05").select("event_id", "user_id", "event_type", "value", "ds", "hour")


@query(f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id, {_sql_time('ts')} AS event_timestamp, ds, hour, CAST(user_id AS INTEGER) AS user_id, event_type, value, CAST(NULL AS VARCHAR) AS referrer, props FROM ev")
def s2_conform(spark, d):
    return _times(log.conform(ev(spark, d), DECLARED), "event_timestamp")


def _envelopes(spark, d):
    rows = ev(spark, d)
    payload = F.to_json(F.struct("user_id", F.when(F.col("user_id") % 4 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value")))
    fields = F.struct(F.col("event_type").alias("table"), F.when(F.col("event_id") % 10 != 0, F.col("event_id").cast("string")).alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp"), payload.alias("payload"))
    return rows.select(F.to_json(fields).alias("value"))


@query(f"SELECT event_type AS \"table\", CAST(event_id AS VARCHAR) AS event_id, {_sql_time('ts')} AS event_timestamp, user_id, CASE WHEN user_id % 4 <> 0 THEN value END AS value FROM events WHERE event_id % 10 <> 0")
def s3_decode_envelopes(spark, d):
    return _times(log.decode_envelopes(_envelopes(spark, d), {"user_id": "int64", "value": "double"}), "event_timestamp")


@query(f"WITH {EV} SELECT event_id, ds, hour FROM ev")
def s4_derive_partition(spark, d):
    return log.derive_partition(table(spark, d, "events"), "ts").select("event_id", "ds", "hour")


@query(f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN {_sql_time('ts')} END AS event_timestamp FROM events")
def s5_parse_event_time(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return _times(table(spark, d, "events").select("event_id", log.parse_event_time(text).alias("event_timestamp")), "event_timestamp")


@query("SELECT l_orderkey, l_linenumber, TRY_CAST(l_orderkey * 100000 AS INTEGER) AS narrow, CAST(l_linenumber AS BIGINT) AS wide, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem")
def s6_coerce(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", log.coerce(F.col("l_orderkey") * 100000, "int32").alias("narrow"), log.coerce(F.col("l_linenumber"), "int64").alias("wide"), log.coerce(F.col("l_quantity"), "double").alias("quantity"))


def _stream(spark, d, name="events"):
    return jobs.event_stream(spark, d, f"{name}.parquet", table(spark, d, name).schema)


@query(f"WITH {EV} SELECT ds, hour, count(*) AS n, round(sum(value), 2) AS total FROM ev GROUP BY ds, hour")
def s7_stream_ingest(spark, d):
    out = work_dir(spark)
    jobs.ingest(log.derive_partition(_stream(spark, d), "ts"), f"{out}/data", f"{out}/checkpoint", max_rows=10_000).awaitTermination()
    back = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
    return back.groupBy(F.date_format("ds", "yyyy-MM-dd").alias("ds"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, 0 AS over, (count(*) + 699) // 700 AS files, CAST(((count(*) + 699) // 700 + 1) // 2 AS BIGINT) AS batches FROM events")
def s7_flush_by_rows(spark, d):
    """The log in files of up to 700 rows, ingested in flushes (the SQL's batches) of up to 2000 by streams side by side: what each flush has
    written is counted. A stream's own batch takes up to FLUSHES of them."""
    out, rows = work_dir(spark), table(spark, d, "events")
    lanes = jobs.write_lanes(rows, f"{out}/log", 700, 2, min(16, spark.sparkContext.defaultParallelism))
    if not lanes:
        return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.lit(0).alias("over"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("batches"))
    log = spark.read.schema(rows.schema).parquet(*lanes)
    most = jobs.files_within(log, 2000)
    own = jobs.listing(spark)
    streams = [jobs.event_stream(own, lane, "*.parquet", rows.schema, most * FLUSHES) for lane in lanes]
    running = [jobs.ingest(s, f"{out}/data/lane={k}", f"{out}/checkpoint/{k}", (), None, None, most) for k, s in enumerate(streams)]
    for r in running:
        r.awaitTermination()
    flushes = own.read.parquet(f"{out}/data").groupBy("lane", "batch", "flush").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    files = len(log.inputFiles())
    return flushes.agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.count_if(F.col("n") > 2000).cast("int").alias("over"), F.lit(files).cast("long").alias("files"), F.count(F.lit(1)).alias("batches"))


@query("SELECT event_type AS \"table\", count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def s8_route_by_table(spark, d):
    out = work_dir(spark)
    jobs.ingest(_stream(spark, d).withColumn("table", F.col("event_type")), f"{out}/data", f"{out}/checkpoint", ("table",)).awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy(F.col("table").cast("string").alias("table")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def _commits(rows):
    """A commit a day, with the offsets reached in each partition; one partition's text is junk."""
    last = rows.groupBy("ds", (F.col("user_id") % 4).alias("p")).agg(F.max("event_id").alias("o"))
    pairs = F.collect_list(F.struct(F.col("p").cast("string").alias("key"), F.when(F.col("p") == 3, F.lit("junk")).otherwise(F.col("o").cast("string")).alias("value")))
    return last.groupBy("ds").agg(F.map_from_entries(pairs).alias("offsets"))


@query("SELECT CAST(user_id % 4 AS INTEGER) AS partition, max(event_id) AS hwm FROM events WHERE user_id % 4 <> 3 GROUP BY 1")
def s9_high_water(spark, d):
    return log.high_water(_commits(ev(spark, d)))


@query("WITH m AS (SELECT user_id % 4 AS p, max(event_id) AS hwm FROM events WHERE ts < TIMESTAMP '2024-01-16' AND user_id % 4 <> 3 GROUP BY 1) SELECT event_id AS \"offset\", CAST(user_id % 4 AS INTEGER) AS partition FROM events e LEFT JOIN m ON e.user_id % 4 = m.p WHERE event_id > coalesce(hwm, -1)")
def s10_replay_after(spark, d):
    rows = ev(spark, d)
    marks = log.high_water(_commits(rows.where("ds < '2024-01-16'")))
    return log.replay_after(rows.select(F.col("event_id").alias("offset"), (F.col("user_id") % 4).cast("int").alias("partition")), marks)


def _ingested(spark, d):
    """What a load of the log up to the middle of the month has written: a table by event type. One type has not been loaded at all."""
    path = work_dir(spark)
    rows = ev(spark, d).where("ds < '2024-01-16' and event_type <> 'error'")
    rows.select("event_id", "ts", "user_id", "event_type").write.partitionBy("event_type").parquet(path)
    return spark.read.parquet(path)


POSITION = ["ts", "event_id"]
MARKS = "m AS (SELECT event_type, max((ts, event_id)) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'error' GROUP BY 1), late AS (SELECT e.* FROM events e LEFT JOIN m USING (event_type) WHERE mark IS NULL OR (ts, event_id) > mark)"


@query(f"WITH {MARKS} SELECT event_type, mark[2] AS event_id, {_sql_time('mark[1]')} AS ts FROM m")
def s9_ingest_marks(spark, d):
    return _times(log.ingest_marks(_ingested(spark, d), "event_type", POSITION).select("event_type", "mark.event_id", "mark.ts"), "ts")


@query(f"WITH {MARKS} SELECT event_id, user_id, event_type FROM late")
def s10_rows_after_marks(spark, d):
    marks = log.ingest_marks(_ingested(spark, d), "event_type", POSITION)
    return log.rows_after(ev(spark, d), marks, "event_type", POSITION).select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*) AS n, CAST(1 AS BIGINT) AS buckets FROM events GROUP BY user_id")
def s11_write_load(spark, d):
    path, rows = work_dir(spark), table(spark, d, "events")
    layout.write_load(rows, path, ["user_id"], [layout.buckets_for(rows, 8)])
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_bucket").alias("buckets"))


@query("SELECT event_id, value FROM events")
def s12_read_load(spark, d):
    path, rows = work_dir(spark), table(spark, d, "events")
    layout.write_load(rows, path, ["user_id"], [layout.buckets_for(rows, 8)])
    return layout.read_load(spark, path, ["event_id", "value"])


@query(f"WITH {EV} SELECT ds, count(*) AS n FROM ev WHERE ds >= '2024-01-20' GROUP BY ds")
def s13_retention(spark, d):
    return log.apply_retention(ev(spark, d), 10, "2024-01-30").groupBy("ds").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 100 AS truncated, row_number() OVER (ORDER BY o_orderkey) <= 20 AS sampled FROM orders ORDER BY o_orderkey LIMIT 100")
def s14_preview(spark, d):
    return log.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


# --- duplicates, late data, health ---------------------------------------------------------------------------------------

_TTL = """WITH RECURSIVE e AS (SELECT event_id % 50 AS id, epoch_us(ts) // 1000000 AS t FROM events),
s AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY t) AS r FROM e),
k(id, r, kept, ok) AS (SELECT id, r, t, true FROM s WHERE r = 1 UNION ALL
SELECT s.id, s.r, CASE WHEN s.t - k.kept > 43200 THEN s.t ELSE k.kept END, s.t - k.kept > 43200 FROM k JOIN s ON s.id = k.id AND s.r = k.r + 1)
SELECT CAST(id AS BIGINT) AS id, CAST(kept AS BIGINT) AS t FROM k WHERE ok"""


@query(_TTL)
def t1_dedup_ttl(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 50).alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return log.dedup_ttl(rows, ["id"], "t", 43200)


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def t2_dedup_stream(spark, d):
    out = work_dir(spark)
    once = _stream(spark, d)
    stream = jobs.dedup_stream(once.union(once), "ts", ["event_type", "event_id"], "1 hour")
    jobs.ingest(stream, f"{out}/data", f"{out}/checkpoint", ("event_type",)).awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy(F.col("event_type").cast("string").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(_TTL)
def t2_dedup_ttl_stream(spark, d):
    """The same events as a stream of files in no order of time, within the delay; a last file moves the watermark past them all."""
    own, out = jobs.stateful(spark), work_dir(spark)
    rows = table(own, d, "events").select((F.col("event_id") % 50).alias("id"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at"))
    rows.repartition(3).write.parquet(f"{out}/log")
    end = rows.agg(F.lit(-1).cast("long").alias("id"), (F.max("at") + F.expr("interval 100 days")).alias("at"))
    end.coalesce(1).write.mode("append").parquet(f"{out}/log")
    stream = jobs.event_stream(own, f"{out}/log", "*.parquet", rows.schema, 2)
    jobs.ingest(jobs.dedup_ttl_stream(stream, ["id"], "at", 43200, "60 days"), f"{out}/data", f"{out}/checkpoint", ()).awaitTermination()
    return own.read.parquet(f"{out}/data").where("id >= 0").select("id", F.unix_seconds("at").alias("t"))


@query("SELECT event_id, user_id, value FROM events")
def t3_dedup_exact(spark, d):
    rows = table(spark, d, "events")
    return log.dedup_exact(rows.union(rows.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))), ["event_id"], ["ts"]).select("event_id", "user_id", "value")


@query(f"WITH {EV}, l AS (SELECT ds, hour, epoch_us(ts) // 1000000 - CAST(floor((epoch_us(ts) - CAST(floor(value) AS BIGINT) * 1000000) / 1000000.0) AS BIGINT) AS lag FROM ev) SELECT ds, hour, count(*) AS events, count(*) FILTER (WHERE lag > 60) AS late, CAST(max(lag) AS BIGINT) AS max_lag FROM l GROUP BY ds, hour")
def t4_late_arrivals(spark, d):
    happened = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) - F.floor("value"))
    return log.late_arrivals(ev(spark, d).withColumn("happened", happened), "happened", "ts", 60)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM events GROUP BY 1")
def t5_throughput(spark, d):
    return log.throughput(table(spark, d, "events"), "ts", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query(f"WITH {EV}, c AS (SELECT event_type, ds, hour, max(ts) AS done, count(*) AS n FROM ev GROUP BY ALL) SELECT event_type AS table_name, strftime(max(done), '%Y-%m-%d %H:%M:%S') AS last_commit, CAST(coalesce(sum(n) FILTER (WHERE done >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS rows_since, count(DISTINCT ds || hour) AS files FROM c GROUP BY 1")
def t6_freshness(spark, d):
    commits = ev(spark, d).groupBy(F.col("event_type").alias("table_name"), F.concat("ds", "hour").alias("file")).agg(F.max("ts").alias("committed_at"), F.count(F.lit(1)).alias("rows"))
    return log.freshness(commits, "2024-01-20").withColumn("last_commit", F.date_format("last_commit", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {MARKS} SELECT event_type, count(*) AS rows_behind, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS seconds FROM late GROUP BY 1")
def t7_ingest_lag(spark, d):
    marks = log.ingest_marks(_ingested(spark, d), "event_type", POSITION)
    return log.ingest_lag(ev(spark, d), marks, "event_type", POSITION, "ts")


@query("WITH e AS (SELECT CAST(user_id % 4 AS INTEGER) AS partition, max(event_id) AS end_offset FROM events GROUP BY 1), m AS (SELECT CAST(user_id % 4 AS INTEGER) AS p, max(event_id) AS hwm FROM events WHERE ts < TIMESTAMP '2024-01-16' AND user_id % 4 <> 3 GROUP BY 1) SELECT partition, end_offset, end_offset - coalesce(hwm, -1) AS lag FROM e LEFT JOIN m ON partition = p")
def t7_consumer_lag(spark, d):
    rows = ev(spark, d)
    ends = rows.groupBy((F.col("user_id") % 4).cast("int").alias("partition")).agg(F.max("event_id").alias("end_offset"))
    return log.consumer_lag(ends, log.high_water(_commits(rows.where("ds < '2024-01-16'"))))


@query("SELECT user_id AS entity_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events WHERE event_type = 'purchase' GROUP BY 1")
def t8_stream_family(spark, d):
    family = Family("commerce", {"n": Lifetime("count"), "total": Lifetime("sum", "value"), "top": Lifetime("max", "value")}, {"user_id": "entity_id"})
    return _streamed(spark, d, family, "event_type = 'purchase'").select("entity_id", "n", F.round("total", 2).alias("total"), "top")


def _streamed(spark, d, family, where, day=None):
    """A family kept up to date by a stream of files in no order of time, one a batch."""
    out = work_dir(spark)
    rows = ev(spark, d).where(where)
    rows.repartition(5, "event_id").write.parquet(f"{out}/log")
    jobs.stream_family(jobs.event_stream(spark, f"{out}/log", "*.parquet", rows.schema, 1), family, f"{out}/state", f"{out}/checkpoint", 2).awaitTermination()
    return entity.render(jobs.family_states(spark, f"{out}/state", family), family, day)


_LAST = entity.day_number("2024-01-30")


@query(f"WITH {EV} SELECT user_id AS entity_id, {bits_sql(f'list(DISTINCT {DAY})', _LAST, 30)} AS days, {bits_sql('list(DISTINCT epoch_us(ts) // 3600000000)', _LAST * 24 + 23, 48)} AS hours, array_to_string(list(k ORDER BY ts DESC, event_id DESC)[1:5], ',') AS ks, round(stddev_samp(value), 4) AS sd FROM ev GROUP BY 1")
def t8_stream_bitmap(spark, d):
    columns = {"days": BitmapActivity("day", 30), "hours": BitmapActivity("hour", 48), "ks": PrependList("k", 5), "sd": Lifetime("stddev", "value")}
    got = _streamed(spark, d, Family("activity", columns, {"user_id": "entity_id"}), "true", "2024-01-30")
    return got.select("entity_id", "days", "hours", F.array_join("ks", ",").alias("ks"), F.round("sd", 4).alias("sd"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS events FROM g GROUP BY user_id, n""")
def t9_sessionize(spark, d):
    return _times(log.sessionize(table(spark, d, "events"), "user_id", "ts", "30 minutes"), "start", "end")


# --- the same on streams -------------------------------------------------------------------------------------------------


def _in_order(spark, d, files=6):
    """The log as files in order of time, and a last event long after, by which all windows end."""
    out = work_dir(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    rows.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{out}/log")
    rows.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 100 days")).alias("ts")).write.mode("append").parquet(f"{out}/log")
    return jobs.event_stream(spark, f"{out}/log", "*.parquet", rows.schema, 3), out


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM events GROUP BY 1")
def t5_throughput_stream(spark, d):
    stream, out = _in_order(jobs.stateful(spark), d)
    jobs.ingest(jobs.windows_on_time(stream, "ts", "1 hour", "60 days"), f"{out}/data", f"{out}/checkpoint", ()).awaitTermination()
    got = spark.read.parquet(f"{out}/data")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS events FROM g GROUP BY user_id, n""")
def t9_sessionize_stream(spark, d):
    stream, out = _in_order(jobs.stateful(spark), d)
    jobs.ingest(jobs.sessions_on_time(stream, "user_id", "ts", "30 minutes", "60 days"), f"{out}/data", f"{out}/checkpoint", ()).awaitTermination()
    return _times(spark.read.parquet(f"{out}/data"), "start", "end")


@query(f"WITH {EV}, h AS (SELECT event_id, (day(ts) - 1) // 6 AS part, CASE WHEN event_id % 9 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END AS happened FROM ev), n AS (SELECT *, max(happened) OVER (ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM h) SELECT coalesce(happened < newest - INTERVAL 1 DAY, false) AS late, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM n GROUP BY 1")
def t4_late_stream(spark, d):
    """A batch for every six days, in which every ninth event happened three days before; a day's delay is allowed."""
    out = work_dir(spark)
    happened = F.when(F.col("event_id") % 9 == 0, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts"))
    rows = ev(spark, d).select("event_id", happened.alias("happened"), F.floor((F.dayofmonth("ts") - 1) / 6).alias("part"))
    for part in range(6):  # one after the other: a stream of files takes the oldest file first
        rows.where(F.coalesce("part", F.lit(5)) == part).drop("part").coalesce(1).write.parquet(f"{out}/log/{part}")  # what has no time comes last
    stream = spark.readStream.schema("event_id long, happened timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{out}/log/*")
    jobs.split_by_lateness(stream, "happened", 86400, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    parts = [spark.read.parquet(f"{out}/data/{name}/*").select("event_id", F.lit(name == "late").alias("late")) for name in ("on_time", "late")]
    return parts[0].unionByName(parts[1]).groupBy("late").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))
