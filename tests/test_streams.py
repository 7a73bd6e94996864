"""Streams: states kept up to date in runs, deduplication with a time to live."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PrependList
from tessella.operators import entity
from tessella.plans.spec import Family
from tessella.sources import events as log
from tessella.streaming import jobs

SCHEMA = "user_id long, event_id long, event_timestamp timestamp, value double, k string"
FAMILY = Family(
    "f",
    {"n": Lifetime("count"), "s": Lifetime("sum", "value"), "low": Lifetime("min", "value"), "a": Lifetime("avg", "value"), "sd": Lifetime("stddev", "value"), "ks": Lifetime("count_distinct", "k"), "last": Lifetime("last", "k"), "recent": PrependList("k", 3), "days": BitmapActivity("day", 10)},
    {"user_id": "id"},
)


def batch(spark, path, name, rows):
    df = spark.createDataFrame(rows, "user_id long, event_id long, at long, value double, k string")
    df.select("user_id", "event_id", F.timestamp_seconds("at").alias("event_timestamp"), "value", "k").coalesce(1).write.parquet(f"{path}/{name}")


def events(rng, n, users):
    return [(None if (u := rng.randrange(users)) == 0 else u, rng.randrange(10**9), 86400 * rng.randrange(100, 130) + rng.randrange(86400), float(rng.randrange(100)), rng.choice("abcd")) for _ in range(n)]


def run(spark, path, **how):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    jobs.stream_family(reader, FAMILY, f"{path}/state", f"{path}/checkpoint", **how).awaitTermination()


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def shown(df):
    rounded = df.withColumns({c: F.round(c, 6) for c in ("a", "sd", "s")})
    return sorted(map(str, rounded.select("id", *FAMILY.columns).collect()))


def test_runs_are_combined_and_equal_one_pass(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path)
    for i in range(7):
        batch(spark, f"{path}/log", f"{i}", events(rng, 60, 12))
        run(spark, path, fan=2)
        whole = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/log")
        got, want = jobs.family_states(spark, f"{path}/state", FAMILY), entity.total(whole, FAMILY)
        assert shown(entity.render(got, FAMILY, "1970-05-20")) == shown(entity.render(want, FAMILY, "1970-05-20"))
    live = jobs._log(spark, f"{path}/state")
    assert len(live) <= 3 and {jobs._level(r) for r in live[max(live)]} == {0, 1, 2}  # 7 batches: 4 + 2 + 1
    assert len(list(Path(f"{path}/state/runs").iterdir())) <= 8  # what nobody reads is gone


def test_a_batch_writes_in_proportion(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path)
    batch(spark, f"{path}/log", "0", [(u, u, 86400 * 100, 1.0, str(rng.random())) for u in range(1, 20001)])
    run(spark, path)
    first = size(f"{path}/state/runs")
    batch(spark, f"{path}/log", "1", [(u * 97 % 20000 + 1, 10**6 + u, 86400 * 101, 1.0, "z") for u in range(200)])
    run(spark, path)
    assert size(f"{path}/state/runs") - first < first / 20
    assert jobs.family_states(spark, f"{path}/state", FAMILY).agg(F.sum("n")).first()[0] == 20200


def test_a_batch_that_fails_counts_once(spark, tmp_path):
    """It fails once before its log entry, when readers see the batch before, and once after it, when it is not done again."""
    rng, path = random.Random(3), str(tmp_path)
    batch(spark, f"{path}/log", "0", events(rng, 40, 5))
    run(spark, path, fan=2)
    seen = shown(entity.render(jobs.family_states(spark, f"{path}/state", FAMILY), FAMILY, "1970-05-20"))
    batch(spark, f"{path}/log", "1", events(rng, 40, 5))
    run(spark, path, fan=2)
    done = shown(entity.render(jobs.family_states(spark, f"{path}/state", FAMILY), FAMILY, "1970-05-20"))
    entry, commit = Path(path, "state/log/v=1/_SUCCESS"), Path(path, "checkpoint/commits/1")
    os.remove(entry)
    assert shown(entity.render(jobs.family_states(spark, f"{path}/state", FAMILY), FAMILY, "1970-05-20")) == seen
    for gone in ([commit], [commit, entry]):
        for f in gone:
            if f.exists():
                os.remove(f)
            crc = f.with_name(f".{f.name}.crc")
            if crc.exists():
                os.remove(crc)
        run(spark, path, fan=2)
        assert shown(entity.render(jobs.family_states(spark, f"{path}/state", FAMILY), FAMILY, "1970-05-20")) == done


@pytest.mark.parametrize("seed", [1, 2])
def test_time_to_live_on_a_stream(spark, tmp_path, seed):
    """Ids that come back after half a window, just under and over one, and after two; out of order within the delay; null keys."""
    rng, path = random.Random(seed), str(tmp_path)
    own, width = jobs.stateful(spark), 1000
    rows = [("fixed", t) for t in (0, 500, 900, 1000, 1001, 1100, 2200, 4400)]
    rows += [(rng.choice(["a", "b", None]), rng.randrange(20000)) for _ in range(120)]
    rows = [(g, 10**6 + t, i) for i, (g, t) in enumerate(rows)] + [("a", 10**6 + 5, 900), ("a", 10**6 + 5, 901)]
    by_time = sorted(rows, key=lambda r: r[1] + rng.randrange(1500))  # late by up to 1500 seconds
    schema = "id string, t long, n long"
    for i in range(0, len(by_time), 20):
        own.createDataFrame(by_time[i : i + 20], schema).withColumn("at", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{path}/log")
    own.createDataFrame([("end", 10**8, 0)], schema).withColumn("at", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{path}/log")
    for limit in (1, None):  # in many batches, with a stop in between; then all that is left
        stream = jobs.event_stream(own, f"{path}/log", "*.parquet", own.read.parquet(f"{path}/log").schema, limit)
        jobs.ingest(jobs.dedup_ttl_stream(stream, ["id"], "at", width, "1600 seconds"), f"{path}/out", f"{path}/checkpoint", ()).awaitTermination()
    got = sorted((str(r.id), r.t, r.n) for r in own.read.parquet(f"{path}/out").where("id is null or id <> 'end'").collect())
    whole = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("t"))
    want = sorted((str(r.id), r.t, r.n) for r in log.dedup_ttl(whole, ["id"], "at", width).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and {r[1] for r in got if r[0] == "fixed"} == {10**6 + t for t in (0, 1001, 2200, 4400)}


def test_a_log_is_flushed_by_streams_side_by_side(spark, tmp_path, monkeypatch):
    """Files of 700 rows in lanes, all full but one, whatever the partitions; several streams ingest them, in as many batches as one would."""
    from tessella.queries import QUERIES

    rows = spark.range(12_345, numPartitions=7).where("id < 3000 or id > 3700").selectExpr("id event_id", "timestamp_ntz'2024-01-01' ts", "id user_id", "'view' event_type", "1.0D value", "'{}' props")
    n = 12_345 - 701
    lanes = jobs.write_lanes(rows, f"{tmp_path}/log", 700, 2, 3)
    sizes = [sorted(r["count"] for r in spark.read.parquet(lane).groupBy(F.input_file_name()).count().collect()) for lane in lanes]
    assert sum(map(sum, sizes)) == n and sorted(x for s in sizes for x in s) == [n % 700] + [700] * (n // 700)
    assert sum((len(s) + 1) // 2 for s in sizes) == (n // 700 + 2) // 2
    assert jobs.write_lanes(rows.where("false"), f"{tmp_path}/none", 700, 2, 3) == []
    rows.write.parquet(f"{tmp_path}/events.parquet")
    started, ingest = [], jobs.ingest
    monkeypatch.setattr(jobs, "ingest", lambda *a: (started.append(a), ingest(*a))[1])
    got = QUERIES["s7_flush_by_rows"](spark, str(tmp_path)).first()
    assert tuple(got) == (n, float(n), 0, n // 700 + 1, (n // 700 + 2) // 2) and len(started) > 1


def commits(checkpoint):
    return [f for f in Path(checkpoint, "commits").iterdir() if f.name.isdigit()]


def test_a_batch_writes_many_flushes(spark, tmp_path):
    """25 files of 10 rows, 12 a batch, 3 a flush: whole files, a written file for each flush, and no more of them if a batch is run again."""
    path, want = str(tmp_path), [4, 4, 1]
    spark.range(250).selectExpr("id", "id div 10 AS f", "id % 2 AS p").repartitionById(25, F.expr("int(f)")).write.parquet(f"{path}/log")

    def run(to, *partitions):
        stream = jobs.event_stream(spark, f"{path}/log", "*.parquet", "id long, f long, p long", 12)
        jobs.ingest(stream, f"{path}/{to}", f"{path}/{to}-checkpoint", partitions, None, None, 3).awaitTermination()
        rows = spark.read.parquet(f"{path}/{to}").withColumn("at", F.input_file_name())
        return [tuple(r) for r in rows.groupBy("batch", "flush").agg(F.count_distinct("at"), F.count_distinct("f"), F.count("id"), F.min("id"), F.sum("id")).orderBy("batch", "flush").collect()]

    first = run("data")
    assert [sum(r[0] == b for r in first) for b in range(3)] == want and len(commits(f"{path}/data-checkpoint")) == 3
    assert [r[2:5] for r in first] == [(1, 3, 30)] * 8 + [(1, 1, 10)] and sum(r[6] for r in first) == 250 * 249 // 2
    for f in Path(f"{path}/data-checkpoint/commits").glob("*2*"):
        os.remove(f)
    assert run("data") == first and len(commits(f"{path}/data-checkpoint")) == 3
    assert [r[2:5] for r in run("parted", "p")] == [(2, 3, 30)] * 8 + [(2, 1, 10)]


def test_batches_of_a_flushed_log_are_few(spark, tmp_path, monkeypatch):
    """43 files of 700 rows are 22 flushes, but no more batches than streams."""
    from tessella.queries import QUERIES

    spark.range(30_000).selectExpr("id event_id", "timestamp_ntz'2024-01-01' ts", "id user_id", "'view' event_type", "1.0D value", "'{}' props").write.parquet(f"{tmp_path}/events.parquet")
    started, ingest = [], jobs.ingest
    monkeypatch.setattr(jobs, "ingest", lambda *a: (started.append(a[2]), ingest(*a))[1])
    assert tuple(QUERIES["s7_flush_by_rows"](spark, str(tmp_path)).first()) == (30_000, 30_000.0, 0, 43, 22)
    assert sum(len(commits(c)) for c in started) == len(started) < 22


def test_late_events_are_those_of_the_sql(spark, tmp_path):
    """Batches by days, one of them empty, with late events and events without a time: as the same SQL gives on Spark."""
    from tessella.queries import ORACLES, QUERIES

    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.05 else f"2024-01-{rng.choice([*range(1, 13), *range(19, 32)]):02} {rng.randrange(24):02}:00:00") for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "1L user_id", "'view' event_type", "1.0D value", "'{}' props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    events.createOrReplaceTempView("late_events")
    sql = "WITH ev AS (SELECT event_id, ts FROM late_events)" + ORACLES["t4_late_stream"].split(" AS k FROM events)")[1].replace("//", "div").replace("CAST(sum(event_id) AS BIGINT)", "sum(event_id)")
    want = {tuple(r) for r in spark.sql(sql).collect()}
    assert {r[0] for r in want} == {False, True} and sum(r[1] for r in want) == 600
    assert {tuple(r) for r in QUERIES["t4_late_stream"](spark, str(tmp_path)).select("late", "events", "ids").collect()} == want
