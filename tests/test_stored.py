"""Written loads and states: what a lookup opens, what a cascade reads and writes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PrependList
from tessella.operators import entity, stored
from tessella.plans.spec import Family
from tessella.streaming import jobs


def scanned(df):
    """Rows that come out of a query's scans."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("load"))
    rng = random.Random(1)
    rows = [(rng.randrange(40_000) if rng.random() < 0.999 else None, i, f"name-{i * 7919 % 100_003}", "x" * 60 + str(rng.random())) for i in range(80_000)]
    df = spark.createDataFrame(rows, "id long, n long, name string, filler string")
    before, stored.ROW_GROUP = stored.ROW_GROUP, 64 << 10
    stored.write_ranged(df, path, ["id", "n"], 6, bloom=["name"])
    stored.ROW_GROUP = before
    return path, rows


def test_a_lookup_opens_one_file(spark, load):
    path, rows = load
    for i in (0, 17, 39_999, 20_000):
        found = stored.lookup(spark, path, "id", equals=i, columns=["n"])
        assert sorted(r.n for r in found.collect()) == sorted(n for k, n, _, _ in rows if k == i)
        assert len(found.inputFiles()) == 1 and scanned(found) < 8_000  # of some 13 000 in the file
    assert stored.lookup(spark, path, "id", equals=70_000).count() == 0 and stored.lookup(spark, path, "id", among=[]).count() == 0


def test_a_range_opens_the_files_it_touches(spark, load):
    path, rows = load
    found = stored.lookup(spark, path, "id", between=(100, 180))
    assert found.count() == sum(k is not None and 100 <= k <= 180 for k, *_ in rows) and len(found.inputFiles()) == 1
    wide = stored.lookup(spark, path, "id", between=(0, 39_999))
    assert wide.count() == sum(k is not None for k, *_ in rows)
    some = stored.lookup(spark, path, "id", among=[5, 39_000])
    assert some.count() == sum(k in (5, 39_000) for k, *_ in rows) and len(some.inputFiles()) == 2


def test_bloom_filters_answer_for_other_columns(spark, load):
    """No row group's range leaves this name out; only its filter does."""
    path, rows = load
    name = rows[500][2]
    found = spark.read.parquet(f"{path}/rows").where(F.col("name") == name).select("n")
    assert [r.n for r in found.collect()] == [n for _, n, x, _ in rows if x == name] and scanned(found) < 40_000
    assert scanned(spark.read.parquet(f"{path}/rows").where(F.col("name") == "name-no").select("n")) < 20_000


FAMILY = Family(
    "f",
    {"n": Lifetime("count"), "s": Lifetime("sum", "value"), "top": Lifetime("max", "value"), "a": Lifetime("avg", "value"), "recent": PrependList("k", 3), "days": BitmapActivity("day", 5)},
    {"user": "id"},
)
KEYS = ["id"]


def events(spark, rows):
    df = spark.createDataFrame(rows, "user long, event_id long, ds string, value long, k string")
    return df.withColumn("event_timestamp", F.to_timestamp("ds"))


def some(rng, n):
    return [(rng.randrange(12) or None, i, f"2024-01-{rng.randrange(1, 21):02d}", rng.randrange(100), rng.choice("abc")) for i in range(n)]


def same(a, b):
    return sorted(map(str, a.select("id", "ds", *FAMILY.columns).collect())) == sorted(map(str, b.select("id", "ds", *FAMILY.columns).collect()))


@pytest.mark.parametrize("snapshot", [None, "2024-01-04", "2024-01-09"])
def test_cascade_equals_a_rebuild(spark, tmp_path, snapshot):
    rng, path = random.Random(2), str(tmp_path)
    rows = some(rng, 300)
    right = [(u, i, d, v * 3, k) for u, i, d, v, k in rows if not (d == "2024-01-11" or (u == 4 and d == "2024-01-12"))] + [(77, 10**6, "2024-01-12", 5, "z")]
    fresh_days = ("2024-01-10", "2024-01-12")
    mixed = [r for r in rows if not fresh_days[0] <= r[2] <= fresh_days[1]] + [r for r in right if fresh_days[0] <= r[2] <= fresh_days[1]]
    stored.store(entity.family_delta(events(spark, rows), FAMILY), FAMILY, KEYS, path)
    for day in ("2024-01-02", snapshot, "2024-01-15") if snapshot else ():
        stored.snapshot(spark, FAMILY, KEYS, path, day)
    fresh = entity.family_delta(events(spark, [r for r in right if fresh_days[0] <= r[2] <= fresh_days[1]]), FAMILY)
    written = stored.cascade(spark, FAMILY, KEYS, path, fresh, *fresh_days)
    want = entity.cumulate(entity.family_delta(events(spark, mixed), FAMILY), FAMILY, KEYS)
    assert same(stored.states(spark, path), want) and min(written) == fresh_days[0] and max(written) == "2024-01-20"
    assert stored._snapshots(spark, path) == (sorted({"2024-01-02", snapshot}) if snapshot else [])
    again = stored.cascade(spark, FAMILY, KEYS, path, fresh, *fresh_days)
    assert again == [] and same(stored.states(spark, path), want)


def test_a_cascade_reads_no_earlier_delta_and_ends_where_nothing_changes(spark, tmp_path):
    """A greatest value that is passed the next day: the correction is written on its own day alone, from a snapshot, with the deltas before it made wrong."""
    path = str(tmp_path)
    family = Family("f", {"top": Lifetime("max", "value")}, {"user": "id"})
    rows = [(1, d, f"2024-01-{d:02d}", 10 * d, "k") for d in range(1, 21)] + [(2, 50 + d, f"2024-01-{d:02d}", 7, "k") for d in range(1, 21, 3)]
    stored.store(entity.family_delta(events(spark, rows), family), family, KEYS, path)
    stored.snapshot(spark, family, KEYS, path, "2024-01-08")
    wrong = stored.deltas(spark, path).where("ds <= '2024-01-08'").withColumn("top__delta", F.lit(10**6).cast("long"))
    entity.overwrite_period(spark.createDataFrame(wrong.collect(), wrong.schema), f"{path}/deltas")
    stamp = {p: p.stat().st_mtime_ns for p in Path(path, "states").rglob("*.parquet")}
    fresh = entity.family_delta(events(spark, [(1, 12, "2024-01-12", 119, "k")]), family)
    assert stored.cascade(spark, family, KEYS, path, fresh, "2024-01-12", "2024-01-12") == ["2024-01-12"]
    left = {p for p in Path(path, "states").rglob("*.parquet") if stamp.get(p) == p.stat().st_mtime_ns}
    assert {p.parent.name for p in stamp} - {p.parent.name for p in left} == {"ds=2024-01-12"}
    got = {(r.id, r.ds): r.top for r in stored.states(spark, path).collect()}
    assert got[1, "2024-01-12"] == 119 and got[1, "2024-01-13"] == 130 and got[2, "2024-01-19"] == 7


def test_late_events_are_kept_and_counted_once(spark, tmp_path):
    path, t = str(tmp_path), 1_700_000_000
    batches = [[(1, t), (2, t + 100)], [(3, t + 95), (4, t + 500), (5, t + 20)], [(6, t + 300), (7, None), (8, t + 460)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, t long").select("id", F.timestamp_seconds("t").alias("at")).coalesce(1).write.parquet(f"{path}/log/{i}")
    stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/log/*")
    run = lambda: jobs.split_by_lateness(stream, "at", 50, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    run()
    for f in Path(path, "checkpoint/commits").iterdir():
        if f.name.strip(".").removesuffix(".crc") == "2":
            f.unlink()
    run()  # the last batch once more
    ids = {name: sorted(r.id for r in spark.read.parquet(f"{path}/out/{name}/*").collect()) for name in ("on_time", "late")}
    assert ids == {"on_time": [1, 2, 3, 4, 7, 8], "late": [5, 6]}
