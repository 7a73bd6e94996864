"""Fixed results, equalities inside Spark, and edge rows."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.states import BitmapActivity, Lifetime, PrependList
from tessella.operators import entity, layout, metrics, versions
from tessella.plans.spec import Family
from tessella.queries import QUERIES
from tessella.registered.base import COMMERCE, ENGAGEMENT, ev
from tessella.registered.families import SUMS
from tessella.sources import events as log

ID = ["entity_id"]


def test_two_loads(spark):
    a = spark.createDataFrame([(100, "US"), (200, "JP"), (300, "DE")], "user_id long, home_country string")
    b = spark.createDataFrame([(100, 500.0), (300, 80.0), (400, 20.0)], "user_id long, lifetime_revenue double")
    got = {tuple(r) for r in entity.stitch([a, b], ["user_id"]).collect()}
    assert got == {(100, "US", 500.0), (200, "JP", None), (300, "DE", 80.0), (400, None, 20.0)}
    assert {tuple(r) for r in entity.stitch_joined([a, b], ["user_id"]).collect()} == got


def test_write_path(spark):
    signups = spark.createDataFrame([("e1", "01:00", 100, "US"), ("e2", "02:00", 200, "JP"), ("e3", "03:00", 300, "DE"), ("e4", "04:00", 100, "CA")], "event_id string, event_timestamp string, user_id long, country string").withColumn("ds", F.lit("2026-04-09"))
    buys = spark.createDataFrame([("e10", "10:00", 100, 50.0), ("e11", "11:00", 100, 75.0), ("e12", "12:00", 300, 200.0), ("e13", "13:00", 400, 30.0)], "event_id string, event_timestamp string, actor_id long, amount double").withColumn("ds", F.lit("2026-04-09"))
    home = Family("home", {"home_country": Lifetime("last", "country")}, {"user_id": "user_id"})
    money = Family("money", {"revenue": Lifetime("sum", "amount"), "n": Lifetime("count")}, {"actor_id": "user_id"})
    parts = [entity.render(entity.cumulate(entity.family_delta(rows, f), f, ["user_id"]), f).select("user_id", *f.columns) for rows, f in ((signups, home), (buys, money))]
    got = {tuple(r) for r in entity.stitch(parts, ["user_id"]).collect()}
    assert got == {(100, "CA", 125.0, 2), (200, "JP", None, None), (300, "DE", 200.0, 1), (400, None, 30.0, 1)}


def test_ttl(spark):
    rows = spark.createDataFrame([("e", t) for t in (0, 50, 61, 100, 122)], "id string, t long")
    assert sorted(r.t for r in log.dedup_ttl(rows, ["id"], "t", 60).collect()) == [0, 61, 122]


def test_ttl_boundary_and_empty(spark):
    rows = spark.createDataFrame([("e", t) for t in (0, 60, 60, 61)], "id string, t long")
    assert sorted(r.t for r in log.dedup_ttl(rows, ["id"], "t", 60).collect()) == [0, 61]
    assert log.dedup_ttl(rows.limit(0), ["id"], "t", 60).count() == 0


def test_high_water(spark):
    rows = spark.createDataFrame([({"0": "100", "1": "50", "x": "7"},), ({"0": "200", "2": "10", "1": "junk"},)], "offsets map<string,string>")
    assert {tuple(r) for r in log.high_water(rows).collect()} == {(0, 200), (1, 50), (2, 10)}


def test_buckets(spark):
    def bucket(hashes, levels):
        return spark.range(1).select(layout.flat_bucket([F.lit(h).cast("long") for h in hashes], levels)).first()[0]

    assert bucket([42], [32]) == 10 and bucket([10, 2], [32, 4]) == 42 and bucket([None], [32]) == 0
    assert spark.range(1).select(layout.align(F.lit(42), [128], [32])).first()[0] == 10
    assert layout.bucket_levels(500 << 20, 1, 2) == [2, 2] and layout.bucket_levels(500 << 30, 1, 2) == [64, 64]
    assert layout.bucket_levels(1, 1, 1) == [1] and layout.bucket_levels(1 << 60, 1, 1) == [4096]


def days_of(df):
    return [r[0] for r in df.select("ds").distinct().orderBy("ds").limit(4).collect()]


@pytest.mark.parametrize("family", [SUMS, Family("l", {"ks": PrependList("k", 6), "m": Lifetime("count_distinct", "k")}, {"user_id": "entity_id"})])
def test_window_pass_equals_daily_merges(spark, sf_dir, family):
    rows = ev(spark, sf_dir).where("ds <= '2024-01-04'")
    # the window pass counts distinct values where the merges have their set
    keep = [F.round(c, 6).alias(c) if isinstance(s, Lifetime) else F.col(c) for c, s in family.columns.items()]
    state = None
    for d in days_of(rows):
        delta = entity.family_delta(rows.where(F.col("ds") == d), family, ())
        state = entity.seed(delta, family) if state is None else entity.merge(state.select("entity_id", *family.columns), delta, family, ID)
    whole = entity.as_of(entity.cumulate(entity.family_delta(rows, family), family, ID), ID, "2024-01-04")
    state, whole = (entity.render(x, family, "2024-01-04") for x in (state, whole))
    assert sorted(map(str, state.select("entity_id", *keep).collect())) == sorted(map(str, whole.select("entity_id", *keep).collect()))


def test_null_keys_merge_as_one(spark):
    f = Family("f", {"n": Lifetime("count")}, {"k": "k"})
    old = spark.createDataFrame([(None, 2), (1, 3)], "k int, n long")
    new = spark.createDataFrame([(None, 5), (2, 1)], "k int, n__delta long")
    assert {(r.k, r.n) for r in entity.merge(old, new, f, ["k"]).collect()} == {(None, 7), (1, 3), (2, 1)}


def test_bitmap_moves_out_of_its_window(spark):
    b = BitmapActivity("day", 5)
    got = spark.range(1).select(b.merge(F.lit("10011"), F.lit("00001"), F.lit(2)), b.merge(F.lit(None).cast("string"), F.lit("00001"), F.lit(1)), b.merge(F.lit("11111"), F.lit(None).cast("string"), F.lit(9))).first()
    assert tuple(got) == ("01101", "00001", "00000")


def test_empty_family_and_empty_day(spark, sf_dir):
    rows = ev(spark, sf_dir).limit(0)
    assert entity.cumulate(entity.family_delta(rows, COMMERCE), COMMERCE, ID).count() == 0
    assert entity.cumulate(entity.family_delta(rows, ENGAGEMENT), ENGAGEMENT, ID).count() == 0


def test_refusals():
    with pytest.raises(ValueError):
        Lifetime("mode", "x")
    with pytest.raises(ValueError):
        metrics.logs_joined()


def test_only_asked_families_are_read(spark, sf_dir, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, 2)], "k int, x int").write.parquet(a)
    spark.createDataFrame([(1, 3)], "k int, y int").write.parquet(b)
    loads = {"a": spark.read.parquet(a), "b": spark.read.parquet(b)}
    plan = entity.select_columns(loads, ["k"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_key_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.createDataFrame([(1, 2)], "k int, x int").write.parquet(path)
    df = spark.read.parquet(path)
    plan = entity.stitch(entity.only_keys([df, df.withColumnRenamed("x", "y")], "k", equals=1), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(k,1)") >= 2


def test_one_pass_equals_the_states_of_the_last_day(spark, sf_dir):
    rows = ev(spark, sf_dir).where("ds <= '2024-01-20'")
    for f in (COMMERCE, ENGAGEMENT):
        days = entity.render(entity.as_of(entity.cumulate(entity.family_delta(rows, f), f, ID), ID, "2024-01-20"), f, "2024-01-20")
        once = entity.render(entity.total(rows, f), f, "2024-01-20")
        keep = ["entity_id", *(F.round(c, 6).alias(c) if c == "spend" else F.col(c) for c in f.columns)]
        assert sorted(map(str, once.select(*keep).collect())) == sorted(map(str, days.select(*keep).collect()))


def test_ttl_keeps_whole_events_and_one_of_ties(spark):
    rows = [("a", 0, "x"), ("a", 0, "w"), ("a", 10, "y"), (None, 5, None), (None, 70, "z"), ("b", 3, "q")] + [("hot", t, str(t)) for t in range(0, 3000, 7)]
    df = spark.createDataFrame(rows, "id string, t long, row string").repartition(3)
    got = log.dedup_ttl(df, ["id"], "t", 60)
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], str(r[2]))):
        if r[0] not in last or r[1] - last[r[0]] > 60:
            last[r[0]] = r[1]
            want.append(r)
    assert got.columns == df.columns and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    timed = df.withColumn("t", F.timestamp_seconds("t"))
    assert log.dedup_ttl(timed, ["id"], "t", 60).count() == len(want)


def test_duplicate_keys_of_a_load_give_one_whole_row(spark):
    a = spark.createDataFrame([(1, 5, "old", 10), (1, 6, None, None), (2, 1, "b", 3)], "k int, v int, x string, y int")
    b = spark.createDataFrame([(1, 1, 7.0), (1, 2, 8.0)], "k int, v int, z double")
    assert {tuple(r) for r in entity.stitch([a, b], ["k"], order=["v"]).select("k", "x", "y", "z").collect()} == {(1, None, None, 8.0), (2, "b", 3, None)}
    with pytest.raises(ValueError):
        entity.stitch([a, b], ["k"])


def test_null_keys_of_joined_families_are_one_row(spark):
    a, b = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int"), spark.createDataFrame([(None, 3), (2, 4)], "k int, y int")
    want = {(None, 1, 3), (1, 2, None), (2, None, 4)}
    assert {tuple(r) for r in entity.stitch_joined([a, b], ["k"]).collect()} == want == {tuple(r) for r in entity.stitch([a, b], ["k"]).collect()}


def test_variance_of_values_far_from_zero(spark):
    rows = spark.createDataFrame([(1, f"2024-01-0{1 + i // 3}", 1e9 + i) for i in range(9)], "k int, ds string, x double")
    f = Family("f", {"v": Lifetime("variance", "x")}, {"k": "k"})
    deltas = entity.family_delta(rows, f)
    last = entity.as_of(entity.cumulate(deltas, f, ["k"]), ["k"], "2024-01-09")
    state = None
    for d in days_of(rows):
        delta = entity.family_delta(rows.where(F.col("ds") == d), f, ())
        state = entity.seed(delta, f) if state is None else entity.merge(state, delta, f, ["k"])
    for found in (last, state, entity.total(rows, f)):
        assert entity.render(found, f, "2024-01-09").first()["v"] == pytest.approx(7.5, rel=1e-9)


def test_states_do_not_mind_late_rows(spark):
    """Merged in any order of time, lists are in order and bitmaps whole."""
    f = Family("f", {"l": PrependList("v", 3), "h": BitmapActivity("hour", 30)}, {"k": "k"})
    rows = spark.createDataFrame([(1, i, h, str(h)) for i, h in enumerate((50, 3, 28, 51, 20, 22))], "k int, event_id int, h int, v string").withColumn("event_timestamp", F.timestamp_seconds(F.col("h") * 3600))
    state = None
    for i in (3, 1, 0, 5, 4, 2):
        delta = entity.family_delta(rows.where(F.col("event_id") == i), f, ())
        state = entity.seed(delta, f) if state is None else entity.merge(state, delta, f, ["k"])
    got = entity.render(state, f, "1970-01-03").first()
    assert got["l"] == ["51", "50", "28"] and got["h"] == "".join("1" if 42 + i in (50, 51) else "0" for i in range(30))
    assert entity.render(state, f, "1970-01-02").first()["h"] == "".join("1" if 18 + i in (22, 28) else "0" for i in range(30))


def test_only_named_loads_are_read(spark, tmp_path):
    path = str(tmp_path / "loads")
    data = spark.createDataFrame([(k, f"{c}-{d}", k * 10 + d) for k in range(4) for c in "ab" for d in range(5)], "k int, load_id string, x int").withColumn("y", F.col("x") + 1)
    versions.write_loads(data, path)
    at = spark.createDataFrame([("x", "a-1"), ("y", "b-3"), ("z", "b-4")], "column_name string, load_id string")
    back = versions.read_loads(spark.read.parquet(path), at, ["k"], ["x", "y"])
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in back.collect()} == {(k, k * 10 + 1, k * 10 + 4) for k in range(4)}
    assert "(load_id" in plan and plan.count("FileScan") == 2 and plan.count("PartitionFilters: [isnotnull(load_id") == 2
    assert [r.asDict() for r in versions.read_loads(spark.read.parquet(path), at.where("column_name = 'x'"), ["k"], ["x", "y"]).where("k = 1").collect()] == [{"k": 1, "x": 11, "y": None}]
    assert versions.read_loads(spark.read.parquet(path), at.limit(0), ["k"], ["x"]).count() == 0


def test_joins_of_bucketed_tables_have_no_shuffle(spark, sf_dir):
    for name in ("b5_co_partitioned", "b3_join_of_unlike_buckets"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("SortMergeJoin") :]
        assert "Exchange" not in below


def test_entry_works_without_the_optional_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tessella", tmp_path / "tessella", ignore=lambda d, names: [n for n in names if d.endswith("llm")])
    (tmp_path / "tessella" / "llm" / "__pycache__").mkdir(parents=True, exist_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(n.startswith('op') for n in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert said.stdout.split()[1:] == ["True", "False"], said.stderr[-500:]


def ttl(times, width):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] > width:
            kept.append(t)
    return kept


@pytest.mark.parametrize("parts", ["1", "7"])
def test_ttl_of_a_hot_key(spark, parts):
    """One key has most events and never pauses; its part of every task depends on the one before. No exchange is by the key alone."""
    import random

    rng = random.Random(6)
    rows = [("hot", rng.randrange(5000)) for _ in range(3000)] + [("same", 77)] * 500 + [(f"k{rng.randrange(40)}", rng.randrange(900)) for _ in range(400)] + [(None, t) for t in (1, 2, 90)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        for width in (3, 60, 4000):
            out = log.dedup_ttl(spark.createDataFrame(rows, "id string, t long"), ["id"], "t", width)
            got = {}
            for r in out.collect():
                got.setdefault(r.id, []).append(r.t)
            assert {k: sorted(v) for k, v in got.items()} == {k: ttl([t for i, t in rows if i == k], width) for k in {i for i, _ in rows}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_jumps_compose():
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        width = rng.randrange(1, 30)
        t = np.sort(np.array([rng.randrange(100) for _ in range(rng.randrange(1, 40))]))
        cut = rng.randrange(len(t) + 1)
        now = None
        for part in (t[:cut], t[cut:]):
            if len(part):
                now = log.after(*log.jumps(part, width), now, width)
        assert now == ttl(t.tolist(), width)[-1]
