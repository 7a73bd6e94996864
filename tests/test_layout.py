"""Bucketed tables: calls that follow or meet each other, sessions over one warehouse."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import layout
from tessella.queries import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

NAMES = ["b5_co_partitioned", "b2_bucketed_lookup", "b3_join_of_unlike_buckets", "b1_sized_buckets"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_results_outlive_later_calls(spark, sf_dir):
    """All are built before any is read, twice; none destroys the files of another."""
    built = [(n, QUERIES[n](spark, sf_dir)) for n in NAMES + NAMES[::-1]]
    got = [(n, rows(df)) for n, df in built]
    first = dict(got[: len(NAMES)])
    assert all(r and r == first[n] for n, r in got)


def test_two_programs_over_one_warehouse(sf_dir, tmp_path):
    """A second program has the first one's files before it, but not its catalogue."""
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
    "spark.checkpoint.dir": {str(tmp_path / "shared")!r}, "spark.local.dir": {str(tmp_path / "local")!r}, "spark.sql.warehouse.dir": {str(tmp_path / "warehouse")!r}}}).getOrCreate()
from tessella.queries import QUERIES
print([QUERIES[n](spark, {sf_dir!r}).count() for n in {NAMES!r}])
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    said = [subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300) for _ in range(2)]
    assert all(s.returncode == 0 for s in said), said[-1].stderr[-2000:]
    assert said[0].stdout == said[1].stdout


def test_unlike_buckets_leave_the_session_as_it_is(spark, sf_dir):
    key = "spark.sql.bucketing.coalesceBucketsInJoin.enabled"
    before = spark.conf.get(key)
    plan = QUERIES["b3_join_of_unlike_buckets"](spark, sf_dir)
    assert spark.conf.get(key) == before
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange hashpartitioning(k" not in text


def test_bytes_of_a_table(spark):
    df = spark.range(10).select("id", F.lit("abc").alias("t"), F.lit(None).cast("string").alias("n"), F.array(F.lit(1)).alias("a"))
    assert layout.table_bytes(df) == 10 * (8 + 3 + len('{"a":[1]}'))
    assert layout.buckets_for(df) == 1 and layout.table_bytes(df.limit(0)) == 0


LARGER = {"b6_bucket_pruning": 1, "b3_join_of_unlike_buckets": 3, "b2_bucketed_lookup": 1, "b5_co_partitioned": 2}


@pytest.mark.parametrize("name", LARGER)
def test_buckets_grow_with_the_table(name, spark, sf_dir, duck, monkeypatch):
    """With a small target the same table has more buckets than the least number, each a task of its own, and the same result."""
    monkeypatch.setattr(layout, "TARGET_BYTES", 20_000)
    want = layout.buckets_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    made = []
    for f in ("save_bucketed", "write_load"):
        monkeypatch.setattr(layout, f, lambda *a, f=getattr(layout, f): (made.append(a[-2] if isinstance(a[-1], str) else a[-1][0]), f(*a)))
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert want >= 32 and made == {1: [want], 2: [want, want], 3: [want, want // 2]}[LARGER[name]] and got == duck_rows(duck, ORACLES[name])


def test_a_bucket_is_a_task_of_its_own(spark, tmp_path):
    rows = spark.range(5000).select("id", F.spark_partition_id().alias("p"))
    layout.write_load(rows, f"{tmp_path}/load", ["id"], [32])
    at = F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)
    tasks = [r.n for r in spark.read.parquet(f"{tmp_path}/load").groupBy(at).agg(F.count_distinct("_bucket").alias("n")).collect()]
    assert len(tasks) == 32 and set(tasks) == {1}
