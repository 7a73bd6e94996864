"""Event logs: scans, shaping to a declared schema, partitions, replay, retention."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.sources.shared import shared_dir

#: Declared types and the Spark types they are stored as.
TYPES = {"string": "string", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "boolean": "boolean", "timestamp": "timestamp", "date": "date", "json": "string"}
IMPLICIT = {"event_id": "string", "event_timestamp": "timestamp", "ds": "string", "hour": "string"}


def derive_partition(df: DataFrame, ingest_time: str) -> DataFrame:
    """ds and two-digit hour (UTC) from the time of ingestion, so that late events never touch old partitions."""
    t = F.col(ingest_time)
    return df.withColumns({"ds": F.date_format(t, "yyyy-MM-dd"), "hour": F.date_format(t, "HH")})


def scan_events(df: DataFrame, ds: str, hour: str | None = None) -> DataFrame:
    """One period of an event log; on partitioned files only its folders are read."""
    rows = df.where(F.col("ds") == ds)
    return rows if hour is None else rows.where(F.col("hour") == hour)


def parse_event_time(text: Column) -> Column:
    """RFC 3339 text to a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def coerce(value: Column, declared: str) -> Column:
    """A value as a declared type; null where it does not fit (a long beyond 32 bits, text that is no number)."""
    return value.try_cast(TYPES[declared])


def conform(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Implicit columns first, then the declared ones with their types; missing columns are null, undeclared ones go."""
    have = set(df.columns)
    implicit = [(F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in IMPLICIT.items()]
    user = [(coerce(F.col(c), t) if c in have else F.lit(None).cast(TYPES[t])).alias(c) for c, t in declared.items()]
    return df.select(*implicit, *user)


def decode_envelopes(df: DataFrame, payload: Mapping[str, str]) -> DataFrame:
    """JSON envelopes (column ``value``) to rows. Envelopes without table or event_id are dropped; payload fields that do not
    parse are null. Works on streams as well."""
    envelope = F.from_json("value", "table string, event_id string, event_timestamp string, payload string")
    body = F.from_json("e.payload", ", ".join(f"`{c}` string" for c in payload))
    rows = df.select(envelope.alias("e")).where("e.table is not null and e.event_id is not null").select("e.*", body.alias("p"))
    fields = [coerce(F.col(f"p.{c}"), t).alias(c) for c, t in payload.items()]
    return rows.select("table", "event_id", parse_event_time(F.col("event_timestamp")).alias("event_timestamp"), *fields)


def high_water(commits: DataFrame) -> DataFrame:
    """Greatest offset of each partition over all commit records (a column ``offsets``: map of partition to offset text)."""
    pairs = commits.select(F.explode("offsets").alias("p", "o")).select(F.expr("try_cast(p as int)").alias("partition"), F.expr("try_cast(o as bigint)").alias("offset"))
    return pairs.where("partition is not null and offset is not null").groupBy("partition").agg(F.max("offset").alias("hwm"))


def replay_after(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows past their partition's mark; all rows of a partition without one."""
    return df.join(marks, "partition", "left").where(F.col("offset") > F.coalesce("hwm", F.lit(-1))).drop("hwm")


def apply_retention(df: DataFrame, days: int, as_of: str) -> DataFrame:
    """Without the partitions older than the retention."""
    return df.where(F.col("ds") >= F.date_format(F.date_sub(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd"))


def preview(df: DataFrame, order: list[str], max_rows: int = 10_000, sample: int = 20) -> DataFrame:
    """The first rows of a result, with a flag that says whether there are more, and one for the rows of the sample (the first ones)."""
    head = df.orderBy(*order).limit(max_rows + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    numbered = head.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy()), "__r": rank}).where(F.col("__r") <= max_rows)
    return numbered.withColumns({"truncated": F.col("__n") > max_rows, "sampled": F.col("__r") <= sample}).drop("__n", "__r")


def ingest_marks(ingested: DataFrame, part: str, order: list[str]) -> DataFrame:
    """How far an ingested table has come in each part of its log: the greatest position (a struct of the order's columns)."""
    return ingested.groupBy(part).agg(F.max(F.struct(*order)).alias("mark"))


def rows_after(rows: DataFrame, marks: DataFrame, part: str, order: list[str]) -> DataFrame:
    """The rows of a log that an ingested table lacks: those past the mark of their part, and all of a part without one. Marks are one
    row a part, so they are joined to the log without a shuffle of it wherever Spark finds them small."""
    at = marks.withColumnRenamed(part, "__part")
    return rows.join(at, F.col(part).eqNullSafe(F.col("__part")), "left").where(F.col("mark").isNull() | (F.struct(*order) > F.col("mark"))).drop("__part", "mark")


def ingest_lag(rows: DataFrame, marks: DataFrame, part: str, order: list[str], time: str) -> DataFrame:
    """For each part with rows past its mark: how many, and how many seconds of time they span."""
    late = rows_after(rows, marks, part, order)
    span = F.unix_seconds(F.max(time).cast("timestamp")) - F.unix_seconds(F.min(time).cast("timestamp"))
    return late.groupBy(part).agg(F.count(F.lit(1)).alias("rows_behind"), span.alias("seconds"))


# --- duplicates, lateness, health ----------------------------------------------------------------------------------------


def dedup_ttl(df: DataFrame, key: list[str], time: str, seconds: int) -> DataFrame:
    """The events (whole rows) that are accepted: those without an accepted event of their key up to ``seconds`` before them. ``time`` is a
    number of seconds or a timestamp; events without one are dropped. Of events of one key and time the first
    counts, by its JSON text's first 64 characters and then a hash of it. A null key is a key like any other.

    Events are dealt out by ranges of key and time, so a hot key is shared by as many tasks as it fills, and each is read through in order
    with the last accepted time at hand. What a task must know is that time as its first event comes. The part of a key that begins in an
    earlier task is a function from the last accepted time on entry to that on exit, a table of jumps; the tables of a key are put
    together in order, and one time a task comes to the driver. A table has an entry for each change of the exit among the events of the first
    window at most: 16 bytes each, while rows stay where they are.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kind = dict(df.dtypes)[time]
    clock, width = (F.unix_micros(F.col(time).cast("timestamp")), seconds * 1_000_000) if kind.startswith("timestamp") else (F.col(time).cast("long"), seconds)
    text = F.to_json(F.struct(*df.columns))
    rows = df.select(F.to_json(F.struct(*key)).alias("g"), clock.alias("t"), F.struct(*df.columns).alias("row"), F.left(text, F.lit(64)).alias("a"), F.xxhash64(text).alias("b")).where("t is not null")
    order = ["g", "t", "a", "b"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "t", "row").checkpoint()

    def tables(batches):
        """Of the first and the last key of a partition: its jumps, or, where it begins there, the last accepted time alone."""
        first, first_t, last, last_t = None, [], None, []
        for batch in batches:
            t = batch.column(1).to_numpy(zero_copy_only=False)
            for g, at, end in _key_runs(batch.column(0)):
                first = g if first is None else first
                if g == first:
                    first_t.append(t[at:end])
                if g != last:
                    last, last_t = g, []
                last_t.append(t[at:end])
        part = TaskContext.get().partitionId()
        if first is not None:
            yield _jump_row(part, first, True, *jumps(np.concatenate(first_t), width))
            if last != first:
                exits = jumps(np.concatenate(last_t), width)[1]
                yield _jump_row(part, last, False, exits[:0], exits[:1])

    def walked(batches):
        key_now, now = None, None
        for batch in batches:
            for part, g, entered, ends, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key_now:
                    key_now, now = g, None
                if not entered:
                    now = exits[0]
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([now], pa.int64())], ["part", "entry"])
                now = after(np.array(ends), np.array(exits), now, width)

    found = dealt.select("g", "t").mapInArrow(tables, "part int, g string, entered boolean, ends array<long>, exits array<long>")
    entries = found.repartition("g").sortWithinPartitions("g", "part").mapInArrow(walked, "part int, entry long")
    entry = {r.part: r.entry for r in entries.collect() if r.entry is not None}  # one row a task

    def accept(batches):
        last, before, begun = entry.get(TaskContext.get().partitionId()), None, False
        for batch in batches:
            t, keep = batch.column(1).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            for g, at, end in _key_runs(batch.column(0)):
                if begun and g != before:
                    last = None
                before, begun = g, True
                while at < end:
                    if last is not None:
                        at += int(np.searchsorted(t[at:end], last + width, "right"))
                        if at >= end:
                            break
                    keep[at], last = True, t[at]
            yield batch.select(["row"]).filter(pa.array(keep))

    return dealt.mapInArrow(accept, StructType([StructField("row", dealt.schema["row"].dataType)])).select("row.*")


def _key_runs(keys: pa.Array) -> list[tuple[str, int, int]]:
    """(key, from, to) of the runs of equal keys of a batch."""
    codes = keys.dictionary_encode()
    at = codes.indices.to_numpy()
    edges = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)] if len(at) else np.zeros(1, int)
    return [(codes.dictionary[int(at[a])].as_py(), int(a), int(b)) for a, b in pairwise(edges)]


def jumps(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The last accepted time on exit from events at sorted times, by the time before which none can be accepted: ``exits[i]`` holds for the
    first ``ends`` beyond it. Nobody enters with more than one window to wait."""
    n = len(t)
    follow = np.searchsorted(t, t + width, "right")  # the next event that is accepted after each
    last = np.where(follow < n, follow, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    reach = min(n, int(np.searchsorted(t, t[0] + width, "right")) + 1)
    exits = t[last[:reach]]
    change = np.flatnonzero(np.r_[exits[1:] != exits[:-1], True])
    return t[change], exits[change]


def after(ends: np.ndarray, exits: np.ndarray, entry: int | None, width: int) -> int:
    """The last accepted time on exit, for the one on entry."""
    k = 0 if entry is None else int(np.searchsorted(ends, entry + width, "right"))
    return int(exits[k]) if k < len(exits) else entry


def _jump_row(part: int, g: str, entered: bool, ends: np.ndarray, exits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([g]), pa.array([entered]), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([exits.tolist()], pa.list_(pa.int64()))], ["part", "g", "entered", "ends", "exits"])


def dedup_exact(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def late_arrivals(df: DataFrame, event_time: str, ingest_time: str, seconds: int) -> DataFrame:
    """For each partition: events, how many came later than ``seconds`` after they happened, and the greatest lag."""
    lag = F.unix_seconds(F.col(ingest_time).cast("timestamp")) - F.unix_seconds(F.col(event_time).cast("timestamp"))
    return df.groupBy("ds", "hour").agg(F.count(F.lit(1)).alias("events"), F.count_if(lag > seconds).alias("late"), F.max(lag).alias("max_lag"))


def throughput(df: DataFrame, time: str, width: str) -> DataFrame:
    """Events in each window of time; on a stream as well."""
    return df.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "events")


def freshness(commits: DataFrame, since: str) -> DataFrame:
    """For each table: last commit, rows committed since a time, number of files."""
    return commits.groupBy("table_name").agg(F.max("committed_at").alias("last_commit"), F.coalesce(F.sum(F.when(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"), F.col("rows"))), F.lit(0)).alias("rows_since"), F.count_distinct("file").alias("files"))


def consumer_lag(ends: DataFrame, marks: DataFrame) -> DataFrame:
    """End offset less committed offset of each partition (ends: partition, end_offset)."""
    return ends.join(marks, "partition", "left").select("partition", "end_offset", (F.col("end_offset") - F.coalesce("hwm", F.lit(-1))).alias("lag"))


def sessionize(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of each entity: runs of events with no gap longer than ``gap``."""
    return df.groupBy(key, F.session_window(F.col(time).cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
