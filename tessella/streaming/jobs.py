"""Streaming jobs: ingest into partitioned files, deduplication, routing, families kept up to date batch by batch."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessella.operators.entity import total
from tessella.plans.spec import Family
from tessella.sources.shared import remove


def event_stream(spark, folder: str, pattern: str, schema, per_batch: int | None = None, most_rows: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; a batch takes at most so many files, or at most so many rows: as many files as fit, going by
    the largest there is when the stream is set up (a file is never divided)."""
    if most_rows:
        per_batch = min(per_batch or most_rows, files_within(spark.read.schema(schema).option("pathGlobFilter", pattern).parquet(folder), most_rows))
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).parquet(folder)


def files_within(rows: DataFrame, most_rows: int) -> int:
    """How many files of a table have together at most so many rows, going by the largest; one at least."""
    largest = rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] or most_rows
    return max(1, most_rows // largest)


def write_lanes(rows: DataFrame, path: str, rows_of_file: int, files_of_batch: int, lanes: int) -> list[str]:
    """Writes a log in files of so many rows, dealt out to folders (``lane=``) a batch's files at a time, and gives the folders. All files are full but
    one, and so are all lanes' batches: streams of the lanes run side by side and have together as many batches as one stream would.

    Rows are numbered by the counts of the partitions before theirs, and many tasks write, each whole stretches of a lane's batches.
    """
    at = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33))
    sizes = sorted((r["__p"], r["count"]) for r in at.groupBy("__p").count().collect())
    if not sizes:
        return []
    *ends, whole = accumulate(n for _, n in sizes)
    starts = rows.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, [0, *ends], strict=True)], "__p long, __first long")
    batch = F.floor((F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1)) / (rows_of_file * files_of_batch))
    stretches = max(1, math.ceil(whole / (rows_of_file * files_of_batch * lanes * 50)))
    dealt = at.join(F.broadcast(starts), "__p").withColumn("__batch", batch).withColumn("lane", (F.col("__batch") % lanes).cast("int"))
    dealt = dealt.repartitionById(lanes * stretches, F.expr(f"int(__batch div {50 * lanes} * {lanes} + lane)")).select(*rows.columns, "lane")
    dealt.write.partitionBy("lane").option("maxRecordsPerFile", rows_of_file).parquet(path)
    return [f"{path}/lane={k}" for k in range(min(lanes, math.ceil(whole / (rows_of_file * files_of_batch))))]


def ingest(stream: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = ("ds", "hour"), every: str | None = None, max_rows: int | None = None, flush_files: int | None = None) -> StreamingQuery:
    """Appends batches to files by partition. The checkpoint makes every file count once, also after a restart.

    ``every``: a processing interval ("5 seconds"); None takes what is there and stops. ``max_rows``: rows of a file, at most. What is written
    out after so many rows is bounded where the stream is read: ``event_stream(most_rows=...)``, or the source's own limit of a batch.
    ``flush_files``: a batch is written out in flushes of so many whole files of the source, see ``_flushed``.
    """
    if flush_files:
        writer = _flushed(stream, path, partitions, max_rows, flush_files)
    else:
        writer = stream.writeStream.format("parquet").partitionBy(*partitions)
        if max_rows:
            writer = writer.option("maxRecordsPerFile", max_rows)
        writer = writer.option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _flushed(stream: DataFrame, path: str, partitions: Sequence[str], max_rows: int | None, files: int) -> DataStreamWriter:
    """Writes each batch of a stream in flushes of so many files, counted in order of their names: every flush has a folder (``flush=``) with one
    file (of each partition) of its own, which one task writes. So a batch may hold many flushes, which are written side by side and
    committed together, and a batch's fixed costs are not paid for each. A batch has a folder (``batch=``) that is written again if it is run
    again. If the source gives whole multiples of ``files`` a batch (``maxFilesPerTrigger``), all flushes but the last are full."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            names = sorted(batch.agg(F.collect_set("__file")).first()[0])  # no more than the source's files of a batch
            numbers = batch.sparkSession.createDataFrame([(f, k // files) for k, f in enumerate(names)], "__file string, flush int")
            tasks = max(1, min(math.ceil(len(names) / files), batch.sparkSession.sparkContext.defaultParallelism))
            rows = batch.join(F.broadcast(numbers), "__file").drop("__file").repartitionById(tasks, "flush")
            writer = rows.write.mode("overwrite").partitionBy("flush", *partitions)
            if max_rows:
                writer = writer.option("maxRecordsPerFile", max_rows)
            writer.parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return stream.withColumn("__file", F.input_file_name()).writeStream.foreachBatch(step)


def dedup_stream(stream: DataFrame, time: str, keys: Sequence[str], window: str) -> DataFrame:
    """Drops repeats of a key that come within the window; state goes as the watermark passes."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, window).dropDuplicatesWithinWatermark(list(keys))


def stream_family(stream: DataFrame, family: Family, path: str, checkpoint: str, fan: int = 8) -> StreamingQuery:
    """Keeps a family's states up to date under ``path``, in runs that are written once.

    A batch is aggregated and written as a run of its own, so it writes in proportion to the keys it touches. When a level has ``fan`` runs
    they are combined into one of the next level: a state is written again once a level, of which there are as many as the logarithm
    of the number of batches to the base ``fan``. After its runs a batch writes a log entry that names all that are live, and only what the
    newest entry names is read (``family_states``): a batch that has not ended does not show, and one that is run again after a failure
    finds its entry, or writes the same run again, so nothing counts twice. Runs and entries that the last but one entry does not name are
    removed. States merge in any order, so rows may come late.
    """
    keys = list(family.keys.values())

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        logged = _log(spark, path)
        if number in logged:
            return
        live = logged[max(logged)] if logged else []
        fresh = _name(0, number, number)
        total(batch, family).write.mode("overwrite").parquet(f"{path}/{fresh}")
        runs, level = [*live, fresh], 0
        while len(full := [r for r in runs if _level(r) == level]) >= fan:
            up = _name(level + 1, _batches(full[0])[0], _batches(full[-1])[1])
            combined(_runs(spark, path, full), family, keys).write.mode("overwrite").parquet(f"{path}/{up}")
            runs, level = [*(r for r in runs if r not in full), up], level + 1
        spark.createDataFrame([(sorted(runs, key=_batches),)], "runs array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/log/v={number}")
        for v in sorted(logged)[:-1]:
            for r in logged[v]:
                if r not in live and r not in runs:
                    remove(spark, f"{path}/{r}")
            remove(spark, f"{path}/log/v={v}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def combined(states: DataFrame, family: Family, keys: Sequence[str]) -> DataFrame:
    """One state for each key of the states of several runs, by the strategies' own rules."""
    return states.groupBy(*keys).agg(*(s.combine(F.col(n)).alias(n) for n, s in family.columns.items()))


def family_states(spark: SparkSession, path: str, family: Family) -> DataFrame:
    """The states that ``stream_family`` keeps under ``path``, as of the newest batch that has ended."""
    logged = _log(spark, path)
    return combined(_runs(spark, path, logged[max(logged)]), family, list(family.keys.values()))


def _name(level: int, first: int, last: int) -> str:
    return f"runs/{level}-{first}-{last}"


def _level(run: str) -> int:
    return int(run.split("/")[1].split("-")[0])


def _batches(run: str) -> tuple[int, int]:
    _, first, last = run.split("/")[1].split("-")
    return int(first), int(last)


def _log(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """The runs that the entries of the log name; there are three entries at most."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/v=*/_SUCCESS")
    ended = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(folder) or []
    names = [str(f.getPath().getParent().toString()) for f in ended]
    if not names:
        return {}
    rows = spark.read.schema("runs array<string>").json(names).select("runs", F.input_file_name().alias("at")).collect()
    return {int(r["at"].split("/v=")[-1].split("/")[0].replace("%3D", "=")): r["runs"] for r in rows}


def _runs(spark: SparkSession, path: str, runs: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/{r}" for r in runs))


def windows_on_time(stream: DataFrame, time: str, width: str, delay: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events in each window of time (and of keys), given out once the watermark has passed it. What comes later than ``delay`` is not in it:
    see ``split_by_lateness``."""
    at = F.col(time).cast("timestamp")
    rows = stream.withColumn("__at", at).withWatermark("__at", delay)
    return rows.groupBy(F.window("__at", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def sessions_on_time(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of each entity as ``sources.events.sessionize`` finds them, given out once nothing can prolong them."""
    rows = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", delay)
    return rows.groupBy(key, F.session_window("__at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def split_by_lateness(stream: DataFrame, time: str, seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream in two tables: under ``on_time`` what comes no later than ``seconds`` after the newest time of the batches before its
    own, under ``late`` the rest, so that late events are kept and counted. The newest time of each batch is written beside them, under
    the batch's number; a batch that is run again writes the same folders again."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        moved = F.unix_micros(F.col(time).cast("timestamp"))
        before = spark.read.schema("newest long").option("recursiveFileLookup", "true").json(f"{path}/newest") if number else None
        # a batch that was begun and not ended has left a mark, which is not among those before it
        seen = before.where(F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("long") < number).agg(F.max("newest")).first()[0] if number else None
        limit = None if seen is None else seen - seconds * 1_000_000
        late = F.lit(False) if limit is None else F.coalesce(moved < limit, F.lit(False))
        marked = batch.withColumn("__late", late)
        for name, rows in (("on_time", marked.where("not __late")), ("late", marked.where("__late"))):
            rows.drop("__late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.agg(F.max(moved).alias("newest")).coalesce(1).write.mode("overwrite").json(f"{path}/newest/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _TimeToLive(StatefulProcessor):
    """Of a key: the last accepted time, and the rows that wait for the watermark."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.waiting = handle.getListState("waiting", "t long, row string")

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            self.waiting.appendList(list(zip(batch["t"].tolist(), batch["row"].tolist(), strict=True)))
            self.handle.registerTimer(_milliseconds(int(batch["t"].min())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out = timerValues.getCurrentWatermarkInMs(), []
        rows = sorted(self.waiting.get())
        due = [r for r in rows if _milliseconds(r[0]) <= now]  # of these none comes any more
        last = before = self.last.get()[0] if self.last.exists() else None
        for t, row in due:
            if last is None or t - last > self.width:
                last = t
                out.append(row)
        if rest := rows[len(due) :]:
            self.waiting.put(rest)
            self.handle.registerTimer(_milliseconds(rest[0][0]))
        elif rows:
            self.waiting.clear()
        if last != before:
            self.last.update((last,))
        if last is not None and not rest:
            if _milliseconds(last + self.width) < now:  # its window is over
                self.last.clear()
            else:
                self.handle.registerTimer(_milliseconds(last + self.width) + 1)
        return iter([pd.DataFrame({"row": out})] if out else ())

    def close(self) -> None:
        pass


def _milliseconds(t: int) -> int:
    """A time in microseconds, rounded up: no later event of that millisecond comes once the watermark is there."""
    return -(-t // 1000)


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside this one for streams that keep state: in RocksDB, which states with timers need, and in no more partitions than twice
    the cores there are. A state has a store for each partition, as many as when it began, and every batch opens them all."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)))
    return own


def listing(spark: SparkSession) -> SparkSession:
    """A session beside this one for streams that take many files in a batch, and for tables of many folders: these are listed in as many tasks as
    there are cores, not in one for each file or folder."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


#: Times in a waiting row's text, to the microsecond.
STAMPS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def dedup_ttl_stream(stream: DataFrame, key: Sequence[str], time: str, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """``sources.events.dedup_ttl`` on a stream: an event passes if no accepted event of its key lies up to ``seconds`` before it.

    An event waits until the watermark (the newest time seen less ``delay``) has passed it, so events that come late by no more than
    ``delay`` take their place in order of time; later ones are dropped, as Spark does. Of a key there is kept the last accepted time, until
    its window is over, and what waits; both in the state store, with timers. Of events of one key and time one waits, the first in order
    of its JSON text. The session must keep states in RocksDB (``stateful``).
    """
    clock = F.col(time).cast("timestamp")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = stream.select(F.to_json(F.struct(*key)).alias("g"), F.unix_micros(clock).alias("t"), F.to_json(F.struct(*stream.columns), STAMPS).alias("row"), clock.alias("at"))
    ready = rows.where(F.col("t").isNotNull()).withWatermark("at", delay)
    once = ready.groupBy("g").transformWithStateInPandas(_TimeToLive(seconds * 1_000_000), "row string", "Append", "EventTime")
    return once.select(F.from_json("row", schema, STAMPS).alias("r")).select("r.*")
