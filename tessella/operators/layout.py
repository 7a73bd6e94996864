"""Physical layout that a user chooses: buckets by key, immutable loads, pruned and co-located reads."""

from __future__ import annotations

import atexit
import contextlib
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a bucket, and the most buckets of a table.
TARGET_BYTES, MOST_BUCKETS = 128 << 20, 4096


def bucket_levels(rows: int, width: int, n_keys: int) -> list[int]:
    """A power-of-two number of buckets for so many rows of so many bytes, shared out over up to three key columns."""
    want = max(1, math.ceil(rows * width / TARGET_BYTES))
    bits = min(MOST_BUCKETS, 1 << (want - 1).bit_length()).bit_length() - 1
    n = max(1, min(3, n_keys))
    each, more = divmod(bits, n)
    return [1 << (each + (k < more)) for k in range(n)]


def flat_bucket(hashes: Sequence[Column], levels: Sequence[int]) -> Column:
    """Mixed radix of the hashes, the first key most significant; a null key hashes to 0."""
    digits = [F.pmod(F.coalesce(h, F.lit(0)), F.lit(n)) for h, n in zip(hashes, levels, strict=False)]
    return reduce(lambda a, x: a * x[1] + x[0], zip(digits[1:], levels[1:], strict=False), digits[0]).cast("long")


def bucket_id(keys: Sequence[str], levels: Sequence[int]) -> Column:
    return flat_bucket([F.when(F.col(k).isNotNull(), F.xxhash64(k)) for k in keys], levels)


def align(bucket: Column, fine: Sequence[int], coarse: Sequence[int]) -> Column:
    """The coarse bucket that holds a fine one, digit by digit."""
    rest, digits = bucket, []
    for n in reversed(fine):
        digits.insert(0, F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n)
    return flat_bucket(digits, coarse)


def bucket_stats(df: DataFrame, bucket: Column, target: int) -> DataFrame:
    """Rows of the buckets: least, greatest, median and 95th percentile, and how many hold over twice the target."""
    n = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("buckets"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.95).alias("p95"), F.count_if(F.col("n") > 2 * target).alias("oversized"))


def write_load(df: DataFrame, path: str, keys: Sequence[str], levels: Sequence[int]) -> None:
    """An immutable load: one folder a bucket, rows sorted by key, so that files and row groups can be skipped. Each bucket is a task of its
    own: a hash of the bucket would put several in one. ``buckets_for`` has the levels with which tasks stay small as tables grow."""
    n = math.prod(levels)
    df.withColumn("_bucket", bucket_id(keys, levels)).repartitionById(n, F.col("_bucket").cast("int")).sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(path)


def read_load(spark, path: str, columns: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Columns of a load; with a bucket only its folder is read."""
    rows = spark.read.parquet(path)
    return (rows if bucket is None else rows.where(F.col("_bucket") == bucket)).select(*columns)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], n: int, path: str) -> None:
    """A table whose files, in a folder of its own, are dealt out by key; two such tables with the same number of buckets join without a
    shuffle. Rows are dealt out before they are written, so a bucket is one file and not one for each task. A table of that name must
    not exist: nothing is replaced under a reader. It is dropped from the catalogue when the program ends; its files stay where they are."""
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    atexit.register(_forget, df.sparkSession, table)


def _forget(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its catalogue with it
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")


#: Bytes of a value of the types that have a fixed width; any other is measured.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def table_bytes(df: DataFrame) -> int:
    """Bytes of the columns that a table has, not of the files it comes from: rows times the widths of its types, and the measured
    lengths of texts, binaries and nested values. One scan, of the columns without a fixed width."""
    fixed = sum(WIDTHS.get(kind, 16 if kind.startswith("decimal") else 0) for _, kind in df.dtypes)
    loose = [(c, kind) for c, kind in df.dtypes if kind not in WIDTHS and not kind.startswith("decimal")]
    length = [F.octet_length(F.col(f"`{c}`") if kind in ("string", "binary") else F.to_json(F.struct(F.col(f"`{c}`")))) for c, kind in loose]
    rows, text = df.agg(F.count(F.lit(1)), F.sum(reduce(lambda a, b: a + b, (F.coalesce(n, F.lit(0)).cast("long") for n in length), F.lit(0).cast("long")))).first()
    return rows * fixed + (text or 0)


def buckets_for(df: DataFrame, least: int = 1) -> int:
    """A power-of-two number of buckets of about TARGET_BYTES each, and no fewer than ``least``, itself such a number."""
    return max(least, math.prod(bucket_levels(table_bytes(df), 1, 1)))


def session_of_unlike_buckets(spark: SparkSession) -> SparkSession:
    """A session beside this one, over the same catalogue, that reads, of two bucketed tables that are joined, the one with more buckets
    in as many as the other has, where their numbers divide; else Spark shuffles one of them. This one's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own
