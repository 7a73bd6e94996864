"""The corpus pipeline: five operators of tessella.llm, one after the other, each on all that its predecessor kept.

Rows with a null doc_id and empty texts go through like any others, as each operator's own docstring says.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, quality_rules, queries, simhash, substrings
from tessella.llm.common import dropped, listed, read_table, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    return simhash.first_of_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has go out of the texts."""
    return substrings.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training windows; one row a piece."""
    return queries.packed(docs)


#: By folder of input, the tables that the stages so far have written on their way. They are removed when the next stage but the first
#: begins: its predecessor's result has been written by then, and nothing reads them any more.
_LEFT: dict[str, list[DataFrame]] = {}


def _tidy(stage, first: bool = False):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = [] if first else _LEFT.pop(sf_dir, [])
        read = docs.inputFiles() if left else []
        for table in left:
            if not any(table._cut_at.split(":")[-1] in file for file in read):  # not if docs has not been written and read again
                dropped(table)
        with listed() as tables:
            out = stage(spark, docs, sf_dir)
        _LEFT.setdefault(sf_dir, []).extend(tables)
        return out

    return run_stage


STAGES = [
    ("quality_rules", _tidy(quality, first=True)),
    ("simhash_near_dedup", _tidy(near_duplicates)),
    ("suffix_array_dedup", _tidy(repeated_substrings)),
    ("benchmark_decontamination", _tidy(benchmark_leaks)),
    ("packing", _tidy(packed)),
]

#: Hashes, sorted suffixes and token ids are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
