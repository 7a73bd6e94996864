"""Checks of entity tables and sources, and masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.events import IMPLICIT, coerce


def key_invariants(table: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, duplicate keys, and distinct keys of the source."""
    per = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    mine = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    return mine.crossJoin(source.select(*keys).distinct().agg(F.count(F.lit(1)).alias("source_keys")))


def totals_agree(table: DataFrame, source: DataFrame, mine: str, theirs: str, places: int = 4) -> DataFrame:
    """A total of the table and of its source, and whether they are equal."""
    both = table.agg(F.round(F.expr(mine), places).alias("table_total")).crossJoin(source.agg(F.round(F.expr(theirs), places).alias("source_total")))
    return both.withColumn("agree", F.col("table_total") == F.col("source_total"))


def size_violations(table: DataFrame, lists: Mapping[str, int], bitmaps: Mapping[str, int]) -> DataFrame:
    """For each list and bitmap column the rows that are too long, or not of the window's length."""
    return table.agg(*(F.count_if(F.size(c) > n).alias(c) for c, n in lists.items()), *(F.count_if(F.length(c) != n).alias(c) for c, n in bitmaps.items()))


def masked(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Sensitive columns by flag: pii is hashed, financial keeps its last four characters, phi and credentials are null."""

    def mask(c: str, flag: str):
        v = F.col(c).cast("string")
        if flag == "pii":
            return F.sha2(v, 256)
        if flag == "financial":
            return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(v) - 4, F.lit(0))), F.right(v, F.lit(4)))
        return F.lit(None).cast("string")

    return df.withColumns({c: mask(c, f) for c, f in flags.items()})


def schema_problems(columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """Reserved names, duplicate names and unmapped keys of a declared source."""
    out = [f"reserved: {c}" for c in columns if c in IMPLICIT]
    out += [f"duplicate: {c}" for c in sorted({c for c in columns if list(columns).count(c) > 1})]
    return out + [f"unmapped key: {k}" for k in keys if k not in columns]


def schema_contract(df: DataFrame, declared: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """A declared source against a table: for each declared column and each key its problem (reserved, duplicate, unmapped key; null if
    none) and, where the table has it, its nulls and the values that do not fit the declared type."""
    problems = {p.split(": ")[1]: p.split(": ")[0] for p in schema_problems(list(declared), keys)}
    have = {c: t for c, t in declared.items() if c in df.columns}
    quality = column_quality(df, have)
    missing = [c for c in [*declared, *keys] if c not in have]
    none = F.lit(None).cast("bigint")
    rest = [df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*map(F.lit, dict.fromkeys(missing)))).alias("column"), none.alias("nulls"), none.alias("misfits"))] if missing else []
    found = reduce(DataFrame.unionByName, rest, quality)
    named = F.create_map(*(F.lit(x) for pair in problems.items() for x in pair)) if problems else F.create_map().cast("map<string,string>")
    return found.withColumn("problem", F.try_element_at(named, F.col("column")))


def column_quality(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """For each declared column: nulls, and values that do not fit its type."""
    parts = []
    for c, t in declared.items():
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}_n"), F.count_if(F.col(c).isNotNull() & coerce(F.col(c), t).isNull()).alias(f"{c}_f")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("nulls"), F.col(f"{c}_f").alias("misfits")) for c in declared))
    return one.select("rows", F.inline(rows))


def unknown_keys(facts: DataFrame, entity: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Keys of the facts that the entity table lacks, with the rows that have them; null keys are no keys."""
    side = entity.select(*(F.col(e).alias(f) for f, e in on.items()))
    known = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in on))
    return facts.where(known).join(side, list(on), "left_anti").groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
