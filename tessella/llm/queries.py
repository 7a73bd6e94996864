"""The registered queries of the training-data operators, one opN_<name> each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat_format, collocations, decontam, hard_negatives, language, lm_scoring, neighbour_votes, packing, projection_forest, quality_rules, simhash, substrings, url_filters
from tessella.llm.common import read_table


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, _tokenizer_path())


#: The host and path rules of the URL query.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    target = read_table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.scored(docs, lm_scoring.fit(docs, target))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, sf_dir, "documents"))


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op3_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = neighbour_votes.scored(docs, neighbour_votes.fit(docs, labels))
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.predicted(docs, language.fit(docs.where(_fold(4) != 2)))
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(read_table(spark, sf_dir, "pages"), URL_RULES)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired(read_table(spark, sf_dir, "conversations"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_bytes(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.neighbours(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_rules": op2_quality_rules,
    "op3_neighbour_votes": op3_neighbour_votes,
    "op4_language": op4_language,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_chat_format": op7_chat_format,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op6_url_filters": url_filters.oracle_sql(URL_RULES),
}
