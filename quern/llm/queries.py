"""Registry of the queries p1_ to p10_ and of their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import abuse, bpe, cutoff, langid, liststuff, lookalike, neardup, packing, pageframe, sitelines
from quern.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.found(table(spark, d, "raw_documents"))


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.blocks(sitelines.line_rows(table(spark, d, "raw_documents")))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.cleaned(table(spark, d, "raw_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "raw_documents"), table(spark, d, "lang_samples"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(table(spark, d, "raw_documents"), table(spark, d, "lang_samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pageframe.found(table(spark, d, "raw_documents"), table(spark, d, "lang_samples"))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return pageframe.main_text(table(spark, d, "raw_documents"), table(spark, d, "lang_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return liststuff.found(table(spark, d, "raw_documents"), table(spark, d, "lang_samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "raw_documents"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_records(table(spark, d, "raw_documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "raw_documents"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "raw_documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.found(table(spark, d, "raw_documents"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.rates(table(spark, d, "raw_documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    capacities = [(r.capacity_id, r.capacity) for r in table(spark, d, "pack_capacities").collect()]
    return packing.pack(table(spark, d, "documents"), capacities)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(table(spark, d, "documents"), table(spark, d, "abuse_examples"), table(spark, d, "lang_samples"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "abuse_examples"), table(spark, d, "lang_samples")).select("doc_id", "score", "label")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "abuse_examples"), table(spark, d, "lang_samples"))


QUERIES = {"p1_found": p1_found, "p1_blocks": p1_blocks, "p1_cleaned": p1_cleaned, "p2_found": p2_found, "p2_languages": p2_languages, "p3_found": p3_found, "p3_main_text": p3_main_text, "p4_found": p4_found, "p5_found": p5_found, "p5_canonical": p5_canonical, "p6_found": p6_found, "p6_groups": p6_groups, "p7_found": p7_found, "p7_rates": p7_rates, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
ORACLE: dict[str, str] = {}
