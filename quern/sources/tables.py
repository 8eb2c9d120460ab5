"""Relations that the operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.runtime import table

DOCUMENT_COLUMNS = ["url", "title", "headings", "description", "body_text", "language", "content_hash", "last_modified", "crawled_at", "index_status"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: of repeated rows of an id the latest crawl counts as a whole (ties: the greatest status, modification, URL). The
    number of partitions is set, since what follows (tokens) is heavy for few bytes and would run in few tasks after coalescing;
    grouping reuses the partitioning. Bodies are shuffled once here; searches read the stored index instead."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("crawled_at", "index_status", "last_modified", "url")
    latest = F.max_by(F.struct(*DOCUMENT_COLUMNS), key).alias("r")
    return table(spark, d, "raw_documents").repartition(n, "id").groupBy("id").agg(latest).select("id", "r.*")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_queries")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """One row per feedback_id, the first to arrive; rating and category in lower case without outer spaces."""
    f = table(spark, d, "feedback").withColumns({"rating": F.lower(F.trim("rating")), "category": F.lower(F.trim("category"))})
    key = F.struct("received_at", "ts", "rating", "category", "result_count_bucket", "reason_code", "expires_at")
    return f.groupBy("feedback_id").agg(F.min(key).alias("r")).select("feedback_id", "r.*")


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgements without null grades, one per pair with its highest grade."""
    return table(spark, d, "qrels").filter("grade is not null").groupBy("query_id", "category", "split", "doc_id").agg(F.max("grade").alias("grade"))


def edges(spark: SparkSession, d: str, with_nofollow: bool = False) -> DataFrame:
    """(src, dst, anchor, n): normalised, valid, without self-links and, unless asked for, nofollow; repeated links counted, the first anchor kept."""
    e = table(spark, d, "link_edges")
    e = e.filter(urls.validate(F.col("src")).isNull() & urls.validate(F.col("dst")).isNull())
    if not with_nofollow:
        e = e.filter(~F.coalesce("is_nofollow", F.lit(False)))
    e = e.select(urls.normalise(F.col("src")).alias("src"), urls.normalise(F.col("dst")).alias("dst"), "anchor", "ord").filter("src != dst")
    return e.groupBy("src", "dst").agg(F.min_by("anchor", "ord").alias("anchor"), F.count("*").alias("n"))


def tokens(documents: DataFrame) -> DataFrame:
    """(id, field, position, term) of the four fields; positions count kept tokens."""
    fields = {"title": "title", "headings": "headings", "description": "description", "body": "body_text"}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in fields.items()])).alias("x")
    return documents.select("id", pairs).select("id", "x.field", F.posexplode(text.tokens(F.col("x.text"))).alias("position", "term"))
