"""Hashes, colours, dates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.plans import sqltext as S
from quern.runtime import table
from quern.streaming import jobs


def hash_tools(spark, d):
    q = table(spark, d, "search_queries").filter("raw_query is not null")
    return q.select("query_id", F.md5("raw_query").alias("md5"), F.sha1("raw_query").alias("sha1"), F.sha2("raw_query", 256).alias("sha256"), F.replace(F.base64(F.encode("raw_query", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("base64"), F.lower(F.hex(F.encode("raw_query", "UTF-8"))).alias("hex"))


def colour_convert(spark, d):
    """Colours from the first six hex digits of record ids."""
    c = table(spark, d, "raw_documents").select(F.substring("id", 1, 6).alias("hex")).distinct()
    part = lambda i: F.conv(F.substring("hex", i, 2), 16, 10).cast("int")
    return c.select("hex", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def epoch_convert(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", seconds.alias("seconds"), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def stream_event_counts(spark, d):
    s = jobs.run_available(jobs.event_counts(jobs.read_stream(spark, d, "events")), "complete")
    return s.select("window_start", "event_type", "n", text.round_half_up(F.col("total"), 3).alias("total"))


def stream_dedup(spark, d):
    return jobs.run_available(jobs.first_feedback(jobs.read_stream(spark, d, "feedback")), "append").agg(F.count("*").alias("n"), F.count_distinct("feedback_id").alias("n_ids"))


QUERIES = {f.__name__: f for f in (hash_tools, colour_convert, epoch_convert, stream_event_counts, stream_dedup)}

ORACLE = {
    "hash_tools": "SELECT query_id, md5(raw_query) AS md5, sha1(raw_query) AS sha1, sha256(raw_query) AS sha256, base64(encode(raw_query)) AS base64, lower(hex(encode(raw_query))) AS hex FROM search_queries WHERE raw_query IS NOT NULL",
    "colour_convert": "WITH c AS (SELECT DISTINCT left(id, 6) AS hex FROM raw_documents) SELECT hex, ('0x' || substr(hex, 1, 2))::INT AS r, ('0x' || substr(hex, 3, 2))::INT AS g, ('0x' || substr(hex, 5, 2))::INT AS b FROM c",
    "epoch_convert": "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
    "stream_event_counts": f"SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, {S.r('sum(value)', 3)} AS total FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT count(DISTINCT feedback_id) AS n, count(DISTINCT feedback_id) AS n_ids FROM feedback",
}
