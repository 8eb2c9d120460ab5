"""Inverted index: postings, dictionary, document table, statistics, checks, quality, incremental and segmented forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.runtime import numbered
from quern.sources import tables

FIELDS = ("title", "headings", "description", "body")


def postings(documents: DataFrame) -> DataFrame:
    """(term, id, tf, tf_title, tf_headings, tf_description, tf_body, weighted): one row per term and document. Counts combine map-side."""
    t = tables.tokens(documents)
    counts = [F.count_if(F.col("field") == f).cast("int").alias(f"tf_{f}") for f in FIELDS]
    p = t.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), *counts)
    weighted = sum((F.col(f"tf_{f}") * F.lit(text.FIELD_WEIGHTS[f]) for f in FIELDS), F.lit(0.0))
    return p.withColumn("weighted", weighted)


def positions(documents: DataFrame) -> DataFrame:
    """(term, id, field, positions): ascending positions of each term in each field."""
    return tables.tokens(documents).groupBy("term", "id", "field").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def dictionary(p: DataFrame) -> DataFrame:
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def doc_meta(documents: DataFrame) -> DataFrame:
    """(id, url, title, language, len_*, total_terms): documents with at least one field that is not blank."""
    sizes = {f: F.size(text.tokens(F.col("body_text" if f == "body" else f))) for f in FIELDS}
    some = F.lit(False)
    for f in FIELDS:
        some = some | (F.trim(F.coalesce(F.col("body_text" if f == "body" else f), F.lit(""))) != "")
    m = documents.filter(some).select("id", "url", "title", "description", "language", "last_modified", "crawled_at", urls.host(F.col("url")).alias("host"), F.lower(urls.part(F.col("url"), 4)).alias("path"), *[s.alias(f"len_{f}") for f, s in sizes.items()])
    return m.withColumn("total_terms", sum((F.col(f"len_{f}") for f in FIELDS), F.lit(0)))


def stats(p: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: documents, vocabulary, postings and mean lengths. Means of fields divide by all documents."""
    d = meta.agg(F.count("*").alias("n_documents"), *[(F.sum(f"len_{f}") / F.count("*")).alias(f"avg_{f}") for f in FIELDS], (F.sum("total_terms") / F.count("*")).alias("avg_length"))
    v = p.agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n_postings"))
    return d.crossJoin(F.broadcast(v))  # both have one row


def checksum(p: DataFrame, meta: DataFrame, buckets: int = 64) -> DataFrame:
    """(n_documents, n_terms, checksum): SHA-256 over digests of hash buckets, so that no task gathers all ids or terms."""
    ids = meta.select(F.lit("d").alias("kind"), F.col("id").alias("entry"))
    terms = dictionary(p).select(F.lit("t").alias("kind"), F.concat("term", F.lit(":"), "df").alias("entry"))
    entries = ids.unionByName(terms).withColumn("h", F.sha2("entry", 256)).withColumn("bucket", F.substring("h", 1, 2))
    parts = entries.groupBy("kind", "bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "|"), 256).alias("digest"), F.count("*").alias("n"))
    return parts.agg(
        F.sum(F.when(F.col("kind") == "d", F.col("n")).otherwise(0)).alias("n_documents"), F.sum(F.when(F.col("kind") == "t", F.col("n")).otherwise(0)).alias("n_terms"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "bucket", "digest"))), "|"), 256).alias("checksum"))


def integrity(p: DataFrame, meta: DataFrame) -> DataFrame:
    """(check, n_issues) of the index: orphan postings, documents without terms, repeated documents, wrong counts."""
    orphans = p.join(meta.select("id"), "id", "left_anti").agg(F.lit("orphan_postings").alias("check"), F.count("*").alias("n_issues"))
    repeated = meta.groupBy("id").count().filter("count > 1").agg(F.lit("duplicate_documents").alias("check"), F.count("*").alias("n_issues"))
    silent = meta.join(p.select("id").distinct(), "id", "left_anti").agg(F.lit("documents_without_terms").alias("check"), F.count("*").alias("n_issues"))
    sums = p.groupBy("id").agg(F.sum("tf").alias("s")).join(meta.select("id", "total_terms"), "id").filter("s != total_terms").agg(F.lit("length_mismatch").alias("check"), F.count("*").alias("n_issues"))
    return orphans.unionByName(repeated).unionByName(silent).unionByName(sums)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(id, fingerprint, content_sha): the stored content hash, else SHA-256 of the lower-case collapsed fields; and the crawler's plain hash."""
    joined = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "headings", "description", "body_text")])
    plain = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "headings", "body_text")])
    own = F.sha2(F.trim(F.regexp_replace(F.lower(joined), r"[ \t\r\n\f]+", " ")), 256)
    return documents.select("id", F.coalesce(F.nullif(F.trim("content_hash"), F.lit("")), own).alias("fingerprint"), F.sha2(plain, 256).alias("content_sha"))


def quality(documents: DataFrame) -> DataFrame:
    """(id, n_words, score, is_duplicate, is_thin): a duplicate is a later id with the same normalised body."""
    body = F.coalesce("body_text", F.lit(""))
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(body, r"[ \t\r\n\f]+", " ")), " "), lambda w: w != ""))
    has = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1.0).otherwise(0.0)
    score = text.round_half_up(0.3 * has("title") + 0.15 * has("description") + 0.15 * has("headings") + 0.4 * F.least(F.lit(1.0), words / 50.0), 4)
    key = F.sha2(F.trim(F.regexp_replace(F.lower(body), r"[ \t\r\n\f]+", " ")), 256)
    q = documents.select("id", key.alias("key"), words.alias("n_words"), score.alias("score"), ((words < 10) & (has("title") == 0)).alias("is_thin"))
    # the first id of a body, aggregated before it is joined back: a hot body is no group in one task
    first = q.groupBy("key").agg(F.min("id").alias("first_id"))
    return q.join(first, "key").select("id", "n_words", "score", (F.col("id") != F.col("first_id")).alias("is_duplicate"), "is_thin")


def incremental(documents: DataFrame, active: DataFrame) -> DataFrame:
    """(id, action): pending, stale and not yet indexed documents against the active index's (id, fingerprint)."""
    due = documents.filter(F.col("index_status").isin("pending", "stale", "not_indexed"))
    new = fingerprints(due).select("id", "fingerprint")
    old = active.select("id", F.col("fingerprint").alias("old"))
    action = F.when(F.col("old").isNull(), "indexed").when(F.col("old") != F.col("fingerprint"), "updated").otherwise("skipped")
    return new.join(old, "id", "left").select("id", action.alias("action"))


def merge_segments(segments: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(segment_seq, id, term, tf) of the surviving documents: the latest segment of each document wins as a whole, tombstoned documents go
    (a tombstone counts for segments up to its own). Rows without an id belong to no document and go too. Segments are read once: the
    latest one is told by a window over a document's rows. They must not be a union of parts that are partitioned by id: Spark 4.1 takes such a union for partitioned by id as well,
    and still appends the parts once partitions are coalesced at run time."""
    dead = tombstones.groupBy("id").agg(F.max("segment_seq").alias("dead_seq"))
    latest = segments.filter("id is not null").withColumn("last_seq", F.max("segment_seq").over(W.partitionBy("id"))).filter("segment_seq = last_seq")
    alive = latest.join(dead, "id", "left").filter(F.col("dead_seq").isNull() | (F.col("dead_seq") < F.col("segment_seq")))
    return alive.select("segment_seq", "id", "term", "tf")


def block_max(p: DataFrame, block: int = 16) -> DataFrame:
    """(term, block, first_id, last_id, n, max_tf): skip blocks of a posting list in order of id. Positions are numbered by ranges, so that the
    list of a hot term is no window of one task."""
    r = numbered(p.select("term", "id", "tf"), "term", "id").withColumn("block", F.floor(F.col("number") / block).cast("int"))
    return r.groupBy("term", "block").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"), F.max("tf").alias("max_tf"))


def encode_gaps(gaps: Column) -> Column:
    """Bytes of numbers below 2**28: seven bits each, least first, the high bit on all but the last byte of a number."""
    def one(g: Column) -> Column:
        groups = F.when(g < 128, 1).when(g < 16384, 2).when(g < 2097152, 3).otherwise(4)
        byte = lambda i: F.lpad(F.hex((F.floor(g / F.pow(F.lit(128.0), i)) % 128 + F.when(i < groups - 1, 128).otherwise(0)).cast("bigint")), 2, "0")
        return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), byte), "")

    return F.unhex(F.array_join(F.transform(gaps, one), ""))


def decode_gaps(data: Column) -> Column:
    """The numbers that encode_gaps wrote."""
    text_ = F.hex(data)
    values = F.transform(F.sequence(F.lit(0), F.greatest(F.length(data) - 1, F.lit(0))), lambda i: F.conv(F.substring(text_, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"), F.lit(1).cast("bigint").alias("unit"))
    step = lambda acc, v: F.when(v >= 128, F.struct(acc["out"].alias("out"), (acc["sum"] + (v - 128) * acc["unit"]).alias("sum"), (acc["unit"] * 128).alias("unit"))).otherwise(
        F.struct(F.array_append(acc["out"], acc["sum"] + v * acc["unit"]).alias("out"), F.lit(0).cast("bigint").alias("sum"), F.lit(1).cast("bigint").alias("unit")))
    return F.when(F.length(data) > 0, F.aggregate(values, start, step)["out"]).otherwise(F.array().cast("array<bigint>"))


def retained_generations(builds: DataFrame, keep: int = 3, store: str | None = None) -> DataFrame:
    """builds with retained: of each store the active generation and the newest ready ones up to keep. builds has build_id, status, is_active,
    started_at, and the column store where there are several."""
    key = [store] if store else [F.lit(0)]
    order = F.row_number().over(W.partitionBy(*key).orderBy(F.col("is_active").desc(), F.coalesce(F.col("status") == "ready", F.lit(False)).desc(), F.col("started_at").desc_nulls_last(), "build_id"))
    return builds.withColumn("retained", (order <= keep) & (F.col("is_active") | (F.col("status") == "ready")))


def suggestions(words: DataFrame, prefixes: DataFrame, limit: int = 5) -> DataFrame:
    """(prefix, term, score, rank): the best terms (term, df) of every prefix."""
    weighted = words.filter(F.length("term") <= 64).select("term", F.greatest(F.lit(10.0), F.col("df") * 5.0).alias("weight"))
    p = prefixes.select(F.lower(F.trim("prefix")).alias("prefix")).filter("prefix != ''").distinct().withColumn("n", F.length("prefix"))
    sizes = [r.n for r in p.select("n").distinct().limit(65).collect() if r.n <= 64]
    parts = weighted.select("term", "weight", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("term", 1, n).alias("prefix")) for n in sizes] or [F.struct(F.lit(0).alias("n"), F.lit("").alias("prefix"))])).alias("x"))
    hits = parts.filter("length(term) >= x.n").select("term", "weight", "x.prefix").join(p, "prefix")
    score = F.col("weight") + 50 + F.when(F.col("term") == F.col("prefix"), 100).otherwise(0) + F.greatest(F.lit(0.0), 20 - 0.5 * F.length("term"))
    rank = F.row_number().over(W.partitionBy("prefix").orderBy(F.col("score").desc(), "term"))
    return hits.select("prefix", "term", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= limit)
