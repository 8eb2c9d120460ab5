"""Feedback analytics and request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def stats(f: DataFrame) -> DataFrame:
    """(dimension, value, n): by rating, category and bucket of result counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("rating", "rating"), ("category", "category"), ("bucket", "result_count_bucket"))])).alias("x")
    return f.select(pairs).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def live(f: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Records that haven't expired; with most, the newest of them, which is the store's capacity."""
    alive = f.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return alive.orderBy(F.col("ts").desc_nulls_last(), "feedback_id").limit(most) if most is not None else alive


def bursts(f: DataFrame, seconds: int = 10, threshold: int = 5) -> DataFrame:
    """(feedback_id, n_near, strength): records within that many seconds either way, itself included; above the threshold the strength is
    0.1. The seconds are first counted in cells of the window's width, so that the range frame runs within neighbouring cells only."""
    micros = F.unix_micros("ts")
    width = seconds * 1_000_000
    cell = F.floor(micros / width)
    rows = f.filter("ts is not null").select("feedback_id", micros.alias("t"), cell.alias("cell"))
    spread = rows.select("feedback_id", "t", "cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("at"))
    near = F.count("*").over(W.partitionBy("at").orderBy("t").rangeBetween(-width, width))
    out = spread.withColumn("n_near", near).filter("at = cell").select("feedback_id", "n_near")
    return out.withColumn("strength", F.when(F.col("n_near") > threshold, 0.1).otherwise(1.0))


def clusters(f: DataFrame, burst: DataFrame) -> DataFrame:
    """(cluster_key, votes, helpful, not_helpful, mean_strength)."""
    key = F.concat_ws("/", *[F.coalesce(c, F.lit("none")) for c in ("category", "result_count_bucket", "reason_code")])
    j = f.select("feedback_id", "rating", key.alias("cluster_key")).join(burst.select("feedback_id", "strength"), "feedback_id", "left").fillna(1.0, ["strength"])
    return j.groupBy("cluster_key").agg(F.count("*").alias("votes"), F.count_if(F.col("rating") == "helpful").alias("helpful"), F.count_if(F.col("rating") == "not_helpful").alias("not_helpful"), text.round_half_up(F.avg("strength"), 2).alias("mean_strength"))


def histogram(values: DataFrame, labels: list[str], value: str, bounds: tuple = BUCKETS) -> DataFrame:
    """(labels, le, cumulative, total, sum_value): cumulative counts up to each bound and +Inf."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    h = values.groupBy(*labels).agg(*counts, F.count(value).alias("total"), F.sum(value).alias("sum_value"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cumulative")))
    return h.select(*labels, F.explode(rows).alias("x"), "total", text.round_half_up(F.col("sum_value"), 3).alias("sum_value")).select(*labels, "x.le", "x.cumulative", "total", "sum_value")


def latency(values: DataFrame, group: str, value: str, points: tuple = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(group, n, mean, stddev, p50...): nearest rank floor(p * (n - 1)). Ranks come from counts per distinct value, not from sorted lists."""
    c = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(group).orderBy(value)
    c = c.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy(group)))
    at = [F.min(F.when(F.col("upto") >= F.floor(p * (F.col("n") - 1)) + 1, F.col(value))).alias(f"p{int(p * 100)}") for p in points]
    mean = F.sum(F.col(value) * F.col("c")) / F.sum("c")
    var = F.sum(F.col(value) * F.col(value) * F.col("c")) / F.sum("c") - mean * mean
    return c.groupBy(group).agg(F.sum("c").alias("n"), text.round_half_up(mean, 3).alias("mean"), text.round_half_up(F.sqrt(F.greatest(var, F.lit(0.0))), 3).alias("stddev"), *at)


def rate_windows(events: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 1) -> DataFrame:
    """(key, window_start, n, n_rejected): tumbling windows; requests beyond limit of a window are rejected."""
    start = (F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds).cast("bigint")
    return events.groupBy(key, start.alias("window_start")).agg(F.count("*").alias("n")).withColumn("n_rejected", F.greatest(F.col("n") - limit, F.lit(0)))
