"""Ranking quality: DCG family, precision, recall, reciprocal rank, average precision, comparison, sweep, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text

METRICS = ("ndcg", "precision", "recall", "rr", "ap")


def ranked(run: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank): best k by score, then id."""
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return run.select("query_id", "doc_id", order.alias("rank")).filter(F.col("rank") <= k)


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10, no_relevant: str = "zero", unjudged: str = "zero") -> DataFrame:
    """(query_id, category, split, dcg, idcg, ndcg, precision, recall, rr, ap): one row per judged query. The ideal ranking takes all judged
    documents; precision divides by k; a grade of 1 is relevant. unjudged documents count as grade 0 or are ignored (taken out before
    ranking); no_relevant sets recall to 0 or 1, or to NULL (ignore), where nothing is relevant."""
    if unjudged == "ignore":
        run = run.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    r = ranked(run, k).join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    gain = lambda g, rank: (F.pow(F.lit(2.0), g) - 1) / F.log2(rank + 1.0)
    hits = F.sum(F.when(F.col("g") >= 1, 1).otherwise(0)).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    r = r.withColumn("hits", hits)
    per = r.groupBy("query_id").agg(F.sum(gain(F.col("g"), F.col("rank"))).alias("dcg"), F.count_if(F.col("g") >= 1).alias("found"), F.min(F.when(F.col("g") >= 1, F.col("rank"))).alias("first"),
                                    F.sum(F.when(F.col("g") >= 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"))
    # the best k judgements of a query: counts per grade instead of a sorted list, since one query may hold a large share of all
    grades = qrels.groupBy("query_id", "category", "split", "grade").agg(F.count("*").alias("c"))
    order = W.partitionBy("query_id").orderBy(F.col("grade").desc())
    upto = F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))
    grades = grades.withColumn("upto", F.least(upto, F.lit(k))).withColumn("from", F.least(upto - F.col("c"), F.lit(k)))
    places = F.when(F.col("upto") > F.col("from"), F.sequence(F.col("from") + 1, F.col("upto"))).otherwise(F.array().cast("array<bigint>"))
    ideal = grades.withColumn("i", F.aggregate(places, F.lit(0.0), lambda a, p: a + 1 / F.log2(p + 1.0)) * (F.pow(F.lit(2.0), "grade") - 1))
    ideal = ideal.groupBy("query_id").agg(F.max("category").alias("category"), F.max("split").alias("split"), F.sum("i").alias("idcg"), F.sum(F.when(F.col("grade") >= 1, F.col("c")).otherwise(0)).alias("relevant"))
    e = ideal.join(per, "query_id", "left").fillna(0.0, ["dcg", "precisions"]).fillna(0, ["found"])
    none = {"zero": F.lit(0.0), "one": F.lit(1.0), "ignore": F.lit(None).cast("double")}[no_relevant]
    return e.select(
        "query_id", "category", "split", text.round_half_up(F.col("dcg"), 6).alias("dcg"), text.round_half_up(F.col("idcg"), 6).alias("idcg"),
        text.round_half_up(F.when(F.col("idcg") > 0, F.least(F.lit(1.0), F.col("dcg") / F.col("idcg"))).otherwise(0.0), 6).alias("ndcg"),
        text.round_half_up(F.col("found") / float(k), 6).alias("precision"),
        text.round_half_up(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(none), 6).alias("recall"),
        text.round_half_up(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        text.round_half_up(F.when(F.col("relevant") > 0, F.col("precisions") / F.least("relevant", F.lit(k))).otherwise(0.0), 6).alias("ap"))


def by_category(per_query: DataFrame) -> DataFrame:
    """(category, n_queries, means): every category and, as NULL, all queries."""
    means = [text.round_half_up(F.avg(m), 4).alias(m) for m in METRICS]
    return per_query.groupingSets([[], [F.col("category")]], "category").agg(F.count("*").alias("n_queries"), *means)


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta, percent, wins, losses, ties): a query is won or lost beyond 0.001."""
    joined = baseline.join(candidate.select("query_id", *[F.col(m).alias(f"c_{m}") for m in METRICS]), "query_id")
    long = joined.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("a"), F.col(f"c_{m}").alias("b")) for m in METRICS])).alias("x")).select("x.*")
    d = F.col("b") - F.col("a")
    out = long.groupBy("metric").agg(F.avg("a").alias("baseline"), F.avg("b").alias("candidate"), F.count_if(d > 0.001).alias("wins"), F.count_if(d < -0.001).alias("losses"), F.count_if(F.abs(d) <= 0.001).alias("ties"))
    delta = F.col("candidate") - F.col("baseline")
    percent = F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100).otherwise(F.when(F.col("candidate") > 0, 100.0).otherwise(0.0))
    r4 = lambda c: text.round_half_up(c, 4)
    return out.select("metric", r4(F.col("baseline")).alias("baseline"), r4(F.col("candidate")).alias("candidate"), r4(delta).alias("delta"), text.round_half_up(percent, 2).alias("percent"), "wins", "losses", "ties")


# Largest allowed drop of each metric's mean.
GATE = {"ndcg": 0.01, "rr": 0.02, "precision": 0.03, "recall": 0.02, "ap": 0.02}


def gate(comparison: DataFrame) -> DataFrame:
    """(metric, delta, allowed, passes)."""
    limits = F.create_map(*[F.lit(x) for p in GATE.items() for x in p])
    return comparison.select("metric", "delta", F.element_at(limits, F.col("metric")).alias("allowed")).withColumn("passes", F.col("delta") >= -F.col("allowed"))
