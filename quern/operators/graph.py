"""Link graph: degrees, summary, PageRank, crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text
from quern.runtime import materialise


def nodes(edges: DataFrame) -> DataFrame:
    """(url, in_degree, out_degree): distinct partners."""
    ends = edges.select(F.col("src").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("url").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def cap_out_edges(edges: DataFrame, most: int = 500) -> DataFrame:
    """At most so many out-edges a node, in order of dst; a bound of the crawler, off where it isn't asked for."""
    return edges.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst"))).filter(F.col("r") <= most).drop("r")


def summary(edges: DataFrame) -> DataFrame:
    n = nodes(edges)
    out = n.agg(F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.max("in_degree").alias("max_in"), F.max("out_degree").alias("max_out"), F.count_if(F.col("out_degree") == 0).alias("n_dangling"))
    v, e = F.col("n_nodes"), F.col("n_edges")
    return out.withColumns({"avg_out": text.round_half_up(e / v, 3), "density": F.when(v > 1, text.round_half_up(e / (v * (v - 1.0)), 5)).otherwise(0.0)})


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 10, tolerance: float | None = None) -> DataFrame:
    """(url, score): power iteration with the mass of dangling nodes spread evenly. Stops after iterations, or when the scores change by
    less than tolerance in sum. The latest iterate is returned, whatever their number. Edges are partitioned once by source; contributions
    are combined before they are shuffled to their targets, so that a target with very many links is no hot key."""
    e = materialise(edges.select("src", "dst").repartition("src"))
    n = materialise(nodes(e).select("url", "out_degree"))
    total = n.count()
    if not total:
        return n.select("url", F.lit(0.0).alias("score"))
    ranks = n.withColumn("score", F.lit(1.0 / total))
    for i in range(iterations):
        lost = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("score"))), F.lit(0.0)).alias("lost")))  # one row
        share = ranks.filter("out_degree > 0").select(F.col("url").alias("src"), (F.col("score") / F.col("out_degree")).alias("share"))
        incoming = e.join(share, "src").groupBy(F.col("dst").alias("url")).agg(F.sum("share").alias("got"))
        new = (n.join(incoming, "url", "left").crossJoin(lost)
               .select("url", "out_degree", ((1 - damping) / total + damping * F.col("lost") / total + damping * F.coalesce("got", F.lit(0.0))).alias("score")))
        new = materialise(new)  # read twice in the next step
        if tolerance is not None:
            delta = new.join(ranks.select("url", F.col("score").alias("old")), "url").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            ranks = new
            if delta < tolerance:
                break
        ranks = new
    return ranks.select("url", "score")


def score_stats(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.sum("score").alias("sum_score"))


def frontier(candidates: DataFrame, seen: DataFrame, most: int | None = None) -> DataFrame:
    """(url, seq): first-in first-out queue of URLs never seen; candidates (url, ord). most cuts the queue, which is its capacity."""
    q = candidates.groupBy("url").agg(F.min("ord").alias("ord")).join(seen.select("url"), "url", "left_anti")
    q = q.withColumn("seq", F.row_number().over(W.orderBy("ord", "url"))) if most is not None else q.withColumn("seq", F.col("ord"))
    return (q.filter(F.col("seq") <= most) if most is not None else q).select("url", "seq")


def crawl_levels(seeds: DataFrame, edges: DataFrame, max_depth: int = 2) -> DataFrame:
    """(url, depth): breadth-first, each URL at its least depth; ends where nothing new is reached."""
    reached = seeds.select("url", F.lit(0).alias("depth")).distinct()
    border = reached
    for depth in range(1, max_depth + 1):
        step = border.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct().join(reached.select("url"), "url", "left_anti")
        border = materialise(step.select("url", F.lit(depth).alias("depth")))
        if border.isEmpty():
            break
        reached = reached.unionByName(border)
    return reached


def resolve_redirects(hops: DataFrame, most: int = 10) -> DataFrame:
    """(url, target, n_hops): follow (url, next) up to most times; a loop ends where the limit does."""
    r = hops.select("url", F.col("next").alias("target"), F.lit(1).alias("n_hops"))
    step = hops.select(F.col("url").alias("target"), F.col("next"))
    for _ in range(most - 1):
        r = r.join(step, "target", "left").select("url", F.coalesce("next", "target").alias("target"), (F.col("n_hops") + F.col("next").isNotNull().cast("int")).alias("n_hops"))
    return r
