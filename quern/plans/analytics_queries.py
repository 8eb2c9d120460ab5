"""Queries on links, evaluation, feedback and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import evaluate, feedback, graph
from quern.plans import sqltext as S
from quern.plans.search_queries import _pagerank
from quern.runtime import materialise, site_of, table
from quern.sources import tables


def link_edges(spark, d):
    return tables.edges(spark, d).select("src", "dst", "n")


def graph_nodes(spark, d):
    return graph.nodes(tables.edges(spark, d))


def graph_summary(spark, d):
    return graph.summary(tables.edges(spark, d))


def pagerank_fixed(spark, d):
    r = graph.pagerank(tables.edges(spark, d), iterations=10)
    return r.select("url", text.round_half_up(F.col("score"), 8).alias("score"))


def pagerank_stats(spark, d):
    s = graph.score_stats(graph.pagerank(tables.edges(spark, d), iterations=10))
    return s.select("n", *[text.round_half_up(F.col(c), 8).alias(c) for c in ("min_score", "max_score", "mean_score", "median_score", "sum_score")])


def frontier(spark, d):
    links = table(spark, d, "link_edges").filter(urls.validate(F.col("dst")).isNull()).select(urls.normalise(F.col("dst")).alias("url"), "ord")
    return graph.frontier(links, tables.docs(spark, d).select(urls.normalise(F.col("url")).alias("url")).distinct())


def crawl_levels(spark, d):
    """Two levels of links (the depth is the crawl's parameter) from the records that wait to be crawled."""
    seeds = tables.docs(spark, d).filter("index_status = 'pending'").select(urls.normalise(F.col("url")).alias("url")).filter("url is not null")
    return graph.crawl_levels(seeds, materialise(tables.edges(spark, d).select("src", "dst")), 2)


def url_normalise(spark, d):
    u = table(spark, d, "link_edges").select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    return u.select("url", urls.normalise(F.col("url")).alias("normal"), urls.url_hash(F.col("url")).alias("url_hash"), urls.validate(F.col("url")).alias("rejected"))


def first_party(spark, d):
    e = table(spark, d, "link_edges").select(urls.registrable(urls.host(F.col("src"))).alias("src_domain"), urls.registrable(urls.host(F.col("dst"))).alias("dst_domain"))
    return e.groupBy("src_domain", (F.col("src_domain") == F.col("dst_domain")).alias("is_first_party")).agg(F.count("*").alias("n"))


def domain_rate(spark, d):
    """Records of each site in one-hour windows of crawled_at, beyond two rejected."""
    r = table(spark, d, "raw_documents").filter("crawled_at is not null").select(site_of(F.col("url")).alias("site"), "crawled_at")
    return feedback.rate_windows(r, "site", "crawled_at", 3600, 2)


def change_detection(spark, d):
    """Per record: number of crawls, days between first and last, whether the content differs between crawls."""
    r = table(spark, d, "raw_documents")
    sha = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "headings", "body_text")]), 256)
    return r.groupBy("id").agg(F.count("*").alias("n_rows"), F.count_distinct("crawled_at").alias("n_crawls"), (F.count_distinct(sha) > 1).alias("changed"))


def _run(spark, d, flavour=0):
    """A run over the judged pairs with scores from hashes: the candidate takes other digits."""
    h = F.sha2(F.concat_ws("/", "query_id", "doc_id"), 256)
    q = tables.qrels(spark, d).select("query_id", "doc_id").distinct()
    return q.select("query_id", "doc_id", F.conv(F.substring(h, 1 + flavour * 4, 4), 16, 10).cast("double").alias("score"))


def eval_queries(spark, d):
    return evaluate.evaluate(_run(spark, d), tables.qrels(spark, d), 10)


def eval_by_category(spark, d):
    return evaluate.by_category(evaluate.evaluate(_run(spark, d), tables.qrels(spark, d), 10))


def experiment_compare(spark, d):
    q = tables.qrels(spark, d)
    return evaluate.compare(evaluate.evaluate(_run(spark, d), q, 10), evaluate.evaluate(_run(spark, d, 1), q, 10))


def regression_gate(spark, d):
    return evaluate.gate(experiment_compare(spark, d))


def param_sweep(spark, d):
    """Mean nDCG of six cut-offs by two runs, ranked."""
    q = tables.qrels(spark, d)
    parts = [evaluate.evaluate(_run(spark, d, f), q, k).agg(F.lit(f).alias("run"), F.lit(k).alias("k"), text.round_half_up(F.avg("ndcg"), 4).alias("ndcg")) for f in (0, 1) for k in (1, 3, 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_validation(spark, d):
    r = table(spark, d, "qrels")
    known = table(spark, d, "search_queries").select("query_id").distinct().withColumn("known", F.lit(True))
    r = r.join(known, "query_id", "left")
    per = r.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("grade").alias("g"))
    return r.agg(F.count_if(F.col("grade").isNull()).alias("null_grades"), F.count_if(~F.coalesce(F.col("grade").between(0, 3), F.lit(True))).alias("bad_grades"), F.count_if(F.col("known").isNull()).alias("unknown_queries")).crossJoin(
        per.agg(F.count_if(F.col("n") > 1).alias("repeated_pairs"), F.count_if(F.col("g") > 1).alias("conflicting_pairs")))  # one row each


def feedback_stats(spark, d):
    return feedback.stats(tables.feedback(spark, d))


def feedback_live(spark, d):
    return feedback.live(tables.feedback(spark, d), F.lit("2025-05-01 00:00:00").cast("timestamp")).groupBy("rating").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def feedback_bursts(spark, d):
    return feedback.bursts(tables.feedback(spark, d))


def feedback_clusters(spark, d):
    f = tables.feedback(spark, d)
    return feedback.clusters(f, feedback.bursts(f))


def metrics_histogram(spark, d):
    return feedback.histogram(table(spark, d, "events").withColumn("v", F.col("value") / 10), ["event_type"], "v")


def latency_percentiles(spark, d):
    return feedback.latency(table(spark, d, "events"), "event_type", "value")


def rate_limit_windows(spark, d):
    return feedback.rate_windows(table(spark, d, "events"), "user_id", "ts", 3600, 1)


def jaccard_sentences(spark, d):
    """Similarity of a record's title and description by their tokens."""
    t = tables.docs(spark, d).select("id", F.array_distinct(text.tokens(F.col("title"))).alias("a"), F.array_distinct(text.tokens(F.col("description"))).alias("b"))
    return t.select("id", text.round_half_up(text.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def safe_search(spark, d):
    """Documents by level: explicit words in the text (strict), or the domain only (moderate)."""
    words = F.array(*[F.lit(w) for w in EXPLICIT])
    t = table(spark, d, "documents").select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-zA-Z0-9_-]+").alias("w"))
    return t.select("doc_id", F.arrays_overlap("w", words).alias("is_explicit")).filter("is_explicit")


# Explicit words.
EXPLICIT = "porn porno pornography xxx nsfw hentai erotic erotica sex explicit nudity nude hardcore gore adult".split()

QUERIES = {f.__name__: f for f in (link_edges, graph_nodes, graph_summary, pagerank_fixed, pagerank_stats, frontier, crawl_levels, url_normalise, first_party, domain_rate, change_detection, eval_queries, eval_by_category, experiment_compare,
                                   regression_gate, param_sweep, dataset_validation, feedback_stats, feedback_live, feedback_bursts, feedback_clusters, metrics_histogram, latency_percentiles, rate_limit_windows, jaccard_sentences, safe_search)}

REG = lambda h: (f"CASE WHEN regexp_matches({h}, '^[\\d.]+$') OR len(string_split({h}, '.')) <= 2 THEN {h} WHEN array_to_string(string_split({h}, '.')[-2:], '.') IN ({', '.join(map(S.q, urls.TWO_LABEL_SUFFIXES))})"  # noqa: E731
                 f" THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END")  # fmt: skip


def _eval_sql(name: str, flavour: int, k: int) -> str:
    score = f"('0x' || substr(sha256(query_id || '/' || doc_id), {1 + flavour * 4}, 4))::BIGINT"
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, max(category) AS category, max(split) AS split, max(grade) AS grade FROM qr GROUP BY query_id, doc_id)),
 {name}_h AS (SELECT *, sum(CASE WHEN grade >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM {name}_r WHERE rank <= {k}),
 {name}_d AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 1) AS found, min(rank) FILTER (grade >= 1) AS first, sum(CASE WHEN grade >= 1 THEN hits / rank ELSE 0 END) AS precisions FROM {name}_h GROUP BY query_id),
 {name}_o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM qr),
 {name}_i AS (SELECT query_id, max(category) AS category, max(split) AS split, sum(CASE WHEN place <= {k} THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade >= 1) AS relevant FROM {name}_o GROUP BY query_id),
 {name} AS (SELECT query_id, category, split, {S.r('dcg', 6)} AS dcg, {S.r('idcg', 6)} AS idcg, {S.r('CASE WHEN idcg > 0 THEN least(1.0, dcg / idcg) ELSE 0 END', 6)} AS ndcg, {S.r(f'found / {k}', 6)} AS precision,
  {S.r('CASE WHEN relevant > 0 THEN found / relevant ELSE 0 END', 6)} AS recall, {S.r('coalesce(1 / first, 0)', 6)} AS rr, {S.r(f'CASE WHEN relevant > 0 THEN precisions / least(relevant, {k}) ELSE 0 END', 6)} AS ap FROM {name}_i JOIN {name}_d USING (query_id))"""


MEANS = ", ".join(f"{S.r(f'avg({m})', 4)} AS {m}" for m in evaluate.METRICS)
COMPARE = " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, {S.r(f'avg(a.{m})', 4)} AS baseline, {S.r(f'avg(b.{m})', 4)} AS candidate, {S.r(f'avg(b.{m}) - avg(a.{m})', 4)} AS delta, {S.r(f'CASE WHEN avg(a.{m}) <> 0 THEN (avg(b.{m}) - avg(a.{m})) / avg(a.{m}) * 100 WHEN avg(b.{m}) > 0 THEN 100.0 ELSE 0.0 END', 2)} AS percent,
    count(*) FILTER (b.{m} - a.{m} > 0.001) AS wins, count(*) FILTER (b.{m} - a.{m} < -0.001) AS losses, count(*) FILTER (abs(b.{m} - a.{m}) <= 0.001) AS ties FROM e0 a JOIN e1 b USING (query_id)""" for m in evaluate.METRICS)  # fmt: skip
BOTH = f"WITH {S.QRELS}, {_eval_sql('e0', 0, 10)}, {_eval_sql('e1', 1, 10)}"
NEAR = "near AS (SELECT feedback_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 10000000 PRECEDING AND 10000000 FOLLOWING) AS n_near FROM fb WHERE ts IS NOT NULL), burst AS (SELECT *, CASE WHEN n_near > 5 THEN 0.1 ELSE 1.0 END AS strength FROM near)"
LE = feedback.BUCKETS

ORACLE = {
    "link_edges": f"WITH {S.EDGES} SELECT src, dst, n FROM edges",
    "graph_nodes": f"WITH {_pagerank(0)} SELECT url, in_degree, out_degree FROM nodes",
    "graph_summary": f"""WITH {_pagerank(0)}, t AS (SELECT count(*) AS n_nodes, sum(out_degree) AS n_edges, max(in_degree) AS max_in, max(out_degree) AS max_out, count(*) FILTER (out_degree = 0) AS n_dangling FROM nodes)
        SELECT *, {S.r('n_edges / n_nodes', 3)} AS avg_out, CASE WHEN n_nodes > 1 THEN {S.r('n_edges / (n_nodes * (n_nodes - 1.0))', 5)} ELSE 0.0 END AS density FROM t""",
    "pagerank_fixed": f"WITH {_pagerank(10)} SELECT url, {S.r('score', 8)} AS score FROM rank10",
    "pagerank_stats": f"WITH {_pagerank(10)} SELECT count(*) AS n, {S.r('min(score)', 8)} AS min_score, {S.r('max(score)', 8)} AS max_score, {S.r('avg(score)', 8)} AS mean_score, {S.r('median(score)', 8)} AS median_score, {S.r('sum(score)', 8)} AS sum_score FROM rank10",
    "frontier": f"WITH l AS (SELECT {S.norm_url('dst')} AS url, ord FROM link_edges WHERE {S.reject('dst')} IS NULL) SELECT url, min(ord) AS seq FROM l WHERE url NOT IN (SELECT {S.norm_url('url')} FROM raw_documents WHERE {S.norm_url('url')} IS NOT NULL) GROUP BY url",
    "crawl_levels": f"""WITH RECURSIVE {S.DOCS}, {S.EDGES}, lv AS (SELECT {S.norm_url('url')} AS url, 0 AS depth FROM docs WHERE index_status = 'pending' AND {S.norm_url('url')} IS NOT NULL UNION SELECT e.dst, depth + 1 FROM lv JOIN edges e ON e.src = lv.url WHERE depth < 2)
        SELECT url, min(depth) AS depth FROM lv GROUP BY url""",
    "url_normalise": f"WITH u AS (SELECT src AS url FROM link_edges UNION SELECT dst FROM link_edges) SELECT url, {S.norm_url('url')} AS normal, sha256({S.norm_url('url')}) AS url_hash, {S.reject('url')} AS rejected FROM u",
    "first_party": f"WITH e AS (SELECT {REG(S.host('src'))} AS src_domain, {REG(S.host('dst'))} AS dst_domain FROM link_edges) SELECT src_domain, src_domain = dst_domain AS is_first_party, count(*) AS n FROM e GROUP BY ALL",
    "domain_rate": f"SELECT {S.SITE('url')} AS site, (floor(epoch(crawled_at) / 3600) * 3600)::BIGINT AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS n_rejected FROM raw_documents WHERE crawled_at IS NOT NULL GROUP BY 1, 2",
    "change_detection": "SELECT id, count(*) AS n_rows, count(DISTINCT crawled_at) AS n_crawls, count(DISTINCT sha256(coalesce(title, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(headings, '') || chr(10) || coalesce(body_text, ''))) > 1 AS changed FROM raw_documents GROUP BY id",
    "eval_queries": f"WITH {S.QRELS}, {_eval_sql('e0', 0, 10)} SELECT * FROM e0",
    "eval_by_category": f"WITH {S.QRELS}, {_eval_sql('e0', 0, 10)} SELECT category, count(*) AS n_queries, {MEANS} FROM e0 GROUP BY GROUPING SETS ((), (category))",
    "experiment_compare": f"{BOTH} {COMPARE}",
    "regression_gate": f"{BOTH}, c AS ({COMPARE}) SELECT metric, delta, CASE metric WHEN 'ndcg' THEN 0.01 WHEN 'precision' THEN 0.03 ELSE 0.02 END AS allowed, delta >= -CASE metric WHEN 'ndcg' THEN 0.01 WHEN 'precision' THEN 0.03 ELSE 0.02 END AS passes FROM c",
    "param_sweep": f"WITH {S.QRELS}, " + ", ".join(_eval_sql(f"s{f}{k}", f, k) for f in (0, 1) for k in (1, 3, 5)) + " " + " UNION ALL ".join(f"SELECT {f} AS run, {k} AS k, {S.r('avg(ndcg)', 4)} AS ndcg FROM s{f}{k}" for f in (0, 1) for k in (1, 3, 5)),
    "dataset_validation": """SELECT count(*) FILTER (grade IS NULL) AS null_grades, count(*) FILTER (grade NOT BETWEEN 0 AND 3) AS bad_grades, count(*) FILTER (query_id NOT IN (SELECT query_id FROM search_queries)) AS unknown_queries,
        (SELECT count(*) FROM (SELECT 1 FROM qrels GROUP BY query_id, doc_id HAVING count(*) > 1)) AS repeated_pairs, (SELECT count(*) FROM (SELECT 1 FROM qrels GROUP BY query_id, doc_id HAVING count(DISTINCT grade) > 1)) AS conflicting_pairs FROM qrels""",
    "feedback_stats": f"WITH {S.FEEDBACK} SELECT 'rating' AS dimension, rating AS value, count(*) AS n FROM fb GROUP BY rating UNION ALL SELECT 'category', category, count(*) FROM fb GROUP BY category UNION ALL SELECT 'bucket', result_count_bucket, count(*) FROM fb GROUP BY result_count_bucket",
    "feedback_live": f"WITH {S.FEEDBACK} SELECT rating, count(*) AS n, min(ts) AS first, max(ts) AS last FROM fb WHERE expires_at IS NULL OR expires_at > TIMESTAMPTZ '2025-05-01 00:00:00+00' GROUP BY rating",
    "feedback_bursts": f"WITH {S.FEEDBACK}, {NEAR} SELECT * FROM burst",
    "feedback_clusters": f"""WITH {S.FEEDBACK}, {NEAR} SELECT coalesce(category, 'none') || '/' || coalesce(result_count_bucket, 'none') || '/' || coalesce(reason_code, 'none') AS cluster_key, count(*) AS votes, count(*) FILTER (rating = 'helpful') AS helpful,
        count(*) FILTER (rating = 'not_helpful') AS not_helpful, {S.r('avg(coalesce(strength, 1.0))', 2)} AS mean_strength FROM fb LEFT JOIN burst USING (feedback_id) GROUP BY 1""",
    "metrics_histogram": "WITH h AS (SELECT event_type, value / 10 AS v FROM events) " + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (v <= {b}) AS cumulative, count(v) AS total, {S.r('sum(v)', 3)} AS sum_value FROM h GROUP BY event_type" for b in LE)
    + f" UNION ALL SELECT event_type, '+Inf', count(v), count(v), {S.r('sum(v)', 3)} FROM h GROUP BY event_type",
    "latency_percentiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean, stddev_pop(value) AS sd FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v) AS n, "
    + f"{S.r('mean', 3)} AS mean, {S.r('sd', 3)} AS stddev, " + ", ".join(f"v[floor({p} * (len(v) - 1))::INT + 1] AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM l",
    "rate_limit_windows": "SELECT user_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, count(*) AS n, greatest(count(*) - 1, 0) AS n_rejected FROM events GROUP BY 1, 2",
    "jaccard_sentences": f"""WITH {S.DOCS}, {S.TOKENS}, a AS (SELECT DISTINCT id, term FROM tokens WHERE field = 'title'), b AS (SELECT DISTINCT id, term FROM tokens WHERE field = 'description'),
        c AS (SELECT id, (SELECT count(*) FROM a WHERE a.id = d.id) AS na, (SELECT count(*) FROM b WHERE b.id = d.id) AS nb, (SELECT count(*) FROM a JOIN b USING (id, term) WHERE a.id = d.id) AS nab FROM docs d)
        SELECT id, CASE WHEN na + nb - nab = 0 THEN 0.0 ELSE {S.r('nab / (na + nb - nab)', 6)} END AS similarity FROM c""",
    "safe_search": f"SELECT doc_id, true AS is_explicit FROM documents WHERE list_has_any(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9_-]+'), [{', '.join(map(S.q, EXPLICIT))}])",
}
