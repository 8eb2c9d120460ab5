"""Queries on stored collections, index generations and segments, the crawl's bookkeeping, review and evaluation helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import evaluate, feedback, graph, index, search, store
from quern.plans import sqltext as S
from quern.plans.analytics_queries import _run
from quern.plans.search_queries import FRESH, _pagerank, bm25_topk
from quern.runtime import ensure_checkpoint_dir, materialise, site_of, table
from quern.sources import tables


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rule(column, modulo):
    """A number below modulo for a string, the same in SQL."""
    return F.conv(F.substring(F.md5(column), 1, 6), 16, 10).cast("bigint") % modulo


# ---- collections


def jsonl_scan(spark, d):
    """Records written as JSON lines and read with a fixed schema; a bad line fails the read."""
    path = _folder(spark, "jsonl")
    tables.docs(spark, d).select("id", "url", "title", "language").write.json(path)
    return spark.read.schema("id string, url string, title string, language string").option("mode", "FAILFAST").json(path)


def collection_put(spark, d):
    """A stored collection after a batch is put: rows of the batch replace those of the same id."""
    base = tables.docs(spark, d).select("id", "title", F.lit(1).alias("version"))
    batch = base.filter(_rule(F.col("id"), 3) == 0).select("id", F.concat("title", F.lit("!")).alias("title"), F.lit(2).alias("version"))
    path = _folder(spark, "collection")
    base.join(batch.select("id"), "id", "left_anti").unionByName(batch).write.parquet(path)
    return spark.read.parquet(path).select("id", F.length("title").alias("n"), "version")


def point_lookup(spark, d):
    """Records by the ids that judgements name, and by the hash of the URLs that links lead to."""
    docs = tables.docs(spark, d).select("id", "url")
    by_id = docs.join(tables.qrels(spark, d).select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select("id", F.lit("id").alias("key"))
    hashes = table(spark, d, "link_edges").select(urls.url_hash(F.col("dst")).alias("h")).filter("h is not null").distinct()
    by_hash = docs.withColumn("h", urls.url_hash(F.col("url"))).join(hashes, "h", "left_semi").select("id", F.lit("url_hash").alias("key"))
    return by_id.unionByName(by_hash)


def backup_verify(spark, d):
    """Collections copied, and the copies compared by count and checksum."""
    out = None
    for name, key in (("raw_documents", "id"), ("link_edges", "ord"), ("feedback", "feedback_id"), ("qrels", "query_id")):
        path = _folder(spark, "backup")
        table(spark, d, name).write.parquet(path)
        mark = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).alias("mark"), F.count_distinct(key).alias("n_keys"))  # noqa: E731, B023
        a, b = mark(table(spark, d, name)), mark(spark.read.parquet(path))
        row = a.join(b, (a.n == b.n) & (a.mark.eqNullSafe(b.mark)), "left").select(F.lit(name).alias("collection"), a.n.alias("n"), a.n_keys.alias("n_keys"), b.n.isNotNull().alias("is_equal"))
        out = row if out is None else out.unionByName(row)
    return out


def migrations(spark, d):
    """Records brought from version 1 to 3 by the pending steps in order: language codes cut to two letters, then a host column."""
    v = tables.docs(spark, d).select("id", "url", "language", (_rule(F.col("id"), 3) + 1).cast("int").alias("version"))
    v = v.withColumn("language", F.when(F.col("version") < 2, F.lower(F.substring("language", 1, 2))).otherwise(F.col("language"))).withColumn("version", F.greatest("version", F.lit(2)))
    return v.select("id", "language", F.when(F.col("version") < 3, urls.host(F.col("url"))).alias("host"), F.greatest("version", F.lit(3)).alias("version"))


def generated_corpus(spark, d):
    """A synthetic corpus from a seed: as many documents as there are customers, words by hash, one for each content."""
    words = ["index", "query", "graph", "crawler", "ranking", "token", "segment", "posting"]
    n = table(spark, d, "customer").count()
    pick = lambda i: F.element_at(F.array(*[F.lit(w) for w in words]), (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit("7"), F.col("id").cast("string"), F.lit(str(i)))), 1, 6), 16, 10).cast("bigint") % 8 + 1).cast("int"))
    body = F.concat_ws(" ", *[pick(i) for i in range(4)])
    return spark.range(n).select("id", body.alias("body")).groupBy("body").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def report_export(spark, d):
    """Category means as lines of a Markdown table and as JSON."""
    c = evaluate.by_category(evaluate.evaluate(_run(spark, d), tables.qrels(spark, d), 10))
    mark = F.format_string("| %s | %.4f |", F.coalesce("category", F.lit("all")), F.col("ndcg"))
    return c.select(F.coalesce("category", F.lit("all")).alias("category"), mark.alias("markdown"), F.get_json_object(F.to_json(F.struct("category", "n_queries")), "$.n_queries").cast("bigint").alias("n_queries"))


# ---- index


def index_build_load(spark, d):
    """A generation built, published, loaded with its checksum verified, and the newest of the retained ones."""
    root = _folder(spark, "index")
    store.build(tables.docs(spark, d), root)
    ix = store.load(spark, root)
    store.recover(spark, root)
    return ix.dictionary.select("term", "df", "total_tf")


def segment_flush_read(spark, d):
    """Three flushed segments (by a rule on ids; the third replaces a part with titles only), compacted with tombstones and read."""
    docs, root = tables.docs(spark, d), _folder(spark, "segments")
    r = _rule(F.col("id"), 10)
    store.flush(docs.filter(r < 6), root, 1)
    store.flush(docs.filter(r >= 6), root, 2)
    store.flush(docs.filter(r == 2).withColumns({c: F.lit(None).cast("string") for c in ("headings", "description", "body_text")}), root, 3)
    dead = docs.filter(r == 9).select("id", F.lit(2).alias("segment_seq"))
    store.compact(spark, root, dead)
    return store.segments(spark, root).groupBy("id").agg(F.count("term").alias("n_terms"), F.sum("tf").alias("total_tf"))


def index_upsert(spark, d):
    """Document frequencies after a third of the documents were replaced by their titles and a tenth deleted."""
    docs = tables.docs(spark, d)
    changed = docs.filter(_rule(F.col("id"), 3) == 0).withColumns({c: F.lit(None).cast("string") for c in ("headings", "description", "body_text")})
    p = store.upsert(store.opened(spark, d).postings, changed)
    return index.dictionary(store.remove(p, docs.filter(_rule(F.col("id"), 10) == 7))).select("term", "df", "total_tf")


def index_document_actions(spark, d):
    """What indexing single documents does, where a fifth is known with another fingerprint and a fifth not at all."""
    docs = tables.docs(spark, d)
    r = _rule(F.col("id"), 5)
    active = index.fingerprints(docs).filter(r != 0).select("id", F.when(_rule(F.col("id"), 5) == 1, "older").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return store.index_actions(docs, active)


def index_health(spark, d):
    return store.health(store.opened(spark, d), tables.docs(spark, d))


def retained_generations(spark, d):
    """Builds of every host (its records as builds): the active one and the newest ready ones, three in all."""
    b = tables.docs(spark, d).select(site_of(F.col("url")).alias("site"), F.col("id").alias("build_id"), F.when(F.col("index_status") == "indexed", "ready").otherwise("failed").alias("status"), F.col("crawled_at").alias("started_at"))
    active = b.filter("status = 'ready'").groupBy("site").agg(F.min("build_id").alias("active"))
    b = b.join(active, "site", "left").withColumn("is_active", F.coalesce(F.col("build_id") == F.col("active"), F.lit(False)))
    return index.retained_generations(b, 3, "site").filter("retained").select("site", "build_id")


# ---- crawl


def page_processing(spark, d):
    """What a crawl of every record does: rejected, robots, not_modified (stored later than modified), unchanged or changed content (against
    the stored hash), with the status it gets."""
    docs = tables.docs(spark, d)
    sha = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "headings", "body_text")]), 256)
    outcome = (F.when(urls.validate(F.col("url")).isNotNull(), "rejected").when(_rule(F.col("id"), 17) == 0, "robots").when(F.col("last_modified") > F.col("crawled_at"), "not_modified")
               .when(F.col("content_hash") == sha, "unchanged").otherwise("changed"))
    p = docs.select("id", outcome.alias("outcome"), "index_status")
    return p.select("id", "outcome", F.when(F.col("outcome") == "changed", "pending").otherwise(F.col("index_status")).alias("index_status"))


def url_status(spark, d):
    """Attempts of every URL: how many, the last, and the last that succeeded."""
    r = table(spark, d, "raw_documents").select(urls.normalise(F.col("url")).alias("url"), "crawled_at", (F.col("index_status") != "error").alias("ok"), "index_status").filter("url is not null")
    return r.groupBy("url").agg(F.count("*").alias("attempts"), F.unix_micros(F.max("crawled_at")).alias("last_attempt"), F.unix_micros(F.max(F.when(F.col("ok"), F.col("crawled_at")))).alias("last_success"))


def queue_operations(spark, d):
    """The crawl's queue after 50 dequeues: what came out, and what is peeked next; the seen set stays."""
    links = table(spark, d, "link_edges").filter(urls.validate(F.col("dst")).isNull()).select(urls.normalise(F.col("dst")).alias("url"), "ord")
    q = graph.frontier(links, tables.docs(spark, d).select(urls.normalise(F.col("url")).alias("url")).filter("url is not null").distinct())
    out = q.orderBy("seq").limit(50).withColumn("state", F.lit("dequeued"))
    rest = q.join(out.select("url"), "url", "left_anti").orderBy("seq").limit(10).withColumn("state", F.lit("peeked"))
    return out.unionByName(rest).select("url", "seq", "state")


def domain_limiter(spark, d):
    """Records of each site in the hour before and with each crawl; above two it would have waited."""
    r = table(spark, d, "raw_documents").filter("crawled_at is not null").select("id", site_of(F.col("url")).alias("site"), "crawled_at", F.unix_micros("crawled_at").alias("us"))
    n = F.count("*").over(W.partitionBy("site").orderBy("us").rangeBetween(-3_600_000_000, 0))
    return r.withColumn("n", n).groupBy("site").agg(F.count("*").alias("n_rows"), F.max("n").alias("most"), F.count_if(F.col("n") > 2).alias("n_waiting"))


def redirect_chains(spark, d):
    """Chains of up to ten hops from link to link: every source of links redirects to its least target."""
    hops = tables.edges(spark, d).groupBy(F.col("src").alias("url")).agg(F.min("dst").alias("next"))
    return graph.resolve_redirects(materialise(hops), 10)


def capped_edges(spark, d):
    """Nodes whose out-edges a cap of twenty would cut."""
    e = graph.cap_out_edges(tables.edges(spark, d), 20)
    return e.groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("last"))


def crawl_reach(spark, d):
    """Breadth-first from the roots of the sites of all records, until nothing new is reached."""
    edges = materialise(tables.edges(spark, d).select("src", "dst"))
    seeds = tables.docs(spark, d).select(F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/")).alias("url")).unionByName(edges.select(F.col("src").alias("url")).filter(~F.col("url").rlike("[0-9]$"))).distinct()
    return graph.crawl_levels(seeds, edges, 100)


# ---- graph


def neighbours(spark, d):
    """How many and which least and greatest partners a node has, in and out."""
    e = tables.edges(spark, d)
    out = e.groupBy(F.col("src").alias("url")).agg(F.lit("out").alias("side"), F.count("*").alias("n"), F.min("dst").alias("first"), F.max("dst").alias("last"))
    return out.unionByName(e.groupBy(F.col("dst").alias("url")).agg(F.lit("in").alias("side"), F.count("*").alias("n"), F.min("src").alias("first"), F.max("src").alias("last")))


def pagerank_lookup(spark, d):
    """Score and status of the node of every record: computed, fallback (a node is missing), unavailable (no address)."""
    ranks = graph.pagerank(tables.edges(spark, d), iterations=10)
    p = tables.docs(spark, d).select("id", urls.normalise(F.col("url")).alias("node")).join(ranks.withColumnRenamed("url", "node"), "node", "left")
    return p.select("id", text.round_half_up(F.coalesce("score", F.lit(0.0)), 8).alias("score"), F.when(F.col("node").isNull(), "unavailable").when(F.col("score").isNull(), "fallback").otherwise("computed").alias("status"))


def pagerank_converged(spark, d):
    """Mass and size of the ranks when the change falls below a millionth."""
    r = graph.pagerank(tables.edges(spark, d), iterations=100, tolerance=1e-6)
    return r.agg(F.count("*").alias("n"), text.round_half_up(F.sum("score"), 6).alias("mass"))


def graph_round_trip(spark, d):
    """The graph written and rebuilt."""
    path = _folder(spark, "graph")
    tables.edges(spark, d).select("src", "dst", "n").write.parquet(path)
    return graph.summary(spark.read.parquet(path))


# ---- evaluation


def judged_filter(spark, d):
    """Judged queries of two splits with ten judgements at least."""
    q = tables.qrels(spark, d).groupBy("query_id", "category", "split").agg(F.count("*").alias("n"), F.max("grade").alias("best"))
    return q.filter("n >= 10")


def split_counts(spark, d):
    q = tables.qrels(spark, d)
    return q.groupBy("split").agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_judgements"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("grade", F.lit(1))))).alias("m")).select("split", "n_queries", "n_judgements", F.size("m").alias("n_grades"))


def search_quality(spark, d):
    """Pass or fail of every search query: results wanted unless it is empty; the expected first result is that of its rarest term."""
    top = bm25_topk(spark, d)
    parsed = search.parse(tables.queries(spark, d)).select("query_id", "is_empty")
    g = top.groupBy("query_id").agg(F.count("*").alias("n"), F.max("n_matched").alias("m"), F.min(F.when(F.col("n_matched") > 1, F.col("rank"))).alias("r"))
    q = parsed.join(g, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), "r", F.when(F.col("is_empty"), F.col("n").isNull()).otherwise(F.col("n") > 0).alias("passed"))
    return q.select("query_id", "n", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("reciprocal_rank"))


def experiment_grid(spark, d):
    """k1 by b by title boost over the stored index: for each setting the score sum of the best ten of every query, ranked."""
    ix = store.opened(spark, d)
    parsed = materialise(search.parse(tables.queries(spark, d)))
    m = materialise(search.matches(search.query_terms(parsed), parsed, ix.postings, ix.meta))
    grid = [(k1, b, t) for k1 in (0.9, 1.2) for b in (0.5, 0.75) for t in (2.0, 3.0)]
    out = None
    for k1, b, t in grid:
        s = search.rank(search.bm25(m, ix.dictionary, ix.stats, k1, b, search.BOOSTS | {"title": t}).withColumn("score", F.col("bm25")), 10)
        row = s.agg(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(t).alias("title_boost"), text.round_half_up(F.avg("score"), 3).alias("mean_score"))
        out = row if out is None else out.unionByName(row)
    return out


def category_tradeoffs(spark, d):
    """Pairs of a category that gains and one that loses between two runs."""
    q = tables.qrels(spark, d)
    a, b = (evaluate.by_category(evaluate.evaluate(_run(spark, d, f), q, 10)).select("category", F.col("ndcg").alias(f"n{f}")) for f in (0, 1))
    delta = a.join(b, "category").select("category", (F.col("n1") - F.col("n0")).alias("delta")).filter("category is not null")
    up, down = delta.filter("delta > 0").select(F.col("category").alias("improved")), delta.filter("delta < 0").select(F.col("category").alias("regressed"))
    return up.crossJoin(F.broadcast(down))  # a few categories each


def experiment_scores(spark, d):
    """The fixed scorer of experiments over the judged pairs of search queries with their documents' titles and descriptions."""
    p = tables.qrels(spark, d).groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade")).join(tables.queries(spark, d).filter("raw_query is not null"), "query_id")
    p = p.join(tables.docs(spark, d).select(F.col("id").alias("doc_id"), F.lower(F.coalesce("title", F.lit(""))).alias("t"), F.lower(F.coalesce("description", F.lit(""))).alias("s"), F.lower(F.coalesce("url", F.lit(""))).alias("u")), "doc_id")
    terms = F.filter(F.split(F.lower("raw_query"), r"\s+"), lambda w: w != "")
    size = F.size(F.filter(F.split(F.concat_ws(" ", "t", "s"), r"\s+"), lambda w: w != ""))
    times = lambda c, w: (F.length(c) - F.length(F.replace(c, w, F.lit("")))) / F.length(w)
    length = F.when(size == 0, 50).otherwise(size)
    p = p.select("query_id", "doc_id", "grade", terms.alias("terms"), length.alias("n"), "t", "s", "u")
    tf = lambda w: times(F.col("t"), w) * 3.0 + times(F.col("s"), w)
    part = F.aggregate(F.transform("terms", lambda w: F.when(tf(w) > 0, 1.5 * tf(w) * 2.2 / (tf(w) + 1.2 * (0.25 + 0.75 * F.col("n") / 50))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    bonus = 0.5 * F.size(F.filter("terms", lambda w: F.contains("u", w))) + F.when(F.size("terms") > 0, 0.25 * F.size(F.filter("terms", lambda w: tf(w) > 0)) / F.size("terms")).otherwise(0.0)
    proxy = 0.15 * 2.0 * F.log10(1 + F.greatest(F.lit(0.001), (F.col("grade") + 0.5) / 10) * 10) / F.log10(F.lit(11.0))
    return p.select("query_id", "doc_id", text.round_half_up(part + bonus + proxy, 4).alias("score"))


# ---- feedback and limits


def review_queue(spark, d):
    """Feedback imported for review once each, with its cluster, state by a rule, and strength (bursts weigh a tenth)."""
    f = feedback.bursts(tables.feedback(spark, d))
    key = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("none")) for c in ("category", "result_count_bucket", "reason_code")])
    state = F.element_at(F.array(F.lit("pending"), F.lit("accepted"), F.lit("dismissed")), (_rule(F.col("feedback_id"), 3) + 1).cast("int"))
    f = f.join(tables.feedback(spark, d).select("feedback_id", key.alias("cluster")), "feedback_id").select("feedback_id", "cluster", state.alias("state"), "strength")
    return f.groupBy("cluster", "state").agg(F.count("*").alias("n"), text.round_half_up(F.avg("strength"), 4).alias("mean_strength"))


def ranking_guard(spark, d):
    """Whether each category's change between two runs may go live: approved, not empty, measured, held-out loss below .005."""
    q = tables.qrels(spark, d)
    a, b = (evaluate.evaluate(_run(spark, d, f), q, 10).groupBy("category").agg(F.avg("ndcg").alias(f"n{f}")) for f in (0, 1))
    p = a.join(b, "category").withColumn("delta", F.col("n1") - F.col("n0"))
    approver = F.when(F.length("category") % 2 == 0, "reviewer")
    reason = F.when(approver.isNull(), "no approver").when(F.col("delta") == 0, "no change").when(F.col("delta") < -0.005, "held-out regression")
    return p.select("category", text.round_half_up(F.col("delta"), 6).alias("delta"), F.coalesce(reason, F.lit("allowed")).alias("decision"))


def weighted_limiter(spark, d):
    """Fixed windows of a minute from each event type's first event: cost 2 for values above 50, else 1; beyond 3 rejected."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("value") > 50, 2).otherwise(1).alias("cost"))
    first = e.groupBy("event_type").agg(F.min("us").alias("first"))
    e = e.join(first, "event_type").withColumn("slot", F.floor((F.col("us") - F.col("first")) / 60_000_000))
    used = F.sum("cost").over(W.partitionBy("event_type", "slot").orderBy("us", "event_id"))
    return e.withColumn("used", used).groupBy("event_type", "slot").agg(F.sum("cost").alias("cost"), F.count_if(F.col("used") > 3).alias("n_rejected"))


def circuit_breaker(spark, d):
    """Runs of failures of every event type: three failed events (negative or null value) in a row open it, an event after thirty seconds
    half-opens it."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.coalesce(F.col("value"), F.lit(-1.0)) < 20).alias("failed"))
    w = W.partitionBy("event_type").orderBy("us", "event_id")
    lag = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(False))
    opened = F.col("failed") & lag("failed", 1) & lag("failed", 2)
    e = e.withColumn("opens", opened).withColumn("gap", F.lead("us").over(w) - F.col("us"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("opens").alias("n_open"), F.count_if(F.col("opens") & (F.col("gap") >= 30_000_000)).alias("n_half_open"))


def sliding_windows(spark, d):
    """Events of each type in windows of an hour that begin every half hour."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def lens_validation(spark, d):
    """Rules of lenses made of every host, with the reasons to reject them."""
    h = tables.docs(spark, d).select(urls.host(F.col("url")).alias("host")).filter("host is not null and host != ''").distinct()
    n = F.length("host")
    r = h.select(F.when(n % 5 == 0, F.concat(F.lit("https://"), "host")).when(n % 5 == 1, "__proto__").otherwise(F.concat(F.lit("*."), "host")).alias("pattern"), F.when(n % 7 == 0, "raise").otherwise("boost").alias("action"), (n / 10.0).alias("multiplier"))
    issues = F.filter(F.array(F.when(F.col("pattern").isin("__proto__", "constructor", "prototype"), "key"), F.when(~F.col("pattern").rlike(r"^(\*?\.)?[a-z0-9-]+(\.[a-z0-9-]+)+$"), "pattern"), F.when(~F.col("action").isin("boost", "demote", "exclude"), "action"), F.when(~F.col("multiplier").between(0.05, 3.0), "multiplier")), lambda x: x.isNotNull())
    return r.groupBy("pattern", "action").agg(F.count("*").alias("n"), F.max(F.array_join(issues, ",")).alias("issues"))


QUERIES = {f.__name__: f for f in (jsonl_scan, collection_put, point_lookup, backup_verify, migrations, generated_corpus, report_export, index_build_load, segment_flush_read, index_upsert, index_document_actions, index_health, retained_generations, page_processing,
                                   url_status, queue_operations, domain_limiter, redirect_chains, capped_edges, crawl_reach, neighbours, pagerank_lookup, pagerank_converged, graph_round_trip, judged_filter, split_counts, search_quality, experiment_grid,
                                   category_tradeoffs, experiment_scores, review_queue, ranking_guard, weighted_limiter, circuit_breaker, sliding_windows, lens_validation)}

R = lambda c, m: f"(('0x' || left(md5({c}), 6))::BIGINT % {m})"
PLAIN = " || chr(10) || ".join(f"coalesce({c}, '')" for c in ("title", "description", "headings", "body_text"))
PICK = lambda i: f"['index', 'query', 'graph', 'crawler', 'ranking', 'token', 'segment', 'posting'][((('0x' || left(md5('7/' || id || '/{i}'), 6))::BIGINT % 8) + 1)::INT]"
TITLES = "SELECT id, term, count(*) AS tf FROM tokens WHERE field = 'title' GROUP BY id, term"
ORACLE = {
    "jsonl_scan": f"WITH {S.DOCS} SELECT id, url, title, language FROM docs",
    "collection_put": f"WITH {S.DOCS} SELECT id, length(title) + CASE WHEN {R('id', 3)} = 0 THEN 1 ELSE 0 END AS n, CASE WHEN {R('id', 3)} = 0 THEN 2 ELSE 1 END AS version FROM docs",
    "point_lookup": f"WITH {S.DOCS} SELECT id, 'id' AS key FROM docs WHERE id IN (SELECT doc_id FROM qrels WHERE grade IS NOT NULL) UNION ALL SELECT id, 'url_hash' FROM docs WHERE {S.norm_url('url')} IN (SELECT {S.norm_url('dst')} FROM link_edges)",
    "backup_verify": "SELECT 'raw_documents' AS collection, count(*) AS n, count(DISTINCT id) AS n_keys, true AS is_equal FROM raw_documents UNION ALL SELECT 'link_edges', count(*), count(DISTINCT ord), true FROM link_edges UNION ALL SELECT 'feedback', count(*), count(DISTINCT feedback_id), true FROM feedback UNION ALL SELECT 'qrels', count(*), count(DISTINCT query_id), true FROM qrels",
    "migrations": f"WITH {S.DOCS} SELECT id, CASE WHEN {R('id', 3)} = 0 THEN lower(left(language, 2)) ELSE language END AS language, CASE WHEN {R('id', 3)} < 2 THEN {S.host('url')} END AS host, 3 AS version FROM docs",
    "generated_corpus": f"WITH g AS (SELECT range AS id FROM range((SELECT count(*) FROM customer))), b AS (SELECT id, concat_ws(' ', {', '.join(PICK(i) for i in range(4))}) AS body FROM g) SELECT body, min(id) AS id, count(*) AS n FROM b GROUP BY body",
    "index_build_load": f"WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS} SELECT term, df, total_tf FROM dictionary",
    "segment_flush_read": f"WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS} SELECT id, count(*) AS n_terms, sum(tf) AS total_tf FROM (SELECT id, term, tf FROM postings WHERE {R('id', 10)} NOT IN (2, 9) UNION ALL SELECT * FROM ({TITLES}) WHERE {R('id', 10)} = 2) GROUP BY id",
    "index_upsert": f"WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS} SELECT term, count(*) AS df, sum(tf) AS total_tf FROM (SELECT id, term, tf FROM postings WHERE {R('id', 3)} <> 0 UNION ALL SELECT * FROM ({TITLES}) WHERE {R('id', 3)} = 0) WHERE {R('id', 10)} <> 7 GROUP BY term",
    "index_document_actions": f"WITH {S.DOCS}, b AS (SELECT id, {R('id', 5)} AS r, trim(coalesce(title, '')) || trim(coalesce(headings, '')) || trim(coalesce(description, '')) || trim(coalesce(body_text, '')) = '' AS blank FROM docs) SELECT id, CASE WHEN blank AND r = 0 THEN 'empty' WHEN blank THEN 'deleted' WHEN r = 0 THEN 'indexed' WHEN r = 1 THEN 'updated' ELSE 'skipped' END AS action FROM b",
    "index_health": f"WITH {S.INDEX}, i AS (SELECT count(*) AS n FROM meta WHERE id NOT IN (SELECT id FROM postings)), p AS (SELECT count(*) FILTER (index_status IN ('pending', 'stale')) AS k, count(*) AS a FROM docs) SELECT CASE WHEN i.n > 0 THEN 'corrupt' WHEN k > 0.1 * a THEN 'degraded' ELSE 'healthy' END AS status, i.n AS n_issues, n_documents, k AS n_pending, round(k / a, 6) AS pending_share FROM i, p, stats",
    "retained_generations": f"WITH {S.DOCS}, b AS (SELECT {S.SITE('url')} AS site, id AS build_id, index_status = 'indexed' AS ready, crawled_at FROM docs), a AS (SELECT site, min(build_id) AS active FROM b WHERE ready GROUP BY site), o AS (SELECT b.site, build_id, ready, row_number() OVER (PARTITION BY b.site ORDER BY coalesce(build_id = active, false) DESC, coalesce(ready, false) DESC, crawled_at DESC NULLS LAST, build_id) AS k FROM b LEFT JOIN a ON a.site = b.site) SELECT site, build_id FROM o WHERE k <= 3 AND ready",
    "page_processing": f"WITH {S.DOCS}, o AS (SELECT id, index_status, CASE WHEN {S.reject('url')} IS NOT NULL THEN 'rejected' WHEN {R('id', 17)} = 0 THEN 'robots' WHEN last_modified > crawled_at THEN 'not_modified' WHEN content_hash = sha256({PLAIN}) THEN 'unchanged' ELSE 'changed' END AS outcome FROM docs) SELECT id, outcome, CASE WHEN outcome = 'changed' THEN 'pending' ELSE index_status END AS index_status FROM o",
    "url_status": f"SELECT {S.norm_url('url')} AS url, count(*) AS attempts, epoch_us(max(crawled_at)) AS last_attempt, epoch_us(max(crawled_at) FILTER (index_status <> 'error')) AS last_success FROM raw_documents WHERE {S.norm_url('url')} IS NOT NULL GROUP BY 1",
    "queue_operations": f"WITH {S.DOCS}, c AS (SELECT {S.norm_url('dst')} AS url, min(ord) AS seq FROM link_edges WHERE {S.reject('dst')} IS NULL GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM c WHERE url NOT IN (SELECT {S.norm_url('url')} FROM docs WHERE {S.norm_url('url')} IS NOT NULL)) SELECT url, seq, CASE WHEN k <= 50 THEN 'dequeued' ELSE 'peeked' END AS state FROM q WHERE k <= 60",
    "domain_limiter": f"WITH r AS (SELECT {S.SITE('url')} AS site, crawled_at FROM raw_documents WHERE crawled_at IS NOT NULL), n AS (SELECT site, count(*) OVER (PARTITION BY site ORDER BY crawled_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM r) SELECT site, count(*) AS n_rows, max(n) AS most, count(*) FILTER (n > 2) AS n_waiting FROM n GROUP BY site",
    "redirect_chains": f"WITH RECURSIVE {S.EDGES}, h AS (SELECT src AS url, min(dst) AS next FROM edges GROUP BY src), c AS (SELECT url, next AS target, 1 AS n FROM h UNION ALL SELECT c.url, h.next, n + 1 FROM c JOIN h ON h.url = c.target WHERE n < 10) SELECT url, arg_max(target, n) AS target, max(n) AS n_hops FROM c GROUP BY url",
    "capped_edges": f"WITH {S.EDGES}, k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges) SELECT src, count(*) AS n, max(dst) AS last FROM k WHERE r <= 20 GROUP BY src",
    "neighbours": f"WITH {S.EDGES} SELECT src AS url, 'out' AS side, count(*) AS n, min(dst) AS \"first\", max(dst) AS \"last\" FROM edges GROUP BY src UNION ALL SELECT dst, 'in', count(*), min(src), max(src) FROM edges GROUP BY dst",
    "pagerank_lookup": f"WITH {S.DOCS}, {_pagerank(10)} SELECT id, {S.r('coalesce(score, 0.0)', 8)} AS score, CASE WHEN {S.norm_url('d.url')} IS NULL THEN 'unavailable' WHEN score IS NULL THEN 'fallback' ELSE 'computed' END AS status FROM docs d LEFT JOIN rank10 p ON p.url = {S.norm_url('d.url')}",
    "pagerank_converged": f"WITH {S.EDGES} SELECT count(*) AS n, 1.0::DOUBLE AS mass FROM (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "judged_filter": f"WITH {S.QRELS} SELECT query_id, category, split, count(*) AS n, max(grade) AS best FROM qr GROUP BY ALL HAVING count(*) >= 10",
    "split_counts": f"WITH {S.QRELS} SELECT split, count(DISTINCT query_id) AS n_queries, count(*) AS n_judgements, count(DISTINCT grade) AS n_grades FROM qr GROUP BY split",
    "search_quality": f"{S.SEARCH}, ranked AS (SELECT query_id, n_matched, row_number() OVER (PARTITION BY query_id ORDER BY {S.r('bm25', 4)} DESC, id) AS rank FROM bm), g AS (SELECT query_id, count(*) AS n, min(rank) FILTER (n_matched > 1) AS r FROM ranked WHERE rank <= 10 GROUP BY query_id) SELECT query_id, coalesce(n, 0) AS n, CASE WHEN is_empty THEN n IS NULL ELSE coalesce(n > 0, false) END AS passed, coalesce(1.0 / r, 0.0) AS reciprocal_rank FROM parsed LEFT JOIN g USING (query_id)",
    "review_queue": None,
    "weighted_limiter": "WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, CASE WHEN value > 50 THEN 2 ELSE 1 END AS cost FROM events), f AS (SELECT *, (us - min(us) OVER (PARTITION BY event_type)) // 60000000 AS slot FROM e), u AS (SELECT *, sum(cost) OVER (PARTITION BY event_type, slot ORDER BY us, event_id) AS used FROM f) SELECT event_type, slot, sum(cost) AS cost, count(*) FILTER (used > 3) AS n_rejected FROM u GROUP BY ALL",
    "circuit_breaker": "WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, coalesce(value, -1.0) < 20 AS f FROM events), o AS (SELECT *, f AND coalesce(lag(f, 1) OVER w, false) AND coalesce(lag(f, 2) OVER w, false) AS o, lead(us) OVER w - us AS gap FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id)) SELECT event_type, count(*) AS n, count(*) FILTER (o) AS n_open, count(*) FILTER (o AND gap >= 30000000) AS n_half_open FROM o GROUP BY event_type",
    "sliding_windows": "WITH e AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts, TIMESTAMP '1970-01-01') AS b FROM events) SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([b, b - INTERVAL 30 MINUTES]) AS w FROM e) GROUP BY ALL",
}
ORACLE = {name: sql for name, sql in ORACLE.items() if sql}
