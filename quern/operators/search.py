"""Query parsing, retrieval and ranking of many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text, urls

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "headings": 2.0, "description": 1.5, "body": 1.0}
NOW = "2025-07-01 00:00:00"
MAX_QUERY = 200
# Groups of synonyms.
SYNONYMS = """
js javascript ecmascript; ts typescript; py python; golang go; rust rustlang; cpp cplusplus c++; csharp c# dotnet; rb ruby; kt kotlin; php hypertext;
docs documentation manual guide reference; auth authentication authorization login; repo repository codebase; cfg config configuration settings; dir directory folder;
pkg package module library lib; db database datastore storage; api endpoint rest service; cli command terminal shell console; ui gui frontend interface;
dev developer development; spec specification standard; dep dependency dependencies; env environment; err error exception failure bug; req request payload;
res response result; idx index indexer; perf performance speed latency benchmark; msg message; sync synchronize synchronous; async asynchronous;
fast quick rapid speedy; build compile bundle; test spec verification; help faq support; create generate scaffold init initialize;
delete remove purge clean destroy; find search lookup query; start launch run execute; stop terminate kill halt; update upgrade modify patch; doc document page article
"""

# Terms that corrections may propose though no document holds them.
BUILTIN_TERMS = """
typescript javascript python golang rust database indexing crawler security privacy protocol network architecture serverless documentation tutorial reference software browser
""".split()


def synonym_pairs() -> list[tuple[str, str]]:
    groups = [g.split() for g in SYNONYMS.replace("\n", " ").split(";")]
    return sorted({(a, b) for g in groups for a in g for b in g if a != b})


def parse(queries: DataFrame) -> DataFrame:
    """(query_id, terms, phrases, negated, site, filetype, intitle, is_clamped, is_empty) from raw_query. Stop words stay in terms; of a
    compound with hyphens the first part is a term; words of phrases, intitle and exact are terms too."""
    raw = F.coalesce("raw_query", F.lit(""))
    q = queries.select("query_id", raw.alias("raw"), F.substring(raw, 1, MAX_QUERY).alias("q"), (F.length(raw) > MAX_QUERY).alias("is_clamped"))
    q = q.withColumn("q", text.normalise(F.col("q")))
    q = q.withColumns({
        "site": F.nullif(F.regexp_extract("q", r"(?:^|\s)site:(\S+)", 1), F.lit("")),
        "filetype": F.nullif(F.regexp_extract("q", r"(?:^|\s)filetype:([a-z0-9]+)", 1), F.lit("")),
        "intitle": F.regexp_extract_all("q", F.lit(r"(?:^|\s)intitle:([^\s\"']+)"), F.lit(1)),
        "exact": F.regexp_extract_all("q", F.lit(r"(?:^|\s)exact:([^\s\"']+)"), F.lit(1)),
    })
    q = q.withColumn("rest", F.regexp_replace("q", r"(?:^|\s)(?:site|filetype|intitle|exact):\S+", " "))
    q = q.withColumn("quoted", F.regexp_extract_all("rest", F.lit(r"\"([^\"]+)\""), F.lit(1)))
    q = q.withColumn("rest", F.regexp_replace("rest", r"\"[^\"]+\"", " "))
    q = q.withColumn("negated", F.regexp_extract_all("rest", F.lit(r"(?:^|\s)(?:-|not\s+)([\p{L}\p{N}]+)"), F.lit(1)))
    q = q.withColumn("rest", F.regexp_replace("rest", r"(?:^|\s)(?:-|not\s+)[\p{L}\p{N}]+", " "))
    q = q.withColumn("rest", F.regexp_replace("rest", r"([\p{L}\p{N}])[-_][\p{L}\p{N}_-]+", "$1"))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    terms = F.concat(words("rest"), F.flatten(F.transform("quoted", words)), F.flatten(F.transform("intitle", words)), F.flatten(F.transform("exact", words)))
    q = q.withColumns({"terms": F.array_distinct(terms), "phrases": F.filter(F.transform("quoted", words), lambda p: F.size(p) > 0)})
    empty = (F.size("terms") == 0) & F.col("site").isNull() & F.col("filetype").isNull()
    return q.select("query_id", "terms", "phrases", "negated", "site", "filetype", "intitle", "is_clamped", empty.alias("is_empty"))


def query_terms(parsed: DataFrame) -> DataFrame:
    """(query_id, term, weight): the distinct terms with weight 1."""
    return parsed.select("query_id", F.explode("terms").alias("term"), F.lit(1.0).alias("weight"))


def expand_synonyms(terms: DataFrame, weight: float = 0.6) -> DataFrame:
    """Terms with synonyms at a lower weight; an original term is never lowered. The synonym table is a constant."""
    spark = terms.sparkSession
    pairs = F.broadcast(spark.createDataFrame(synonym_pairs(), "term string, synonym string"))
    more = terms.join(pairs, "term").select("query_id", F.col("synonym").alias("term"), F.lit(weight).alias("weight"))
    return terms.unionByName(more).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def idf(df: Column, n: Column) -> Column:
    d = F.least(df, n)
    return F.when((n <= 0) | (d <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log(1 + (n - d + 0.5) / (d + 0.5))))


def _passes() -> Column:
    """Whether host, path and title are as the query's site, filetype and intitle ask."""
    h = F.col("host")
    passes = F.coalesce((h == F.col("site")) | h.endswith(F.concat(F.lit("."), F.col("site"))), F.col("site").isNull())
    passes = passes & F.coalesce(F.col("path").endswith(F.concat(F.lit("."), F.col("filetype"))), F.col("filetype").isNull())
    return passes & F.forall("intitle", lambda w: F.contains(F.lower(F.coalesce("title", F.lit(""))), w))


def matches(terms: DataFrame, parsed: DataFrame, postings: DataFrame, meta: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """(query_id, id, ...): one row per query term and posting that passes the query's filters and holds no negated term. The query side is
    the small one; whether it is broadcast is left to its size at run time. alive: (query_id and id or block) that may match."""
    hits = postings.join(terms, "term")
    if alive is not None:
        hits = hits.join(alive, alive.columns, "left_semi")
    hits = hits.join(meta.select("id", "url", "host", "path", "title", "description", "len_title", "len_headings", "len_description", "len_body", "last_modified", "crawled_at"), "id")
    hits = hits.join(parsed.select("query_id", "site", "filetype", "intitle", "negated"), "query_id")
    out = hits.filter(_passes())
    bad = parsed.select("query_id", F.explode("negated").alias("term")).join(postings.select("term", "id"), "term").select("query_id", "id").distinct()
    return out.join(bad, ["query_id", "id"], "left_anti")


def filter_only(filters: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, id) of filters (query_id, site, filetype). Sites are joined by equality with every suffix of a document's host; filters
    of a file type alone by equality with the extensions of its path (each of the path's dots begins one)."""
    f = filters.filter(F.col("site").isNotNull() | F.col("filetype").isNotNull())
    m = meta.select("id", "host", "path")
    by_site = m.select("id", "path", F.explode(urls.suffixes(F.col("host"))).alias("site")).join(f.filter("site is not null"), "site")
    by_site = by_site.filter(F.coalesce(F.col("path").endswith(F.concat(F.lit("."), F.col("filetype"))), F.col("filetype").isNull())).select("query_id", "id")
    types = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), i, F.size(F.split("path", r"\."))), ".")))
    by_type = m.filter(F.contains("path", F.lit("."))).select("id", F.explode(F.slice(types, 2, 2**30)).alias("filetype")).join(f.filter("site is null"), "filetype").select("query_id", "id")
    return by_site.unionByName(by_type)


def candidates(m: DataFrame, parsed: DataFrame, mode: str = "union") -> DataFrame:
    """(query_id, id, n_matched, is_full): union, intersection or adaptive (all terms, if that gives ten or as many as terms; else any)."""
    n = parsed.select("query_id", F.size("terms").alias("n_terms"))
    c = m.groupBy("query_id", "id").agg(F.count_distinct("term").alias("n_matched")).join(n, "query_id").withColumn("is_full", F.col("n_matched") == F.col("n_terms"))
    if mode == "intersection":
        c = c.filter("is_full")
    elif mode == "adaptive":
        # counts per query, not a window: a query may match a large share of all documents
        full = c.groupBy("query_id").agg(F.count_if("is_full").alias("n_full"))
        c = c.join(full, "query_id").filter(F.col("is_full") | ~((F.col("n_full") >= 10) | (F.col("n_full") >= F.col("n_terms"))))
    return c.select("query_id", "id", "n_matched", "is_full")


def field_score(k1: float = K1, b: float = B, boosts: dict = BOOSTS) -> Column:
    """Saturated term frequencies of the fields, boosted, over the columns tf_*, len_* and avg_*."""
    part = F.lit(0.0)
    for f, boost in boosts.items():
        tf = F.col(f"tf_{f}")
        norm = k1 * (1 - b + b * F.col(f"len_{f}") / F.greatest(F.lit(1.0), F.col(f"avg_{f}")))
        part = part + F.when(tf > 0, boost * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)
    return part


def bm25(m: DataFrame, dictionary: DataFrame, stats: DataFrame, k1: float = K1, b: float = B, boosts: dict = BOOSTS) -> DataFrame:
    """(query_id, id, bm25, n_matched): field-boosted BM25 summed over terms and fields, for any parameters."""
    m = m.join(dictionary.select("term", "df"), "term").crossJoin(F.broadcast(stats.select("n_documents", *[f"avg_{f}" for f in boosts])))  # stats has one row
    score = idf(F.col("df"), F.col("n_documents")) * F.col("weight") * field_score(k1, b, boosts)
    return m.select("query_id", "id", "term", score.alias("s")).groupBy("query_id", "id").agg(F.sum("s").alias("bm25"), F.count_distinct("term").alias("n_matched"))


def bm25_stored(m: DataFrame) -> DataFrame:
    """(query_id, id, bm25, n_matched) from the impacts that the index stores. A query has a term once, so that a posting is a match."""
    return m.groupBy("query_id", "id").agg(F.sum(F.col("impact") * F.col("weight")).alias("bm25"), F.count("*").alias("n_matched"))


WORDS = 16  # words of 64 ranges in a row of marks


def marks(ranges: DataFrame) -> DataFrame:
    """(query_id, chunk, marks): the distinct ranges (query_id, block) as bits, 64 to a word and WORDS words to a row."""
    words = ranges.groupBy("query_id", F.floor(F.col("block") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("block") % 64)).alias("bits"))
    return words.groupBy("query_id", F.floor(F.col("word") / WORDS).cast("int").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("marks"))


def scores(terms: DataFrame, parsed: DataFrame, ix, needed: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """(query_id, id, bm25, n_matched) of the documents that match; of these only such as hold a term of needed (query_id, term, weight) or
    lie in ranges (query_id, block), where given. Where postings are laid out by block (store.over_terms), the query side is broadcast,
    ranges as bits, and excluded and needed terms are told in the sum of each document, so that no match is shuffled."""
    if ix.meta is not None:
        alive = ranges if needed is None else matches(needed, parsed, ix.postings, ix.meta).select("query_id", "id").distinct()
        return bm25_stored(matches(terms, parsed, ix.postings, ix.meta, alive))
    asked = terms.select("query_id", "term", "weight", F.lit(False).alias("bad"), F.lit(needed is None).alias("good"))
    if needed is not None:
        must = needed.select("query_id", "term", F.lit(True).alias("must"))
        asked = asked.join(must, ["query_id", "term"], "left").select("query_id", "term", "weight", "bad", F.col("must").isNotNull().alias("good"))
    bad = parsed.select("query_id", F.explode(F.array_distinct("negated")).alias("term"), F.lit(0.0).alias("weight"), F.lit(True).alias("bad"), F.lit(False).alias("good"))
    hits = ix.postings.select("term", "block", "id", "host", "path", "title", "impact").join(F.broadcast(asked.unionByName(bad)), "term")
    if ranges is not None:
        hits = hits.withColumn("chunk", F.floor(F.col("block") / (64 * WORDS)).cast("int")).join(F.broadcast(marks(ranges)), ["query_id", "chunk"])
        hits = hits.filter(F.getbit(F.coalesce(F.try_element_at("marks", F.floor(F.col("block") / 64).cast("int")), F.lit(0).cast("bigint")), F.col("block") % 64) == 1)
    hits = hits.join(F.broadcast(parsed.select("query_id", "site", "filetype", "intitle")), "query_id").filter(_passes())
    sums = hits.groupBy("query_id", "block", "id").agg(
        F.sum(F.when(~F.col("bad"), F.col("impact") * F.col("weight"))).alias("bm25"), F.count_if(~F.col("bad")).alias("n_matched"), F.bool_or("bad").alias("bad"), F.bool_or("good").alias("good"))
    return sums.filter("good and not bad").select("query_id", "id", "bm25", "n_matched")


def exhaustive(terms: DataFrame, parsed: DataFrame, ix, k: int) -> DataFrame:
    """(query_id, id, bm25, n_matched) of all documents that match, whatever k is."""
    return scores(terms, parsed, ix)


def vocabulary(parsed: DataFrame) -> DataFrame:
    """(term): the distinct terms that queries ask for or exclude."""
    return parsed.select(F.explode(F.concat("terms", "negated")).alias("term")).distinct()


def _small(df: DataFrame, ix) -> DataFrame:
    """The query side of a join, broadcast where postings are laid out by block."""
    return F.broadcast(df) if ix.meta is None else df


def thresholds(terms: DataFrame, parsed: DataFrame, ix, k: int) -> DataFrame:
    """(query_id, theta): the k-th best score that the rarest term of a query gives alone; no row for queries with fewer documents. A
    document's score is at least that of one term, so that no result of the best k scores below theta."""
    priced = terms.join(ix.dictionary.select("term", "df", "bound"), "term")
    rare = priced.groupBy("query_id").agg(F.min(F.struct("df", "term", "weight")).alias("r")).select("query_id", "r.term", "r.weight")
    alone = scores(rare, parsed, ix)
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bm25").desc(), "id"))
    return alone.withColumn("r", order).filter(F.col("r") == k).select("query_id", F.col("bm25").alias("theta"))


def maxscore(terms: DataFrame, parsed: DataFrame, ix, k: int) -> DataFrame:
    """(query_id, id, bm25, n_matched) of documents that can be among the best k. Terms in ascending order of their stored bounds are
    nonessential while the bounds sum to less than theta: a document with only these can't reach it, so that only the postings of the
    other terms make candidates."""
    theta = thresholds(terms, parsed, ix, k)
    priced = terms.join(ix.dictionary.select("term", "bound"), "term").join(theta, "query_id", "left")
    upto = F.sum(F.col("bound") * F.col("weight")).over(W.partitionBy("query_id").orderBy(F.col("bound") * F.col("weight"), "term").rowsBetween(W.unboundedPreceding, 0))
    essential = priced.withColumn("upto", upto).filter(F.col("theta").isNull() | (F.col("upto") >= F.col("theta") - 1e-9)).select("query_id", "term", "weight")
    return scores(terms, parsed, ix, needed=essential)


def wand(terms: DataFrame, parsed: DataFrame, ix, k: int) -> DataFrame:
    """(query_id, id, bm25, n_matched) of documents that can be among the best k. Bounds are stored by term and range of documents, ranges
    being the same for all terms; a range is skipped for a query if its terms' bounds there sum to less than theta."""
    theta = thresholds(terms, parsed, ix, k)
    ranges = ix.blocks.select("term", "block", "bound").join(_small(terms, ix), "term").groupBy("query_id", "block").agg(F.sum(F.col("bound") * F.col("weight")).alias("most"))
    alive = ranges.join(_small(theta, ix), "query_id", "left").filter(F.col("theta").isNull() | (F.col("most") >= F.col("theta") - 1e-9)).select("query_id", "block")
    return scores(terms, parsed, ix, ranges=alive)


def phrase_hits(parsed: DataFrame, positions: DataFrame) -> DataFrame:
    """(query_id, id): all phrases of the query stand in one field each, word by word. Words are joined by (term); starts are counted."""
    words = parsed.select("query_id", F.posexplode("phrases").alias("p", "words")).select("query_id", "p", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
    starts = words.join(positions, "term").select("query_id", "p", "n", "i", "id", "field", F.explode("positions").alias("at"))
    found = starts.groupBy("query_id", "p", "n", "id", "field", (F.col("at") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("k")).filter("k = n")
    per_query = parsed.filter(F.size("phrases") > 0).select("query_id", F.size("phrases").alias("n_phrases"))
    return found.groupBy("query_id", "id").agg(F.count_distinct("p").alias("k")).join(per_query, "query_id").filter("k = n_phrases").select("query_id", "id")


def freshness(ts: Column, now: str = NOW, half_life: float = 30.0) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts)) / 86400e6)
    return F.when(ts.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.exp(-F.log(F.lit(2.0)) / half_life * days))))


def pagerank_bonus(score: Column, n: Column, transform: str = "log", weight: float = 0.15, max_boost: float = 2.0) -> Column:
    ratio = score * n
    value = {
        "log": F.log10(1 + F.least(ratio, F.lit(100.0))) / F.log10(F.lit(101.0)),
        "minmax": score / (10 / n),
        "sigmoid": 1 / (1 + F.exp(-(ratio - 1) / 2)),
        "linear": score / (20 / n),
    }[transform]
    value = F.when(n == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return text.round_half_up(weight * value * max_boost, 4)


def rank(scored: DataFrame, k: int) -> DataFrame:
    """Best k of each query by score, then id; score rounded to four digits."""
    s = scored.withColumn("score", text.round_half_up(F.col("score"), 4))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return s.withColumn("rank", order).filter(F.col("rank") <= k)


def signals(bm: DataFrame, m: DataFrame, parsed: DataFrame, phrases: DataFrame, pagerank: DataFrame, n_nodes: int) -> DataFrame:
    """(query_id, id, url, title, bm25, full_boost, phrase_boost, url_bonus, freshness, authority, pagerank, score)."""
    d = m.select("query_id", "id", "url", "title", "last_modified", "crawled_at").distinct()
    s = bm.join(d, ["query_id", "id"]).join(parsed.select("query_id", "terms", F.size("phrases").alias("n_phrases")), "query_id")
    s = s.join(phrases.withColumn("phrase_ok", F.lit(True)), ["query_id", "id"], "left")
    s = s.withColumn("node", urls.normalise(F.col("url"))).join(pagerank.select(F.col("url").alias("node"), F.col("score").alias("pr")), "node", "left")
    full = F.when(F.col("n_matched") == F.size("terms"), 1.25).otherwise(1.0)
    phrase = F.when((F.col("n_phrases") > 0) & F.col("phrase_ok"), 1.5).otherwise(1.0)
    url_bonus = F.least(F.lit(0.7), 0.35 * F.size(F.filter("terms", lambda t: (F.length(t) > 2) & F.contains(F.lower("url"), t))))
    fresh = 0.1 * freshness(F.coalesce("last_modified", "crawled_at"))
    authority = 0.1 * urls.authority(urls.host(F.col("url")))
    bonus = F.coalesce(pagerank_bonus(F.col("pr"), F.lit(float(n_nodes))), F.lit(0.0))
    s = s.select("query_id", "id", "url", "title", text.round_half_up(F.col("bm25"), 6).alias("bm25"), full.alias("full_boost"), phrase.alias("phrase_boost"), url_bonus.alias("url_bonus"), fresh.alias("freshness"), authority.alias("authority"), bonus.alias("pagerank"))
    return s.withColumn("score", F.greatest(F.lit(0.0), F.col("bm25") * F.col("full_boost") * F.col("phrase_boost") + F.col("url_bonus") + F.col("freshness") + F.col("authority") + F.col("pagerank")))


def dampen(ranked: DataFrame, k: int) -> DataFrame:
    """Second ranking: each further row of a host costs a factor 0.8, a repeated beginning of the title another. ranked has rank and score."""
    h = urls.host(F.col("url"))
    beginning = F.substring(F.lower(F.coalesce("title", F.lit(""))), 1, 30)
    by_host = F.row_number().over(W.partitionBy("query_id", h).orderBy("rank")) - 1
    by_title = F.row_number().over(W.partitionBy("query_id", beginning).orderBy("rank")) - 1
    factor = F.pow(F.lit(0.8), by_host) * F.when((F.length(beginning) > 5) & (by_title > 0), 0.8).otherwise(1.0)
    d = ranked.withColumn("penalty", factor).withColumn("score", F.col("score") * F.col("penalty")).drop("rank")
    return rank(d, k)


def lens(ranked: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """Rules (action, pattern, multiplier) by host: exclusion over the largest boost over the strongest demotion. Patterns are a host, or
    *.root or .root for hosts below it too. Rules are joined by equality with every suffix of a host, however many there are."""
    r = rules.select("action", F.regexp_replace(F.lower("pattern"), r"^\*?\.?", "").alias("root"), "multiplier")
    r = r.groupBy("root").agg(
        F.max(F.col("action") == "exclude").alias("out"),
        F.max(F.when(F.col("action") == "boost", F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.col("multiplier"))))).alias("boost"),
        F.min(F.when(F.col("action") == "demote", F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("multiplier"))))).alias("demote"))
    hosts = ranked.select(urls.host(F.col("url")).alias("host")).distinct()
    hit = (hosts.select("host", F.explode(urls.suffixes(F.col("host"))).alias("root")).join(r, "root").groupBy("host")
           .agg(F.max("out").alias("out"), F.max("boost").alias("boost"), F.min("demote").alias("demote")))
    kept = ranked.withColumn("host", urls.host(F.col("url"))).join(hit, "host", "left").filter(~F.coalesce("out", F.lit(False)))
    kept = kept.withColumn("rank_before", F.col("rank")).withColumn("lens", F.coalesce("boost", "demote", F.lit(1.0))).drop("host", "out", "boost", "demote")
    return rank(kept.withColumn("score", F.col("score") * F.col("lens")).drop("rank"), k)
