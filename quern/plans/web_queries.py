"""Queries on pages, links, robots rules, sitemaps and privacy guards. Pages, robots files and sitemaps are made by rule from all
records and links; the SQL twins compute what has to come out from the tables, without the made texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import html, privacy, robots, text, trackers, urls
from quern.plans import sqltext as S
from quern.runtime import table
from quern.sources import tables

DOMAINS = sorted(trackers.TRACKERS)


def _docs(spark, d):
    """The latest row of each record that has a URL, with its links."""
    links = table(spark, d, "raw_documents").groupBy("id").agg(F.max_by(F.struct("outbound_links"), F.struct("crawled_at", "index_status", "last_modified", "url")).alias("l")).select("id", "l.outbound_links")
    return tables.docs(spark, d).filter(urls.validate(F.col("url")).isNull()).join(links, "id")


def pages(spark, d):
    """(page_id, url, html): a page for each record. Titles, descriptions and body lines are escaped into it; language and description stand
    in either order of attributes; every fifth link asks not to be followed; by the title's length a page has up to six scripts of
    trackers, an own script, a beacon, and a rule for robots."""
    esc = lambda c: text.escape_html(F.coalesce(c, F.lit("")))
    n = F.length(F.coalesce("title", F.lit("")))
    scripts = F.transform(F.sequence(F.lit(1), n % 7), lambda i: F.concat(F.lit('<script async src="https://cdn.'), F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), ((n + i) % len(DOMAINS) + 1).cast("int")), F.lit('/t.js"></script>')))
    scripts = F.array_join(F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(scripts), "")
    anchors = F.array_join(F.transform(F.coalesce("outbound_links", F.array().cast("array<string>")), lambda u, i: F.concat(F.lit('<a class="x" href="'), esc(u), F.when(i % 5 == 0, '" rel="noopener nofollow"').otherwise('"'), F.lit(">Link "), i.cast("string"), F.lit(" &amp; more</a>"))), "\n")
    heads = F.array_join(F.transform(F.filter(F.split(F.coalesce("headings", F.lit("")), "\n"), lambda h: F.trim(h) != ""), lambda h, i: F.concat(F.lit("<h"), (i % 5 + 2).cast("string"), F.lit(' id="a">'), esc(h), F.lit("</h"), (i % 5 + 2).cast("string"), F.lit(">"))), "\n")
    body = F.array_join(F.transform(F.split(F.coalesce("body_text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    description = F.when(n % 2 == 0, F.concat(F.lit('<meta name="description" content="'), esc("description"), F.lit('">'))).otherwise(F.concat(F.lit("<meta content='"), esc("description"), F.lit("' name='description'/>")))
    page = F.concat(
        F.lit('<!doctype html><html lang="'), F.lower(F.substring(F.coalesce("language", F.lit("")), 1, 2)), F.lit('-XX"><head><title>'), esc("title"), F.lit("</title>"), description,
        F.when(n % 4 == 0, '<meta name="robots" content="index, nofollow">').otherwise(""), F.lit('<link rel="canonical" href="'), esc("url"), F.lit('"><style>p { color: red }</style></head><body><nav><a href="/menu">Menu</a></nav>'),
        F.lit('<script src="/own.js">if (1 < 2) { x() }</script>'), scripts, F.lit('<img src="https://px.'), F.lit(DOMAINS[0]), F.lit('/p.gif" width="1" height="1"><!-- <p>hidden</p> -->'), F.lit("<div>"), heads, F.lit("</div><main>"), body, F.lit("</main><div>"), anchors, F.lit("</div><footer>Foot</footer></body></html>"))
    return _docs(spark, d).select(F.col("id").alias("page_id"), "url", page.alias("html"))


def html_parse(spark, d):
    p = pages(spark, d).select("page_id", html.parse(F.col("html"), urls.normalise(F.col("url"))).alias("p"))
    return p.select("page_id", "p.title", "p.description", "p.canonical", "p.language", F.size("p.heading_items").alias("n_headings"), "p.headings", F.md5(F.regexp_replace("p.body", r"\n?Link \d+ & more.*", "")).alias("body_md5"), "p.is_nofollow")


def html_links(spark, d):
    """Links of every page: resolved, valid, normalised, each target once with its first anchor."""
    p = pages(spark, d).select("page_id", "url", html.base(F.col("html"), F.col("url")).alias("base"), html.nofollow(F.col("html")).alias("page_nofollow"), F.posexplode(html.anchors(F.col("html"))).alias("pos", "a"))
    p = p.withColumn("to", html.resolve(F.col("base"), F.col("a.href"))).filter(urls.validate(F.col("to")).isNull()).withColumn("to", urls.normalise(F.col("to")))
    quiet = F.col("page_nofollow") | F.col("a.rel").rlike(r"(^|\s)(nofollow|ugc|sponsored)(\s|$)")
    first = p.groupBy("page_id", "to").agg(F.min_by(F.struct(quiet.alias("is_nofollow"), "a.anchor", (urls.host(F.col("to")) == urls.host(F.col("url"))).alias("is_internal")), "pos").alias("f"))
    return first.select("page_id", "to", "f.anchor", "f.is_nofollow", "f.is_internal").filter("anchor != 'Menu'")


def _resources(spark, d):
    p = pages(spark, d)
    return p, p.select("page_id", "url", F.explode(html.resources(F.col("html"))).alias("r")).select("page_id", "r.kind", html.resolve(F.col("url"), F.col("r.src")).alias("src"), "r.is_beacon").filter("src is not null").distinct()


def subresources(spark, d):
    _, r = _resources(spark, d)
    return r.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "script").alias("n_scripts"), F.count_if("is_beacon").alias("n_beacons"), F.count_if(F.col("kind") == "link").alias("n_links"))


def tracker_pages(spark, d):
    return trackers.classify(*_resources(spark, d))


def tracker_class(spark, d):
    """Status, multiplier and indicator of every page."""
    c = tracker_pages(spark, d)
    args = F.col("status"), F.col("n_trackers"), F.col("categories")
    shown = trackers.indicator(*args)
    return c.select("page_id", "status", "n_third_party", "n_trackers", F.array_join("categories", ",").alias("categories"), F.round(trackers.multiplier(*args, F.col("confidence")), 6).alias("multiplier"), shown["badge"].alias("badge"), shown["severity"].alias("severity"))


def reader_mode(spark, d):
    r = pages(spark, d).select("page_id", html.reader(F.col("html")).alias("r"))
    return r.select("page_id", "r.n_words", "r.minutes", F.contains("r.markdown", F.lit("## ")).alias("has_heading"), F.contains("r.markdown", F.lit("](")).alias("has_link"))


def html_privacy_audit(spark, d):
    issues = html.audit(F.col("html"))
    p = pages(spark, d).select("page_id", issues.alias("i"))
    return p.select("page_id", F.size("i").alias("n_issues"), F.size(F.filter("i", lambda x: x.startswith("script"))).alias("n_scripts"), (F.size("i") == 0).alias("is_compliant"))


# ---- robots and sitemaps


def _hosts(spark, d):
    """(host, segment): the hosts of links, each with its least and greatest first path segment."""
    e = table(spark, d, "link_edges").select(F.col("dst").alias("url")).filter(urls.validate(F.col("url")).isNull()).distinct()
    seg = F.regexp_extract(urls.part(F.col("url"), 4), "^/([A-Za-z0-9_-]+)", 1)
    return e.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min(F.nullif(seg, F.lit(""))).alias("low"), F.max(F.nullif(seg, F.lit(""))).alias("high"))


def robots_files(spark, d):
    """(host, content): a robots.txt for every host that links lead to: its least first path segment is closed but for its pages ending in
    .html, its greatest is closed where the path has a digit; another agent is kept out."""
    low, high = F.coalesce("low", F.lit("none")), F.coalesce("high", F.lit("none"))
    content = F.concat(F.lit("# made by rule\r\nDisallow: /orphan\r\nUser-agent: BadBot\nUser-agent: worse\nDisallow: /\n\nUser-agent: *\nDisallow: /"), low, F.lit("  # closed\nAllow: /"), low, F.lit("/*.html$\nDisallow: /"), high, F.lit("*7\nCrawl-delay: "),
                       (F.length("host") % 10).cast("string"), F.lit("\nDisallow:\nno colon\nSitemap: https://"), "host", F.lit("/sitemap.xml\n"))
    return _hosts(spark, d).select("host", content.alias("content"))


def robots_parse(spark, d):
    r = robots_files(spark, d).select("host", robots.parse(F.col("content")).alias("r"))
    g = robots.group_for(F.col("r.groups"), "quern")
    return r.select("host", F.size("r.groups").alias("n_groups"), F.size(g["rules"]).alias("n_rules"), g["delay"].alias("delay"), F.array_join("r.sitemaps", " ").alias("sitemaps"), F.col("r.warned").alias("warned"))


def robots_decision(spark, d):
    """Whether each link target may be fetched, by the rules of its host (parsed once a host)."""
    parsed = robots_files(spark, d).select("host", robots.parse(F.col("content")).alias("r"))
    rules = parsed.select("host", robots.group_for(F.col("r.groups"), "quern")["rules"].alias("rules"), robots.group_for(F.col("r.groups"), "BadBot/2")["rules"].alias("bad"))
    e = table(spark, d, "link_edges").select(F.col("dst").alias("url")).filter(urls.validate(F.col("url")).isNull()).distinct().withColumn("host", urls.host(F.col("url")))
    path = F.when(urls.part(F.col("url"), 4) == "", "/").otherwise(urls.part(F.col("url"), 4))
    return e.join(rules, "host").select("url", robots.allowed(F.col("rules"), path).alias("allowed"), robots.allowed(F.col("bad"), path).alias("bad_allowed"))


def sitemap_entries(spark, d):
    """Entries of sitemaps, which are made for every host in shards (first two characters of the id), half of them as XML, half as text."""
    v = _docs(spark, d).select("id", "url", urls.host(F.col("url")).alias("host"), F.substring("id", 1, 2).alias("shard"), F.date_format("last_modified", "yyyy-MM-dd").alias("m"))
    xml = F.concat(F.lit("<url>\n <loc>"), text.escape_html(F.col("url")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "m", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    is_xml = F.col("shard") < "8"
    g = v.groupBy("host", "shard").agg(F.when(is_xml, F.concat(F.lit("<?xml version='1.0'?><urlset xmlns='x'>"), F.array_join(F.sort_array(F.collect_list(xml)), ""), F.lit("</urlset>"))).otherwise(F.array_join(F.sort_array(F.collect_list("url")), "\n")).alias("content"))
    s = g.select("host", "shard", robots.sitemap(F.col("content")).alias("s"))
    return s.select("host", "shard", F.col("s.kind").alias("kind"), F.explode("s.entries").alias("e")).groupBy("host", "shard", "kind").agg(F.count("*").alias("n"), F.count("e.lastmod").alias("n_dated"), F.min("e.loc").alias("first"), F.max("e.loc").alias("last"))


def sitemap_frontier(spark, d):
    """Declared sitemaps into the crawl's queue: normalised addresses that no record has yet been crawled from."""
    from quern.operators import graph

    parsed = robots_files(spark, d).select("host", robots.parse(F.col("content")).alias("r"))
    maps = parsed.select(F.explode(F.when(F.size("r.sitemaps") > 0, F.col("r.sitemaps")).otherwise(F.array(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))))).alias("u"))
    seen = tables.docs(spark, d).select(urls.normalise(F.col("url")).alias("url"))
    found = table(spark, d, "link_edges").select(urls.normalise(F.col("dst")).alias("url"), "ord").filter("url is not null").unionByName(maps.select(urls.normalise(F.col("u")).alias("url"), F.lit(-1).cast("bigint").alias("ord")))
    return graph.frontier(found, seen)


# ---- guards


def redact_links(spark, d):
    """Every link target with parameters and a password put on it, redacted and stripped."""
    e = table(spark, d, "link_edges").select(F.col("dst").alias("u"), "ord").filter(~F.contains("u", F.lit("?")) & ~F.contains("u", F.lit("#")) & ~F.contains("u", F.lit("@")))
    full = F.concat(F.regexp_replace("u", "^([a-z]+)://", "$1://me:pw@"), F.lit("?page=2&token=a1&q=x"), F.lit("#top"))
    return e.select("ord", privacy.redact_url(full).alias("redacted"), privacy.strip_parameters(full).alias("stripped"), privacy.route(F.regexp_extract("u", "^[a-z]+://[^/]*(.*)$", 1)).alias("route"))


def anonymise_addresses(spark, d):
    """Addresses of both kinds, made of event numbers."""
    e = table(spark, d, "events").select("event_id")
    k = F.col("event_id")
    ip = F.when(k % 3 == 0, F.concat_ws(".", *[(k * m % 256).cast("string") for m in (1, 3, 5, 7)])).when(k % 3 == 1, F.concat(F.lower(F.hex(k % 65536)), F.lit(":db8:1:2::5"))).otherwise("unknown")
    return e.select("event_id", privacy.anonymise_ip(ip).alias("ip"))


def private_hosts(spark, d):
    """Addresses in five notations, made of event numbers, that must not be fetched."""
    e = table(spark, d, "events").select("event_id")
    k = F.col("event_id")
    octets = [k % 256, F.floor(k / 256) % 256, k * 3 % 256, k * 7 % 256]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    dotted = F.concat_ws(".", *[o.cast("string") for o in octets])
    form = F.when(k % 5 == 0, dotted).when(k % 5 == 1, number.cast("string")).when(k % 5 == 2, F.concat(F.lit("0x"), F.lower(F.hex(number)))).when(k % 5 == 3, F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(o.cast("string"), 10, 8)) for o in octets])).otherwise(F.concat(dotted, F.lit(".example.com")))
    return e.select("event_id", form.alias("host"), urls.is_private_host(form).alias("is_private"))


def personal_data(spark, d):
    """Kinds of personal data that may stand in the texts of documents."""
    t = table(spark, d, "documents").select("doc_id", privacy.personal(F.coalesce("text", F.lit(""))).alias("k"))
    return t.select("doc_id", F.array_join("k", ",").alias("kinds")).filter("kinds != ''")


def label_guard(spark, d):
    """Labels of metrics: keys in turn for every document, values from its columns."""
    keys = ["method", "status", "q", "Email", "zone", "path", "provider"]
    t = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("doc_id") % len(keys) + 1).cast("int")).alias("key"), F.when(F.col("doc_id") % 2 == 0, F.col("url")).when(F.col("doc_id") % 3 == 0, F.substring(F.coalesce("text", F.lit("")), 1, 80)).otherwise(F.col("source")).alias("v"))
    return t.select("doc_id", "key", privacy.label(F.col("key"), F.col("v")).alias("l")).select("doc_id", "key", "l.reason", "l.value")


def feedback_guard(spark, d):
    """Reasons to reject the feedback rows as payloads; every seventh carries a forbidden field, every fifth lacks consent."""
    f = tables.feedback(spark, d)
    h = F.conv(F.substring(F.md5("feedback_id"), 1, 6), 16, 10).cast("bigint")
    fields = F.struct(F.col("rating").alias("rating"), F.col("result_count_bucket").alias("resultCountBucket"), F.col("reason_code").alias("reasonCode"), F.when(h % 5 != 0, "true").alias("consent"), F.when(h % 7 == 0, "x").alias("Session_Id"))
    return f.select("feedback_id", F.array_join(privacy.feedback_errors(F.to_json(fields)), ",").alias("errors"))


def safe_urls(spark, d):
    e = table(spark, d, "link_edges").select("ord", "dst")
    made = F.when(F.col("ord") % 11 == 0, F.concat(F.lit("javascript:"), "dst")).when(F.col("ord") % 13 == 0, F.concat("dst", F.lit("\u0001"))).otherwise(F.col("dst"))
    return e.select("ord", privacy.safe_image_url(made).isNotNull().alias("image_ok"), (privacy.safe_source_url(made) != "#").alias("source_ok"))


QUERIES = {f.__name__: f for f in (html_parse, html_links, subresources, tracker_class, reader_mode, html_privacy_audit, robots_parse, robots_decision, sitemap_entries, sitemap_frontier, redact_links, anonymise_addresses, private_hosts, personal_data, label_guard, feedback_guard, safe_urls)}

VALID = f"""v AS MATERIALIZED (SELECT d.*, l.outbound_links, length(coalesce(d.title, '')) AS n FROM docs d JOIN (SELECT id, outbound_links FROM (SELECT id, outbound_links, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, index_status DESC NULLS LAST, last_modified DESC NULLS LAST, url DESC NULLS LAST) AS k FROM raw_documents) WHERE k = 1) l USING (id) WHERE {S.reject('d.url')} IS NULL)"""
FLAT = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
TEXT = FLAT
PICKS = f"list_transform(range(1, n % 7 + 1), lambda i: [{', '.join(S.q(x) for x in DOMAINS)}][((n + i) % {len(DOMAINS)} + 1)::INT])"
KINDS = "CASE x " + " ".join(f"WHEN {S.q(k)} THEN {S.q(c)}" for k, c in trackers.TRACKERS.items()) + " END"
LINKS = f"""u AS (SELECT id, url, n, unnest(outbound_links) AS to_raw, generate_subscripts(outbound_links, 1) - 1 AS pos FROM v)"""
SEGMENT = f"nullif(regexp_extract({S.part('url', 4)}, '^/([A-Za-z0-9_-]+)', 1), '')"
HOSTS = f"""targets AS MATERIALIZED (SELECT DISTINCT dst AS url FROM link_edges WHERE {S.reject('dst')} IS NULL), hosts AS MATERIALIZED (SELECT {S.host('url')} AS host, coalesce(min({SEGMENT}), 'none') AS low, coalesce(max({SEGMENT}), 'none') AS high FROM targets GROUP BY 1)"""
TRACKED = f"""t AS MATERIALIZED (SELECT id, {S.host('url')} AS h, n, {PICKS} AS picks FROM v)"""
ROUTES = ", ".join(S.q(r) for r in privacy.EXACT_ROUTES)

ORACLE = {
    "html_parse": f"""WITH {S.DOCS}, {VALID} SELECT id AS page_id, left({TEXT('title')}, 300) AS title, left({TEXT('description')}, 1000) AS description, {S.norm_url('url')} AS canonical, CASE WHEN regexp_matches(lower(left(coalesce(language, ''), 2)), '^[a-z]{{2,3}}$') THEN lower(left(language, 2)) ELSE '' END AS language,
        len(hs) AS n_headings, array_to_string(list_filter(list_transform(hs, lambda h: {TEXT('h')}), lambda h: h <> ''), ' ') AS headings,
        md5(array_to_string(list_filter(list_concat(list_transform(hs, lambda h: {TEXT('h')}), list_transform(string_split(coalesce(body_text, ''), chr(10)), lambda x: {TEXT('x')})), lambda x: x <> ''), chr(10))) AS body_md5, n % 4 = 0 AS is_nofollow
        FROM (SELECT *, list_filter(string_split(coalesce(headings, ''), chr(10)), lambda h: trim(h) <> '') AS hs FROM v)""",
    "html_links": f"""WITH {S.DOCS}, {VALID}, {LINKS}, r AS (SELECT id, url, n, pos, {S.norm_url('to_raw')} AS t FROM u WHERE {S.reject('to_raw')} IS NULL), f AS (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY pos) AS k FROM r)
        SELECT id AS page_id, t AS "to", 'Link ' || pos || ' & more' AS anchor, n % 4 = 0 OR pos % 5 = 0 AS is_nofollow, {S.host('t')} = {S.host('url')} AS is_internal FROM f WHERE k = 1""",
    "subresources": f"WITH {S.DOCS}, {VALID} SELECT id AS page_id, n % 7 + 3 AS n, n % 7 + 1 AS n_scripts, 1 AS n_beacons, 1 AS n_links FROM v",
    "tracker_class": f"""WITH {S.DOCS}, {VALID}, {TRACKED}, c AS (SELECT id, n % 7 + 1 AS n_trackers, list_sort(list_distinct(list_transform(list_concat(picks, [{S.q(DOMAINS[0])}]), lambda x: {KINDS}))) AS cs FROM t), g AS (SELECT *, list_has_any(cs, ['fingerprinting', 'session-recording']) OR n_trackers >= 5 AS heavy FROM c)
        SELECT id AS page_id, 'trackers_detected' AS status, n_trackers AS n_third_party, n_trackers, array_to_string(cs, ',') AS categories, CASE WHEN heavy THEN 0.955 ELSE 0.9775 END AS multiplier,
        CASE WHEN n_trackers = 1 THEN '1 Tracker Detected' ELSE n_trackers || ' Trackers Detected' END AS badge, CASE WHEN heavy THEN 'alert' ELSE 'warning' END AS severity FROM g""",
    "html_privacy_audit": f"""WITH {S.DOCS}, {VALID}, {TRACKED}, w AS (SELECT t.id, n, picks, lower(concat_ws(' ', d.title, d.description, d.headings, d.body_text, d.url, array_to_string(v2.outbound_links, ' '))) AS full_text FROM t JOIN docs d USING (id) JOIN (SELECT id, outbound_links FROM v) v2 USING (id)), i AS (SELECT id, n % 7 AS n_scripts,
        len(list_filter([{', '.join(S.q(a) for a in html.ANALYTICS)}], lambda a: contains(full_text, a) OR contains(array_to_string(picks, ' ') || ' {DOMAINS[0]}', a))) AS n_traces FROM w)
        SELECT id AS page_id, n_scripts + n_traces + 1 AS n_issues, n_scripts, false AS is_compliant FROM i""",
    "robots_parse": f"WITH {HOSTS} SELECT host, 2 AS n_groups, 4 AS n_rules, (length(host) % 10)::DOUBLE AS delay, 'https://' || host || '/sitemap.xml' AS sitemaps, true AS warned FROM hosts",
    "robots_decision": f"""WITH {HOSTS}, p AS (SELECT url, low, high, CASE WHEN {S.part('url', 4)} = '' THEN '/' ELSE {S.part('url', 4)} END AS path FROM targets JOIN hosts ON {S.host('url')} = host),
        m AS (SELECT url, CASE WHEN starts_with(path, '/' || low) THEN length(low) + 1 ELSE 0 END AS closed, CASE WHEN starts_with(path, '/' || low || '/') AND ends_with(path, '.html') AND length(path) >= length(low) + 7 THEN length(low) + 9 ELSE 0 END AS opened,
        CASE WHEN starts_with(path, '/' || high) AND contains(substr(path, length(high) + 2), '7') THEN length(high) + 3 ELSE 0 END AS digit FROM p)
        SELECT url, greatest(closed, digit) = 0 OR opened >= greatest(closed, digit) AS allowed, false AS bad_allowed FROM m""",
    "sitemap_entries": f"""WITH {S.DOCS}, {VALID} SELECT {S.host('url')} AS host, left(id, 2) AS shard, CASE WHEN left(id, 2) < '8' THEN 'urlset' ELSE 'text' END AS kind, count(*) AS n, count(CASE WHEN left(id, 2) < '8' THEN last_modified END) AS n_dated, min(trim(url)) AS "first", max(trim(url)) AS "last" FROM v GROUP BY 1, 2, 3""",
    "sitemap_frontier": f"""WITH {S.DOCS}, {HOSTS}, c AS (SELECT {S.norm_url('dst')} AS url, ord FROM link_edges UNION ALL SELECT 'https://' || host || '/sitemap.xml', -1 FROM hosts) SELECT url, min(ord) AS seq FROM c WHERE url IS NOT NULL AND url NOT IN (SELECT {S.norm_url('url')} FROM docs WHERE {S.norm_url('url')} IS NOT NULL) GROUP BY url""",
    "redact_links": f"""WITH e AS (SELECT ord, dst AS u, regexp_replace(dst, '^([a-z]+)://', '\\1://me:pw@') AS w, regexp_replace(dst, '^([a-z]+)://', '\\1://me:[REDACTED]@') AS r, regexp_replace(regexp_replace(regexp_extract(dst, '^[a-z]+://[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '') AS p FROM link_edges WHERE NOT contains(dst, '?') AND NOT contains(dst, '#') AND NOT contains(dst, '@'))
        SELECT ord, r || '?page=2&token=[REDACTED]&q=[REDACTED]#top' AS redacted, w AS stripped, CASE WHEN p = '' OR p IN ({ROUTES}) THEN CASE WHEN p = '' THEN '/' ELSE p END WHEN starts_with(p, '/static/') OR starts_with(p, '/assets/') THEN '/static/:file' ELSE '/other' END AS route FROM e""",
    "anonymise_addresses": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat_ws('.', event_id % 256, event_id * 3 % 256, event_id * 5 % 256, 0) WHEN 1 THEN lower(printf('%x', event_id % 65536)) || ':db8:1::' ELSE '0.0.0.0' END AS ip FROM events",
    "private_hosts": """WITH e AS (SELECT event_id, event_id % 256 AS a, (event_id // 256) % 256 AS b, event_id * 3 % 256 AS c, event_id * 7 % 256 AS d FROM events), n AS (SELECT *, a * 16777216::BIGINT + b * 65536 + c * 256 + d AS num, concat_ws('.', a, b, c, d) AS dotted FROM e)
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN dotted WHEN 1 THEN num::VARCHAR WHEN 2 THEN '0x' || printf('%x', num) WHEN 3 THEN concat_ws('.', '0' || printf('%o', a), '0' || printf('%o', b), '0' || printf('%o', c), '0' || printf('%o', d)) ELSE dotted || '.example.com' END AS host,
        event_id % 5 <> 4 AND (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0) OR (a = 198 AND b IN (18, 19))) AS is_private FROM n""",
    "label_guard": """WITH l AS (SELECT doc_id, ['method', 'status', 'q', 'Email', 'zone', 'path', 'provider'][(doc_id % 7 + 1)::INT] AS key, CASE WHEN doc_id % 2 = 0 THEN url WHEN doc_id % 3 = 0 THEN left(coalesce(text, ''), 80) ELSE source END AS v FROM documents),
        r AS (SELECT *, CASE WHEN key IN ('q', 'Email') THEN 'forbidden' WHEN key = 'zone' THEN 'unapproved' END AS reason FROM l) SELECT doc_id, key, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN length(v) > 64 THEN left(v, 60) || '...' WHEN regexp_matches(v, '[?&]|https?://') THEN '[REDACTED_URL_OR_QUERY]'
        WHEN contains(v, '@') AND contains(v, '.') THEN '[REDACTED_EMAIL]' ELSE v END AS value FROM r""",
    "feedback_guard": f"""WITH {S.FEEDBACK}, h AS (SELECT *, ('0x' || left(md5(feedback_id), 6))::BIGINT AS h FROM fb) SELECT feedback_id, concat_ws(',', CASE WHEN h % 7 = 0 THEN 'forbidden' END, CASE WHEN rating IN ('helpful', 'not_helpful') THEN NULL ELSE 'rating' END,
        CASE WHEN coalesce(result_count_bucket, '0') NOT IN ('0', '1-5', '6-10', '10+') THEN 'bucket' END, CASE WHEN coalesce(reason_code, 'other') NOT IN ({', '.join(S.q(r) for r in privacy.REASONS)}) THEN 'reason' END, CASE WHEN h % 5 = 0 THEN 'consent' END) AS errors FROM h""",
    "safe_urls": f"""WITH e AS (SELECT ord, trim(CASE WHEN ord % 11 = 0 THEN 'javascript:' || dst WHEN ord % 13 = 0 THEN dst || chr(1) ELSE dst END) AS u FROM link_edges) SELECT ord, coalesce(length(u) BETWEEN 1 AND 4096 AND NOT regexp_matches(u, '[\\x00-\\x1f\\x7f]') AND {S.scheme('u')} IN ('http', 'https') AND {S.host('u')} <> '', false) AS image_ok,
        coalesce({S.scheme('u')} IN ('http', 'https') AND {S.host('u')} <> '', false) AS source_ok FROM e""",
}
