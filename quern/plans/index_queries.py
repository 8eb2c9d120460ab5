"""Queries on scans, tokens and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import index, store
from quern.plans import sqltext as S
from quern.runtime import numbered, table
from quern.sources import tables


def _index(spark, d):
    documents = tables.docs(spark, d)
    return index.postings(documents), index.doc_meta(documents)


def paged_scan(spark, d):
    return tables.docs(spark, d).select("id", "url").orderBy("id").offset(50).limit(25)


def status_scan(spark, d):
    return tables.docs(spark, d).filter("index_status = 'pending'").select("id", "index_status", "language")


def run_statistics(spark, d):
    return tables.docs(spark, d).groupBy("index_status").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("body_text", F.lit(""))) == "").alias("n_blank"), F.max("crawled_at").alias("last_crawl"))


def tokens_by_field(spark, d):
    return tables.tokens(tables.docs(spark, d)).groupBy("field").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"), F.max("position").alias("max_position"))


def postings(spark, d):
    return index.postings(tables.docs(spark, d))


def term_positions(spark, d):
    p = index.positions(tables.docs(spark, d))
    return p.select("term", "id", "field", F.size("positions").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


def dictionary(spark, d):
    return index.dictionary(index.postings(tables.docs(spark, d)))


def index_stats(spark, d):
    s = index.stats(*_index(spark, d))
    return s.select("n_documents", "n_terms", "n_postings", *[text.round_half_up(F.col(c), 4).alias(c) for c in ("avg_title", "avg_headings", "avg_description", "avg_body", "avg_length")])


def index_checksum(spark, d):
    return index.checksum(*_index(spark, d))


def index_integrity(spark, d):
    return index.integrity(*_index(spark, d))


def doc_fingerprint(spark, d):
    return index.fingerprints(tables.docs(spark, d))


def corpus_quality(spark, d):
    return index.quality(tables.docs(spark, d))


def corpus_ingest(spark, d):
    """Validated documents, first id of each content hash, counted by host."""
    from quern.functions import urls

    v = tables.docs(spark, d).filter(urls.validate(F.col("url")).isNull() & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("body_text", F.lit(""))) != ""))
    first = v.groupBy(F.coalesce("content_hash", F.col("id")).alias("key")).agg(F.min(F.struct("id", "url")).alias("x"), F.count("*").alias("n"))
    return first.groupBy(urls.host(F.col("x.url")).alias("host")).agg(F.count("*").alias("n_documents"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def incremental_delta(spark, d):
    """The active index is taken to hold the documents with the status indexed, stale or error; of the stale ones an older version."""
    documents = tables.docs(spark, d)
    prints = index.fingerprints(documents)
    known = documents.filter(F.col("index_status").isin("indexed", "stale", "error")).select("id", "index_status").join(prints, "id")
    active = known.select("id", F.when((F.col("index_status") == "stale") & (F.substring("id", 1, 1) < "8"), "older").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return index.incremental(documents, active)


def _segments(documents):
    """Three segments: every document in segment 1 or 2 by its id, ids beginning with a digit again in segment 3 with changed counts. Both
    rows of a posting are made side by side, so that texts are read once and nothing is united."""
    base = F.struct(F.when(F.substring("id", 1, 1) < "8", 1).otherwise(2).alias("segment_seq"), F.col("tf").alias("tf"))
    again = F.struct(F.lit(3).alias("segment_seq"), (F.col("tf") + 1).alias("tf"))
    both = F.explode(F.when(F.substring("id", 1, 1) < "4", F.array(base, again)).otherwise(F.array(base))).alias("x")
    dead = documents.select("id").filter(F.substring("id", 2, 1) == "0").select(F.lit(2).alias("segment_seq"), "id")
    return index.postings(documents).select("id", "term", both).select("x.segment_seq", "id", "term", "x.tf"), dead


def segment_merge(spark, d):
    return index.merge_segments(*_segments(tables.docs(spark, d))).groupBy("segment_seq", "id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("total_tf"))


def skip_blocks(spark, d):
    return index.block_max(index.postings(tables.docs(spark, d)))


def posting_codec(spark, d):
    """Posting lists as gaps of document numbers in seven-bit groups: encoded, decoded again, and compared in bytes with four-byte numbers.
    Numbers are the first seven hex digits of an id, which keep the order of ids without a global sort; gaps restart every 128
    postings, so that no list is one window."""
    number = F.conv(F.substring(F.regexp_replace("id", "-", ""), 1, 7), 16, 10).cast("bigint")
    p = numbered(store.opened(spark, d).postings.select("term", number.alias("n")), "term", "n").withColumn("block", F.floor(F.col("number") / 128))
    blocks = p.groupBy("term", "block").agg(F.sort_array(F.collect_list("n")).alias("list"))
    gaps = F.transform("list", lambda x, i: x - F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("list"), i - 1)))
    coded = blocks.select("term", "list", index.encode_gaps(gaps).alias("bytes"))
    size = F.length("bytes")
    back = F.transform(index.decode_gaps(F.col("bytes")), lambda x: x)
    same = F.aggregate(back, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("at")), lambda acc, g: F.struct(F.array_append(acc["out"], acc["at"] + g).alias("out"), (acc["at"] + g).alias("at")))["out"] == F.col("list")
    return coded.select("term", F.size("list").alias("n"), size.alias("b"), same.alias("same")).groupBy("term").agg(F.sum("n").alias("df"), F.sum("b").alias("gap_bytes"), (F.sum("n") * 4).alias("plain_bytes"), F.bool_and("same").alias("decodes"))


def suggest(spark, d):
    """Suggestions for the first one to four letters of the first word of every search query, in any script."""
    words = store.opened(spark, d).dictionary
    first = F.regexp_extract(text.normalise(F.coalesce("raw_query", F.lit(""))), r"([\p{L}\p{N}]+)", 1)
    prefixes = tables.queries(spark, d).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring(first, F.lit(1), n))).alias("prefix"))
    return index.suggestions(words, prefixes)


QUERIES = {f.__name__: f for f in (paged_scan, status_scan, run_statistics, tokens_by_field, postings, term_positions, dictionary, index_stats, index_checksum, index_integrity, doc_fingerprint, corpus_quality, corpus_ingest,
                                   incremental_delta, segment_merge, skip_blocks, posting_codec, suggest)}

BLANK = "trim(coalesce(body_text, '')) = ''"
LOWER = "trim(regexp_replace(lower({}), '[ \\t\\r\\n\\f]+', ' ', 'g'))"
C4 = [f"coalesce({c}, '')" for c in ("title", "headings", "description", "body_text")]
PLAIN = [f"coalesce({c}, '')" for c in ("title", "description", "headings", "body_text")]
PRINTS = f"prints AS (SELECT id, coalesce(nullif(trim(content_hash), ''), sha256({LOWER.format(' || chr(10) || '.join(C4))})) AS fingerprint, sha256({' || chr(10) || '.join(PLAIN)}) AS content_sha FROM docs)"
HAS = lambda c: f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN 1.0 ELSE 0.0 END"
NWORDS = "len(list_filter(string_split(trim(regexp_replace(coalesce(body_text, ''), '[ \\t\\r\\n\\f]+', ' ', 'g')), ' '), lambda w: w <> ''))"

NORM = S.NORMALISED.replace("left(coalesce(raw_query, ''), 200)", "coalesce(raw_query, '')")
ORACLE = {
    "paged_scan": f"WITH {S.DOCS} SELECT id, url FROM docs ORDER BY id LIMIT 25 OFFSET 50",
    "status_scan": f"WITH {S.DOCS} SELECT id, index_status, language FROM docs WHERE index_status = 'pending'",
    "run_statistics": f"WITH {S.DOCS} SELECT index_status, count(*) AS n, count(*) FILTER ({BLANK}) AS n_blank, max(crawled_at) AS last_crawl FROM docs GROUP BY index_status",
    "tokens_by_field": f"WITH {S.DOCS}, {S.TOKENS} SELECT field, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, max(position) AS max_position FROM tokens GROUP BY field",
    "postings": f"WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS} SELECT *, 3.0 * tf_title + 2.0 * tf_headings + 1.5 * tf_description + tf_body AS weighted FROM postings",
    "term_positions": f"WITH {S.DOCS}, {S.TOKENS} SELECT term, id, field, count(*) AS n, min(position) AS first, max(position) AS last FROM tokens GROUP BY term, id, field",
    "dictionary": f"WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS} SELECT term, df, total_tf FROM dictionary",
    "index_stats": f"WITH {S.INDEX} SELECT n_documents, (SELECT count(*) FROM dictionary) AS n_terms, (SELECT count(*) FROM postings) AS n_postings, "
    + ", ".join(f"{S.r(c, 4)} AS {c}" for c in ("avg_title", "avg_headings", "avg_description", "avg_body", "avg_length")) + " FROM stats",
    "index_checksum": f"""WITH {S.INDEX}, e AS (SELECT 'd' AS kind, sha256(id) AS h FROM meta UNION ALL SELECT 't', sha256(term || ':' || df) FROM dictionary),
        parts AS (SELECT kind, left(h, 2) AS bucket, sha256(string_agg(h, '|' ORDER BY h)) AS digest, count(*) AS n FROM e GROUP BY ALL)
        SELECT sum(n) FILTER (kind = 'd') AS n_documents, sum(n) FILTER (kind = 't') AS n_terms, sha256(string_agg(kind || ':' || bucket || ':' || digest, '|' ORDER BY kind || ':' || bucket || ':' || digest)) AS checksum FROM parts""",
    "index_integrity": f"""WITH {S.INDEX} SELECT 'orphan_postings' AS "check", count(*) AS n_issues FROM postings WHERE id NOT IN (SELECT id FROM meta)
        UNION ALL SELECT 'duplicate_documents', count(*) FROM (SELECT id FROM meta GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'documents_without_terms', count(*) FROM meta WHERE id NOT IN (SELECT id FROM postings)
        UNION ALL SELECT 'length_mismatch', count(*) FROM (SELECT id, sum(tf) AS s FROM postings GROUP BY id) JOIN meta USING (id) WHERE s <> total_terms""",
    "doc_fingerprint": f"WITH {S.DOCS}, {PRINTS} SELECT * FROM prints",
    "corpus_quality": f"""WITH {S.DOCS}, k AS (SELECT id, sha256({LOWER.format("coalesce(body_text, '')")}) AS key, {NWORDS} AS n_words,
        {S.r(f"0.3 * {HAS('title')} + 0.15 * {HAS('description')} + 0.15 * {HAS('headings')} + 0.4 * least(1.0, {NWORDS} / 50.0)", 4)} AS score, {NWORDS} < 10 AND trim(coalesce(title, '')) = '' AS is_thin FROM docs)
        SELECT id, n_words, score, id <> min(id) OVER (PARTITION BY key) AS is_duplicate, is_thin FROM k""",
    "corpus_ingest": f"""WITH {S.DOCS}, f AS (SELECT coalesce(content_hash, id) AS key, min({{'id': id, 'url': url}}) AS x, count(*) AS n FROM docs
        WHERE {S.reject('url')} IS NULL AND trim(coalesce(title, '')) <> '' AND trim(coalesce(body_text, '')) <> '' GROUP BY 1) SELECT {S.host('x.url')} AS host, count(*) AS n_documents, sum(n - 1) AS n_duplicates FROM f GROUP BY 1""",
    "incremental_delta": f"""WITH {S.DOCS}, {PRINTS}, active AS (SELECT id, CASE WHEN index_status = 'stale' AND left(id, 1) < '8' THEN 'older' ELSE fingerprint END AS old FROM docs JOIN prints USING (id) WHERE index_status IN ('indexed', 'stale', 'error'))
        SELECT id, CASE WHEN old IS NULL THEN 'indexed' WHEN old <> fingerprint THEN 'updated' ELSE 'skipped' END AS action FROM docs JOIN prints USING (id) LEFT JOIN active USING (id) WHERE index_status IN ('pending', 'stale', 'not_indexed')""",
    "segment_merge": f"""WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS}, seg AS (SELECT CASE WHEN left(id, 1) < '8' THEN 1 ELSE 2 END AS segment_seq, id, term, tf FROM postings UNION ALL SELECT 3, id, term, tf + 1 FROM postings WHERE left(id, 1) < '4'),
        latest AS (SELECT id, max(segment_seq) AS segment_seq FROM seg GROUP BY id) SELECT segment_seq, id, count(*) AS n_terms, sum(tf) AS total_tf FROM seg JOIN latest USING (id, segment_seq)
        WHERE NOT (substr(id, 2, 1) = '0' AND segment_seq <= 2) GROUP BY segment_seq, id""",
    "skip_blocks": f"""WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS}, b AS (SELECT term, id, tf, (row_number() OVER (PARTITION BY term ORDER BY id) - 1) // 16 AS block FROM postings)
        SELECT term, block, min(id) AS first_id, max(id) AS last_id, count(*) AS n, max(tf) AS max_tf FROM b GROUP BY term, block""",
    "posting_codec": f"""WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS}, p AS (SELECT term, ('0x' || left(replace(id, '-', ''), 7))::BIGINT AS n FROM postings), o AS (SELECT term, n, row_number() OVER (PARTITION BY term ORDER BY n) - 1 AS k FROM p),
        g AS (SELECT term, n - CASE WHEN k % 128 = 0 THEN 0 ELSE lag(n) OVER (PARTITION BY term ORDER BY n) END AS gap FROM o)
        SELECT term, count(*) AS df, sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END) AS gap_bytes, count(*) * 4 AS plain_bytes, true AS decodes FROM g GROUP BY term""",
    "suggest": f"""WITH {S.DOCS}, {S.TOKENS}, {S.POSTINGS}, pre AS (SELECT DISTINCT left(w, n) AS prefix FROM (SELECT regexp_extract({NORM}, '([\\p{{L}}\\p{{N}}]+)', 1) AS w FROM search_queries) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n)),
        s AS (SELECT prefix, term, greatest(10.0, df * 5.0) + 50 + CASE WHEN term = prefix THEN 100 ELSE 0 END + greatest(0.0, 20 - 0.5 * length(term)) AS score FROM dictionary JOIN pre ON prefix <> '' AND starts_with(term, prefix) WHERE length(term) <= 64)
        SELECT * FROM (SELECT prefix, term, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5""",
}
