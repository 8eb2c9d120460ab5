"""Pieces of SQL that the SQL twins of the queries share."""

from __future__ import annotations

from quern.functions import text, urls
from quern.operators import search


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FOLD_FROM, FOLD_TO = text.fold_table()
STOP = ", ".join(q(w) for w in text.STOP_WORDS)

DOCS = """docs AS MATERIALIZED (SELECT * EXCLUDE (nth) FROM (SELECT id, url, title, headings, description, body_text, language, content_hash, last_modified, crawled_at, index_status,
 row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, index_status DESC NULLS LAST, last_modified DESC NULLS LAST, url DESC NULLS LAST) AS nth FROM raw_documents) WHERE nth = 1)"""


def tokens(column: str, stop: bool = True) -> str:
    """List of kept tokens of a column."""
    words = f"list_transform(regexp_extract_all(coalesce({column}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(translate(w, {q(FOLD_FROM)}, {q(FOLD_TO)})))"
    return f"list_filter({words}, lambda w: length(w) BETWEEN 1 AND 64" + (f" AND w NOT IN ({STOP}))" if stop else ")")


def _field(name: str, column: str) -> str:
    return f"SELECT id, '{name}' AS field, unnest(ws) AS w, generate_subscripts(ws, 1) AS o FROM (SELECT id, regexp_extract_all(coalesce({column}, ''), '[\\p{{L}}\\p{{N}}]+') AS ws FROM docs)"


TOKENS = f"""words AS MATERIALIZED ({' UNION ALL '.join(_field(n, c) for n, c in (('title', 'title'), ('headings', 'headings'), ('description', 'description'), ('body', 'body_text')))}),
forms AS MATERIALIZED (SELECT w, lower(translate(w, {q(FOLD_FROM)}, {q(FOLD_TO)})) AS term FROM (SELECT DISTINCT w FROM words)),
folded AS (SELECT id, field, o, term FROM words JOIN forms USING (w)),
tokens AS MATERIALIZED (SELECT id, field, term, row_number() OVER (PARTITION BY id, field ORDER BY o) - 1 AS position FROM folded WHERE length(term) BETWEEN 1 AND 64 AND term NOT IN ({STOP}))"""

POSTINGS = """postings AS MATERIALIZED (SELECT term, id, count(*) AS tf, count(*) FILTER (field = 'title') AS tf_title, count(*) FILTER (field = 'headings') AS tf_headings,
 count(*) FILTER (field = 'description') AS tf_description, count(*) FILTER (field = 'body') AS tf_body FROM tokens GROUP BY term, id),
dictionary AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM postings GROUP BY term)"""

META = """sizes AS MATERIALIZED (SELECT id, count(*) FILTER (field = 'title') AS len_title, count(*) FILTER (field = 'headings') AS len_headings, count(*) FILTER (field = 'description') AS len_description,
 count(*) FILTER (field = 'body') AS len_body, count(*) AS total_terms FROM tokens GROUP BY id),
meta AS MATERIALIZED (SELECT id, url, title, description, language, last_modified, crawled_at, @HOST@ AS host, @PATH@ AS path, coalesce(len_title, 0) AS len_title, coalesce(len_headings, 0) AS len_headings, coalesce(len_description, 0) AS len_description,
 coalesce(len_body, 0) AS len_body, coalesce(total_terms, 0) AS total_terms FROM docs LEFT JOIN sizes USING (id)
 WHERE trim(coalesce(title, '')) <> '' OR trim(coalesce(headings, '')) <> '' OR trim(coalesce(description, '')) <> '' OR trim(coalesce(body_text, '')) <> ''),
stats AS MATERIALIZED (SELECT count(*) AS n_documents, sum(len_title) / count(*) AS avg_title, sum(len_headings) / count(*) AS avg_headings, sum(len_description) / count(*) AS avg_description,
 sum(len_body) / count(*) AS avg_body, sum(total_terms) / count(*) AS avg_length FROM meta)"""


PART = urls.PARTS


def part(column: str, number: int) -> str:
    return f"regexp_extract(trim({column}), {q(PART)}, {number})"


def host(column: str) -> str:
    return f"lower({part(column, 2)})"


def scheme(column: str) -> str:
    return f"lower({part(column, 1)})"


def norm_url(column: str) -> str:
    s, h, port, path, query = scheme(column), host(column), part(column, 3), part(column, 4), part(column, 5)
    slim = f"regexp_replace({path}, '/{{2,}}', '/', 'g')"
    pairs = f"list_filter(string_split({query}, '&'), lambda x: x <> '')"
    keyed = f"list_sort(list_transform({pairs}, lambda x, i: {{'k': string_split(x, '=')[1], 'i': i, 'v': x}}))"
    joined = f"array_to_string(list_transform({keyed}, lambda x: x.v), '&')"
    return (f"CASE WHEN {h} <> '' AND {s} <> '' THEN {s} || '://' || {h} || CASE WHEN {port} = '' OR ({s} = 'http' AND {port} = '80') OR ({s} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
            f" || CASE WHEN {slim} IN ('', '/') THEN '/' ELSE regexp_replace({slim}, '/$', '') END || CASE WHEN coalesce({joined}, '') = '' THEN '' ELSE '?' || {joined} END END")  # fmt: skip


def private(h: str) -> str:
    return (f"(regexp_matches({h}, '^(?:(?:0|10|127|22[4-9]|2[34]\\d|25[0-5])\\.|192\\.168\\.|192\\.0\\.0\\.|169\\.254\\.|198\\.1[89]\\.|100\\.(?:6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])\\.|172\\.(?:1[6-9]|2\\d|3[01])\\.)') OR regexp_matches({h}, '^(?:localhost|.*\\.localhost|.*\\.local|.*\\.internal|.*\\.lan|.*\\.intranet|.*\\.corp|.*\\.home)$')"
            f" OR regexp_matches({h}, '^\\[?(?:::1|fc|fd|fe80)'))")  # fmt: skip


def reject(column: str) -> str:
    u = f"trim(coalesce({column}, ''))"
    return f"CASE WHEN {u} = '' THEN 'empty' WHEN length({u}) > 2048 THEN 'too_long' WHEN {scheme(u)} NOT IN ('http', 'https') THEN 'scheme' WHEN {host(u)} = '' THEN 'host' WHEN {private(host(u))} THEN 'private' END"


META = META.replace("@HOST@", host("url")).replace("@PATH@", f"lower({part('url', 4)})")
INDEX = f"{DOCS}, {TOKENS}, {POSTINGS}, {META}"
EDGES = f"""raw_edges AS MATERIALIZED (SELECT *, {reject('src')} AS bad_src, {reject('dst')} AS bad_dst, {norm_url('src')} AS s, {norm_url('dst')} AS d FROM link_edges),
edges AS MATERIALIZED (SELECT s AS src, d AS dst, min_by(anchor, ord) FILTER (anchor IS NOT NULL) AS some_anchor, count(*) AS n FROM raw_edges WHERE bad_src IS NULL AND bad_dst IS NULL AND NOT coalesce(is_nofollow, false) AND s <> d GROUP BY s, d)"""

SITE = lambda c: f"nullif(regexp_replace(regexp_extract(lower(trim({c})), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '')"

NORMALISED = f"trim(regexp_replace(lower(translate(regexp_replace(left(coalesce(raw_query, ''), 200), '[\\x00-\\x1F\\x7F]', ' ', 'g'), {q(FOLD_FROM)}, {q(FOLD_TO)})), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
WORDS = lambda c: f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+')"

PARSED = f"""p1 AS (SELECT query_id, coalesce(raw_query, '') AS raw, {NORMALISED} AS q FROM search_queries),
p2 AS (SELECT *, nullif(regexp_extract(q, '(?:^|\\s)site:(\\S+)', 1), '') AS site, nullif(regexp_extract(q, '(?:^|\\s)filetype:([a-z0-9]+)', 1), '') AS filetype,
 regexp_extract_all(q, '(?:^|\\s)intitle:([^\\s"'']+)', 1) AS intitle, regexp_extract_all(q, '(?:^|\\s)exact:([^\\s"'']+)', 1) AS exact,
 regexp_replace(q, '(?:^|\\s)(?:site|filetype|intitle|exact):\\S+', ' ', 'g') AS rest FROM p1),
p3 AS (SELECT *, regexp_extract_all(rest, '"([^"]+)"', 1) AS quoted, regexp_replace(rest, '"[^"]+"', ' ', 'g') AS rest3 FROM p2),
p4 AS (SELECT *, regexp_extract_all(rest3, '(?:^|\\s)(?:-|not\\s+)([\\p{{L}}\\p{{N}}]+)', 1) AS negated, regexp_replace(rest3, '(?:^|\\s)(?:-|not\\s+)[\\p{{L}}\\p{{N}}]+', ' ', 'g') AS rest4 FROM p3),
p5 AS (SELECT *, regexp_replace(rest4, '([\\p{{L}}\\p{{N}}])[-_][\\p{{L}}\\p{{N}}_-]+', '\\1', 'g') AS rest5 FROM p4),
p6 AS (SELECT *, list_concat(list_concat(list_concat({WORDS('rest5')}, flatten(list_transform(quoted, lambda x: {WORDS('x')}))), flatten(list_transform(intitle, lambda x: {WORDS('x')}))), flatten(list_transform(exact, lambda x: {WORDS('x')}))) AS all_terms FROM p5),
parsed AS MATERIALIZED (SELECT query_id, list_distinct(all_terms) AS terms, list_filter(list_transform(quoted, lambda x: {WORDS('x')}), lambda p: len(p) > 0) AS phrases, negated, site, filetype, intitle, length(raw) > 200 AS is_clamped,
 len(all_terms) = 0 AND site IS NULL AND filetype IS NULL AS is_empty FROM p6),
query_terms AS MATERIALIZED (SELECT query_id, unnest(terms) AS term, 1.0::DOUBLE AS weight FROM parsed)"""

MATCHES = f"""negative AS MATERIALIZED (SELECT DISTINCT n.query_id, p.id FROM (SELECT query_id, unnest(negated) AS term FROM parsed) n JOIN postings p USING (term)),
matches AS MATERIALIZED (SELECT p.term, p.id, t.query_id, t.weight, p.tf, p.tf_title, p.tf_headings, p.tf_description, p.tf_body, m.url, m.title, m.len_title, m.len_headings, m.len_description, m.len_body, m.last_modified, m.crawled_at
 FROM postings p JOIN query_terms t USING (term) JOIN meta m USING (id) JOIN parsed q USING (query_id)
 WHERE (q.site IS NULL OR m.host = q.site OR ends_with(m.host, '.' || q.site)) AND (q.filetype IS NULL OR ends_with(m.path, '.' || q.filetype))
 AND len(list_filter(q.intitle, lambda w: NOT contains(lower(coalesce(m.title, '')), w))) = 0 AND (t.query_id, p.id) NOT IN (SELECT query_id, id FROM negative)),
candidates AS MATERIALIZED (SELECT query_id, id, count(DISTINCT term) AS n_matched, count(DISTINCT term) = max(len(q.terms)) AS is_full FROM matches JOIN parsed q USING (query_id) GROUP BY query_id, id)"""

PART_SCORE = " + ".join(f"CASE WHEN tf_{f} > 0 THEN {b} * tf_{f} * 2.2 / (tf_{f} + 1.2 * (0.25 + 0.75 * len_{f} / greatest(1.0, avg_{f}))) ELSE 0.0 END" for f, b in search.BOOSTS.items())
BM25 = f"""bm AS MATERIALIZED (SELECT query_id, id, sum(greatest(0.0, ln(1 + (n_documents - df + 0.5) / (df + 0.5))) * weight * ({PART_SCORE})) AS bm25, count(DISTINCT term) AS n_matched
 FROM matches JOIN dictionary USING (term) CROSS JOIN stats GROUP BY query_id, id)"""

SEARCH = f"WITH {INDEX}, {PARSED}, {MATCHES}, {BM25}"


def r(value: str, digits: int) -> str:
    return f"floor(({value}) * 1e{digits} + 0.5) / 1e{digits}"


FEEDBACK = """fb AS (SELECT feedback_id, unnest(r) FROM (SELECT feedback_id, min({'received_at': received_at, 'ts': ts, 'rating': lower(trim(rating)), 'category': lower(trim(category)),
 'result_count_bucket': result_count_bucket, 'reason_code': reason_code, 'expires_at': expires_at}) AS r FROM feedback GROUP BY feedback_id))"""
QRELS = "qr AS (SELECT query_id, category, split, doc_id, max(grade) AS grade FROM qrels WHERE grade IS NOT NULL GROUP BY ALL)"
