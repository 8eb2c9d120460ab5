"""Redaction, anonymising and guards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import urls

# Parameters that are redacted, label keys, feedback fields and values.
SECRET_PARAMETERS = ["q", "query", "search", "token", "key", "password", "secret", "auth", "authorization", "credential", "apikey", "api_key", "session", "cookie", "access_token", "refresh_token", "bearer"]
FORBIDDEN_LABELS = ["q", "query", "raw_query", "search_query", "ip", "client_ip", "user", "user_id", "userid", "account", "account_id", "email", "token", "auth", "secret", "password", "key", "apikey", "cookie", "session", "session_id", "url", "full_url", "referer", "referrer", "body", "fingerprint", "click"]
ALLOWED_LABELS = ["method", "path", "status", "status_family", "provider", "queue", "mode", "code", "error_type", "tier", "le", "quantile", "format"]
FORBIDDEN_FIELDS = ["query", "rawquery", "q", "searchquery", "ip", "clientip", "remoteaddress", "ipaddress", "userid", "accountid", "sessionid", "fingerprint", "browserfingerprint", "canvasfingerprint", "useragent", "clickhistory",
                    "clickedurls", "clickedlinks", "dwelltime", "history", "cookies", "auth", "token", "email", "username"]
RATINGS = ["helpful", "not_helpful"]
RESULT_BUCKETS = ["0", "1-5", "6-10", "10+"]
REASONS = ["accurate_answer", "relevant_results", "fast_discovery", "poor_relevance", "outdated_results", "broken_links", "inaccurate_answer", "missing_information", "other"]
MAX_PAYLOAD = 1024
PERSONAL = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b",
    "address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "session": r"(?i)\b(?:session_id|jwt|bearer|auth_token|cookie_id)=[a-zA-Z0-9_\-.]+",
    "phone": r"\b(?:\+?1[-.]?)?\(?[2-9]\d{2}\)?[-.]?\d{3}[-.]?\d{4}\b",
}
EXACT_ROUTES = ["/", "/docs", "/health", "/ready", "/metrics", "/api/v1/status", "/api/v1/search", "/api/v1/search/stream", "/api/v1/suggest", "/api/v1/instant-answer", "/api/v1/lenses", "/api/v1/feedback", "/api/v1/feedback/review"]


def redact_url(url: Column) -> Column:
    """URL with the values of secret parameters and passwords replaced."""
    out = F.regexp_replace(url, rf"(?i)([?&](?:{'|'.join(sorted(SECRET_PARAMETERS, key=len, reverse=True))})=)[^&#]*", "$1[REDACTED]")
    return F.regexp_replace(out, r"(://[^:/@?#]+:)[^@/?#]+@", "$1[REDACTED]@")


def strip_parameters(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def route(path: Column) -> Column:
    """A request path as one of the known routes, so that labels stay few."""
    p = F.regexp_replace(F.regexp_replace(strip_parameters(F.coalesce(path, F.lit(""))), "/+", "/"), "/$", "")
    p = F.when(p == "", "/").otherwise(p)
    return (F.when(p.isin(EXACT_ROUTES), p).when(p.startswith("/api/v1/lenses/"), "/api/v1/lenses/:id").when(p.rlike("^/api/v1/feedback/review/.*/approve-case$"), "/api/v1/feedback/review/:id/approve-case")
            .when(p.startswith("/api/v1/feedback/review/"), "/api/v1/feedback/review/:id").when(p.rlike("^/(assets|static)/"), "/static/:file").otherwise("/other"))


def anonymise_ip(ip: Column) -> Column:
    """Last part of an IPv4 address zero; of IPv6 the first three groups; else 0.0.0.0."""
    groups = F.split(ip, ":")
    return (F.when(ip.rlike(r"^[^.]*(\.[^.]*){3}$"), F.regexp_replace(ip, r"\.[^.]*$", ".0"))
            .when(F.contains(ip, F.lit(":")) & (F.size(groups) >= 3), F.concat(F.array_join(F.slice(groups, 1, 3), ":"), F.lit("::"))).otherwise("0.0.0.0"))


def personal(text: Column) -> Column:
    """Array of the kinds of personal data that a text may hold."""
    return F.filter(F.array(*[F.when(text.rlike(pattern), kind) for kind, pattern in PERSONAL.items()]), lambda k: k.isNotNull())


def label(key: Column, value: Column) -> Column:
    """Struct (reason, value): why a metric label is rejected (forbidden, unapproved), else its value, cut or redacted."""
    k = F.lower(key)
    clean = (F.when(F.length(value) > 64, F.concat(F.substring(value, 1, 60), F.lit("..."))).when(value.rlike(r"[?&]|https?://"), "[REDACTED_URL_OR_QUERY]")
             .when(value.rlike("@") & value.rlike(r"\."), "[REDACTED_EMAIL]").otherwise(value))
    reason = F.when(k.isin(FORBIDDEN_LABELS), "forbidden").when(~k.isin(ALLOWED_LABELS), "unapproved")
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), clean).alias("value"))


def feedback_errors(payload: Column) -> Column:
    """Array of the reasons why a feedback payload (JSON text) is rejected."""
    fields = F.from_json(payload, "map<string,string>")
    keys = F.transform(F.map_keys(fields), lambda k: F.regexp_replace(F.lower(k), "[_-]", ""))
    get = lambda k: F.element_at(fields, k)
    errors = F.array(
        F.when(fields.isNull(), "json"), F.when(F.octet_length(payload) > MAX_PAYLOAD, "size"), F.when(F.arrays_overlap(keys, F.array(*[F.lit(f) for f in FORBIDDEN_FIELDS])), "forbidden"),
        F.when(~F.coalesce(get("rating").isin(RATINGS), F.lit(False)), "rating"), F.when(~F.coalesce(get("resultCountBucket"), F.lit("0")).isin(RESULT_BUCKETS), "bucket"),
        F.when(~F.coalesce(get("reasonCode"), F.lit("other")).isin(REASONS), "reason"), F.when(F.coalesce(get("consent"), F.lit("")) != "true", "consent"))
    return F.filter(errors, lambda e: e.isNotNull())


def safe_image_url(url: Column) -> Column:
    """Image URL that may be shown: http or https with a host, at most 4,096 characters, no control characters; else NULL."""
    u = F.trim(url)
    return F.when((F.length(u).between(1, 4096)) & ~u.rlike(r"[\x00-\x1f\x7f]") & urls.scheme(u).isin("http", "https") & (urls.host(u) != ""), u)


def safe_source_url(url: Column) -> Column:
    """Link to a source that may be opened; '#' for what can't be trusted."""
    u = F.trim(url)
    return F.when(urls.scheme(u).isin("http", "https", "file") & ((urls.host(u) != "") | (urls.scheme(u) == "file")), u).otherwise("#")
