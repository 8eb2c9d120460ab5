"""HTML pages as Column expressions: parsing, links, subresources, reader form, privacy audit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text, urls

MAX_TITLE, MAX_DESCRIPTION, MAX_BODY, MAX_LINKS, MAX_RESOURCES = 300, 1000, 1_000_000, 500, 500
QUOTED = r"(?:\"([^\"]*)\"|'([^']*)')"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, in either kind of quotes, entities decoded; '' without one."""
    pattern = rf"(?i)\s{name}\s*=\s*{QUOTED}"
    return text.decode_entities(text.decode_numeric(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))))


def tags(html: Column, name: str) -> Column:
    """Start tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def _first(values: Column) -> Column:
    """First value that is not empty."""
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), 0), F.lit(""))


def meta(html: Column, key: str, name: str) -> Column:
    """Content of the first meta tag with that key (name or property), whatever the order of its attributes."""
    hits = F.filter(tags(html, "meta"), lambda t: F.lower(attribute(t, key)) == name)
    return _first(F.transform(hits, lambda t: text.collapse(attribute(t, "content"))))


def title(html: Column) -> Column:
    inner = lambda tag: text.inline_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    return F.substring(_first(F.array(inner("title"), meta(html, "property", "og:title"), inner("h1"))), 1, MAX_TITLE)


def description(html: Column) -> Column:
    return F.substring(_first(F.array(meta(html, "name", "description"), meta(html, "property", "og:description"))), 1, MAX_DESCRIPTION)


def base(html: Column, url: Column) -> Column:
    """Target of <base href>, resolved against the page's URL; the URL itself without one."""
    href = _first(F.transform(tags(html, "base"), lambda t: attribute(t, "href")))
    return text.let(href, lambda h: F.when(h == "", url).otherwise(F.coalesce(resolve(url, h), url)))


def resolve(base_url: Column, href: Column) -> Column:
    """href as an absolute URL; NULL for fragments and schemes other than http and https."""
    port = lambda b: F.when(urls.part(b, 3) == "", "").otherwise(F.concat(F.lit(":"), urls.part(b, 3)))
    origin = lambda b: F.concat(urls.scheme(b), F.lit("://"), urls.host(b), port(b))
    parts = lambda b: F.named_struct(F.lit("origin"), origin(b), F.lit("path"), urls.part(b, 4), F.lit("scheme"), urls.scheme(b))

    def join(b: Column, h: Column) -> Column:
        folder = F.coalesce(F.nullif(F.regexp_extract(b["path"], "^(.*/)", 1), F.lit("")), F.lit("/"))
        return (F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h)).when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:|^#|^$"), F.lit(None))
                .when(h.startswith("/"), F.concat(b["origin"], h)).when(h.startswith("?"), F.concat(b["origin"], b["path"], h)).otherwise(F.concat(b["origin"], folder, h)))

    plain = F.regexp_replace(text.let(text.let(base_url, parts), lambda b: text.let(href, lambda h: join(b, h))), r"/(?:\./)+", "/")
    for _ in range(4):  # dot segments
        plain = F.regexp_replace(plain, r"(?<=[^:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    return plain


def canonical(html: Column, url: Column) -> Column:
    hits = F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    to = resolve(base(html, url), _first(F.transform(hits, lambda t: attribute(t, "href"))))
    return text.let(to, lambda t: F.coalesce(F.when(urls.validate(t).isNull(), urls.normalise(t)), url))


def language(html: Column, header: Column | None = None) -> Column:
    """Primary subtag of html lang, else of meta content-language, else of the header; two or three letters, else ''."""
    values = [_first(F.transform(tags(html, "html"), lambda t: attribute(t, "lang"))), meta(html, "http-equiv", "content-language"), *([header] if header is not None else [])]
    code = lambda v: F.lower(F.element_at(F.split(F.trim(v), "[-_]"), 1))
    return _first(F.transform(F.array(*values), lambda v: F.when(code(v).rlike("^[a-z]{2,3}$"), code(v)).otherwise("")))


def headings(html: Column) -> Column:
    """Array of (level, text) in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h\1>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.regexp_extract(h, "(?i)^<h([1-6])", 1).cast("int").alias("level"), text.inline_text(h).alias("text")))


def nofollow(html: Column) -> Column:
    """Whether the page asks robots not to follow its links."""
    rules = F.concat_ws(",", meta(html, "name", "robots"), meta(html, "name", "googlebot"))
    return F.lower(rules).rlike(r"(^|[\s,])(nofollow|none)([\s,]|$)")


def parse(html: Column, url: Column) -> Column:
    """Struct of everything that is taken from a page, with the bounds on sizes that a page is stored with."""
    h = headings(html)
    return F.struct(
        title(html).alias("title"), description(html).alias("description"), canonical(html, url).alias("canonical"), language(html).alias("language"), h.alias("heading_items"),
        F.array_join(F.filter(F.transform(h, lambda x: x["text"]), lambda x: x != ""), " ").alias("headings"), F.substring(text.visible_text(F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>|<title\b[^>]*>.*?</title>", "")), 1, MAX_BODY).alias("body"), nofollow(html).alias("is_nofollow"))


def anchors(html: Column) -> Column:
    """Array of (href, anchor, rel) of the anchors, in order."""
    found = F.regexp_extract_all(text.strip_noise(html, False), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    start = lambda a: F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0)
    return F.transform(found, lambda a: F.struct(F.trim(attribute(start(a), "href")).alias("href"), text.inline_text(a).alias("anchor"), F.lower(attribute(start(a), "rel")).alias("rel")))


def resources(html: Column) -> Column:
    """Array of (kind, src, is_beacon) of the page's subresources, in order of kinds; a beacon is an image of one pixel at most, or hidden."""
    def one(name: str, kind: str, key: str = "src") -> Column:
        size = lambda t, k: attribute(t, k).rlike(r"^[01](px)?$")
        hidden = lambda t: attribute(t, "style").rlike(r"(?i)display:\s*none|visibility:\s*hidden")
        beacon = (lambda t: (size(t, "width") & size(t, "height")) | hidden(t)) if kind == "img" else (lambda t: F.lit(False))
        return F.transform(tags(html, name), lambda t: F.struct(F.lit(kind).alias("kind"), attribute(t, key).alias("src"), beacon(t).alias("is_beacon")))

    kinds = [("script", "script"), ("link", "link", "href"), ("img", "img"), ("iframe", "iframe"), ("video", "media"), ("audio", "media"), ("source", "media"), ("embed", "embed"), ("object", "object", "data")]
    return F.filter(F.concat(*[one(*k) for k in kinds]), lambda r: r["src"] != "")


def reader(html: Column) -> Column:
    """Struct (markdown, n_words, minutes): headings, list items, emphasis, links and paragraphs of the page's main text."""
    out = text.strip_noise(html)
    out = F.regexp_replace(out, r"(?is)^.*<body\b[^>]*>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>", "**$1**")
    out = F.regexp_replace(out, r"(?is)<(?:em|i)\b[^>]*>(.*?)</(?:em|i)>", "*$1*")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*\shref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|section|article|ul|ol|table|tr|blockquote|pre)>|<br\s*/?>", "\n\n")
    out = text.decode_entities(text.decode_numeric(F.regexp_replace(out, r"<[^>]+>", "")))
    lines = F.transform(F.split(out, "\n"), text.collapse)
    markdown = F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    markdown = F.regexp_replace(markdown, r"^\n+|\n+$", "")
    n = F.size(F.filter(F.split(markdown, r"\s+"), lambda w: w != ""))
    return F.struct(markdown.alias("markdown"), n.alias("n_words"), F.greatest(F.lit(1), F.floor(n / 200 + 0.5)).cast("int").alias("minutes"))


# Traces of analytics in a page.
ANALYTICS = ["google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "clarity.ms", "hotjar.com", "mixpanel.com", "segment.io", "analytics.js", "gtag"]
REFERRER_POLICIES = ["strict-origin-when-cross-origin", "no-referrer", "same-origin"]


def audit(html: Column) -> Column:
    """Array of issues: external scripts, external links, traces of analytics."""
    external = lambda v: v.rlike(r"^(?:https?:)?//")
    scripts = F.filter(F.transform(tags(html, "script"), lambda t: attribute(t, "src")), external)
    links = F.filter(F.transform(tags(html, "link"), lambda t: attribute(t, "href")), lambda v: external(v) & ~v.rlike(r"localhost|127\.0\.0\.1"))
    traces = F.filter(F.array(*[F.lit(a) for a in ANALYTICS]), lambda a: F.contains(F.lower(html), a))
    say = lambda values, what: F.transform(values, lambda v: F.concat(F.lit(what), v))
    return F.concat(say(scripts, "script: "), say(links, "link: "), say(traces, "analytics: "))


def audit_headers(headers: Column) -> Column:
    """Array of issues of response headers (a map with lower-case keys)."""
    policy, security = F.element_at(headers, "referrer-policy"), F.element_at(headers, "content-security-policy")
    issues = F.array(F.when(F.element_at(headers, "set-cookie").isNotNull(), "set-cookie present"), F.when(policy.isNull(), "referrer-policy missing").when(~policy.isin(REFERRER_POLICIES), "referrer-policy weak"), F.when(security.isNull(), "content-security-policy missing"))
    return F.filter(issues, lambda i: i.isNotNull())
