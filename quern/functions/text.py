"""Text functions as Column expressions: folding, tokens, HTML to text, sentences, highlighting."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default stop words.
STOP_WORDS = """
a about above after again against all am an and any are aren as at be because been before being below between both but by can cannot could couldn did didn do does
doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its
itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should shouldn so some such t than that the
their theirs them themselves then there these they this those through to too under until up very was wasn we were weren what when where which while who whom why will
with won would wouldn you your yours yourself yourselves
""".split()
FIELD_WEIGHTS = {"title": 3.0, "headings": 2.0, "description": 1.5, "body": 1.0}
MAX_TOKEN = 64


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Letters that decompose into one letter and marks of U+0300..U+036F, and that letter, for the Latin, Greek and Cyrillic blocks."""
    source, target = [], []
    for c in [*range(0xC0, 0x250), *range(0x386, 0x400), *range(0x400, 0x530), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(c))
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        if base != parts and len(base) == 1:
            source.append(chr(c))
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    return F.translate(text, *fold_table())


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Kept tokens in order: runs of letters and numbers, folded, lower case, 1 to 64 characters, no stop words."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)]) if stop_words != [] else None
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.lower(fold(w)))
    keep = lambda w: F.length(w).between(1, MAX_TOKEN)
    return F.filter(words, lambda w: keep(w) & ~F.array_contains(stop, w) if stop is not None else keep(w))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def normalise(text: Column, strip_punctuation: bool = False) -> Column:
    """Control characters to spaces, folded, lower case, white space collapsed and trimmed."""
    out = F.lower(fold(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")))
    if strip_punctuation:
        out = F.regexp_replace(out, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def round_half_up(value: Column, digits: int) -> Column:
    """Half rounds towards plus infinity."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


# ---- HTML

NOISE = ["script", "style", "noscript", "svg", "iframe"]
PAGE_NOISE = ["nav", "header", "footer", "aside"]
# Named entities that are decoded.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&middot;": "·", "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&sect;": "§", "&deg;": "°", "&laquo;": "«", "&raquo;": "»", "&times;": "×",
}


def decode_entities(text: Column) -> Column:
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def decode_numeric(text: Column) -> Column:
    """Decimal and hexadecimal references; parts between them stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#\d{1,7};|&#[xX][0-9A-Fa-f]{1,6};|(?:(?!&#\d{1,7};|&#[xX][0-9A-Fa-f]{1,6};).)+"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.when(p.rlike(r"^&#\d{1,7};$"), F.regexp_extract(p, r"(\d+)", 1).cast("int")).when(
            p.rlike(r"^&#[xX][0-9A-Fa-f]{1,6};$"), F.conv(F.regexp_extract(p, r"[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
        )
        high, low = 0xD800 + F.floor((code - 0x10000) / 1024), 0xDC00 + (code - 0x10000) % 1024
        pair = F.concat(F.lpad(F.hex(high.cast("bigint")), 4, "0"), F.lpad(F.hex(low.cast("bigint")), 4, "0"))
        utf16 = F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | (code == 0), F.lit(None)).otherwise(F.unhex(F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(pair)))
        return F.coalesce(F.decode(utf16, "UTF-16BE"), p)

    return F.array_join(F.transform(pieces, one), "")


def strip_noise(html: Column, page: bool = True) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in NOISE + (PAGE_NOISE if page else []):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return out


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def inline_text(html: Column) -> Column:
    """Tags out, entities decoded, white space collapsed."""
    return collapse(decode_entities(decode_numeric(F.regexp_replace(html, r"<[^>]+>", " "))))


def visible_text(html: Column) -> Column:
    """Block ends as line ends, other tags out, entities decoded, lines collapsed, empty lines out."""
    out = strip_noise(html)
    out = F.regexp_replace(out, r"(?i)</(?:p|div|h[1-6]|li|tr|section|article|ul|ol|table|blockquote|pre)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</t[dh]>", " ")
    out = decode_entities(decode_numeric(F.regexp_replace(out, r"<[^>]+>", "")))
    lines = F.filter(F.transform(F.split(out, "\n"), collapse), lambda x: x != "")
    return F.array_join(lines, "\n")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_html(text: Column) -> Column:
    for a, b in (("&#39;", "'"), ("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, terms: Column) -> Column:
    """Escaped text with the terms (an array, longest first) in <mark>, without regard to case."""
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(terms, lambda t: F.concat(F.lit("\\Q"), escape_html(t), F.lit("\\E"))), "|"), F.lit(")"))
    return F.when(F.size(terms) == 0, escape_html(text)).otherwise(F.regexp_replace(escape_html(text), pattern, F.lit("<mark>$1</mark>")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
