"""What is shown of a result: snippets, titles, addresses, age; normalised results of other providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import privacy, text, urls

SNIPPET, CONTEXT_MARGIN = 160, 30


def places(value: Column, term: Column) -> Column:
    """0-based places of a term in a text, apart from each other."""
    pieces = F.split(value, F.concat(F.lit("\\Q"), term, F.lit("\\E")))
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * F.length(term))
    return F.when((F.size(pieces) > 1) & (F.length(term) > 0), ends).otherwise(F.array().cast("array<int>"))


def _window(value: Column, start: Column, end: Column, ellipsis: str, trim: int = 15) -> Column:
    """Characters start to end (0-based, end not included), cut back to whole words where a space is near, with marks of what is left out."""
    n = F.length(value)
    leading, trailing = start > 0, end < n
    space = F.locate(" ", value, start + 1) - 1 if isinstance(start, int) else F.instr(F.substring(value, start + 1, n), " ") - 1 + start
    first = F.when(leading & (space >= start) & (space < start + trim), space + 1).otherwise(start)
    back = F.instr(F.reverse(F.substring(value, F.lit(1), end + 1)), " ")
    last = F.when(trailing & (back > 0) & (end + 1 - back > end - trim), end + 1 - back).otherwise(end)
    body = F.trim(F.substring(value, first + 1, last - first))
    body = F.regexp_replace(F.regexp_replace(body, r"^[,;.\-—–\s]+", ""), r"[,;\-—–\s]+$", "")
    return F.concat(F.when(leading, F.lit(ellipsis + " ")).otherwise(""), body, F.when(trailing & (last < n), F.lit(" " + ellipsis)).otherwise(""))


def snippet(value: Column, terms: Column, most: int = SNIPPET, ellipsis: str = "…") -> Column:
    """At most about `most` characters of a text: the window that begins at the term's place with the most places in it, moved back so that
    it stands in the middle; the beginning where no term occurs; the whole of a short text."""
    plain = text.inline_text(F.coalesce(value, F.lit("")))

    def of(t: Column) -> Column:
        at = F.array_sort(F.flatten(F.transform(F.filter(terms, lambda x: F.trim(x) != ""), lambda x: places(F.lower(t), F.lower(F.trim(x))))))

        def placed(p: Column) -> Column:
            best = F.array_max(F.transform(p, lambda a: F.named_struct(F.lit("n"), F.size(F.filter(p, lambda b: (b >= a) & (b <= a + most))), F.lit("at"), -a)))
            begin = F.greatest(F.lit(0), -best["at"] - (most - CONTEXT_MARGIN) // 2)
            start = F.when(begin + most > F.length(t), F.greatest(F.lit(0), F.length(t) - most)).otherwise(begin)
            return F.when(F.size(p) == 0, _window(t, F.lit(0), F.lit(most), ellipsis)).otherwise(text.let(start, lambda s: _window(t, s, F.least(s + most, F.length(t)), ellipsis)))

        return F.when(F.length(t) <= most, t).otherwise(text.let(at, placed))

    return text.let(plain, of)


def dense_snippet(value: Column, terms: Column, most: int = 180, form: str = "plain") -> Column:
    """The index's own form: 40 to 180 characters, three dots, highlighted as html, ansi or not at all."""
    out = snippet(value, terms, min(180, max(40, most)), "...")
    if form == "html":
        return text.highlight(out, by_length(terms))
    if form == "ansi":
        pattern = F.concat(F.lit("(?i)("), F.array_join(F.transform(by_length(terms), lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), "|"), F.lit(")"))
        return F.when(F.size(terms) == 0, out).otherwise(F.regexp_replace(out, pattern, F.lit("\u001b[1m$1\u001b[0m")))
    return out


def by_length(terms: Column) -> Column:
    """Terms with the longest first, so that none hides a longer one."""
    keyed = F.transform(F.array_distinct(F.filter(terms, lambda t: F.trim(t) != "")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def fallback_title(url: Column) -> Column:
    """The last segment of a path in words with capitals; the host without one."""
    path = F.regexp_replace(F.regexp_replace(urls.part(url, 4), "/+$", ""), "^.*/", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(path, r"\.[a-z0-9]{1,5}$", ""), r"[-_+%20]+", " "))
    return F.when(words == "", urls.host(url)).otherwise(F.initcap(words))


def age_label(published: Column, now: Column) -> Column:
    """Struct (label, is_recent, is_stale) of a time of publication."""
    ms = F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(published))
    minutes, hours, days = (F.floor(ms / unit).cast("bigint") for unit in (60_000, 3_600_000, 86_400_000))
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    label = (F.when((hours < 1) & (minutes <= 1), "Just now").when(hours < 1, say(minutes, "m")).when(hours < 24, say(hours, "h")).when(days <= 7, say(days, "d")).when(days <= 30, say(F.floor(days / 7), "w"))
             .when(days > 365, say(F.floor(days / 365), "y")).otherwise(say(F.floor(days / 30), "mo")))
    return F.when(published.isNotNull(), F.struct(label.alias("label"), (days <= 7).alias("is_recent"), (days > 30).alias("is_stale")))


def provider_result(title: Column, url: Column, snippet_text: Column, score: Column, rank: Column, provider: Column) -> Column:
    """A result of another provider in the engine's form: fallbacks for missing parts, score between 0 and 1 or by rank."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    value = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), F.greatest(F.lit(0.1), 0.9 - 0.02 * rank))
    return F.struct(F.coalesce(blank(title), blank(url), F.lit("Untitled Result")).alias("title"), F.coalesce(F.trim(url), F.lit("")).alias("url"), F.coalesce(blank(snippet_text), F.concat(F.lit("Result from "), provider)).alias("snippet"),
                    F.regexp_replace(urls.host(url), r"^www\.", "").alias("domain"), F.round(value, 6).alias("score"), privacy.safe_image_url(url).isNotNull().alias("is_safe"))
