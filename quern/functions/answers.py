"""Extractive answers: sanitising, sentences, their quality and score, a diverse choice, disagreement. All as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text

# Abbreviations that end no sentence, boilerplate, stop words of questions.
ABBREVIATIONS = "etc vs mr mrs ms dr prof inc ltd corp co jan feb mar apr jun jul aug sep oct nov dec no vol dept approx est min sec ft yd km mi".split()
BOILERPLATE = [r"\ball\s+rights\s+reserved\b", r"\bterms\s+(and|&)\s+conditions\b", r"\bcookie\s+(policy|settings|consent)\b", r"\bsubscribe\s+to\s+our\s+newsletter\b", r"\bsign\s+in\s+to\s+your\s+account\b", r"\bclick\s+here\s+to\b",
               r"\bread\s+more\s+about\b", r"\bjavascript\s+is\s+(disabled|required)\b", r"\bpage\s+not\s+found\b", r"\b404\s+error\b", r"\bprivacy\s+policy\b", r"\baccept\s+all\s+cookies\b"]
QUESTION_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with what which who how when where why do does did this these those or if".split()
INJECTIONS = [r"ignore\s+(all\s+)?(previous|prior)\s+instructions", r"you\s+are\s+now\s+(a|an|the)\s+", r"system\s*:\s*", r"assistant\s*:\s*", r"human\s*:\s*", r"bypass\s+all\s+(rules|guidelines)"]
POLARITY = {
    "legality": (r"\b(is|are|was|were)\s+(legal|permitted|authorized|allowed)\b", r"\b(is|are|was|were)\s+(illegal|prohibited|unlawful|banned|forbidden)\b"),
    "safety": (r"\b(is|are|was|were|found)\s+(safe|harmless|non-toxic|secure)\b", r"\b(is|are|was|were|found)\s+(unsafe|dangerous|harmful|hazardous|toxic|insecure)\b"),
    "efficacy": (r"\b(is|are|proven|demonstrated)\s+(effective|efficacious|beneficial|reliable)\b", r"\b(is|are|proven|demonstrated)\s+(ineffective|inefficacious|unreliable|futile)\b"),
    "support": (r"\b(is|are)\s+(supported|maintained|actively\s+developed|stable)\b", r"\b(is|are)\s+(deprecated|unsupported|discontinued|abandoned|end-of-life)\b"),
    "truth": (r"\b(is|are|was|were)\s+(true|confirmed|proven|accurate)\b", r"\b(is|are|was|were)\s+(false|debunked|myth|untrue|inaccurate)\b"),
}
YEAR_CLAIM = r"(?i)\b(founded|created|invented|established|released|introduced|born|died)\s+(?:in|on|around)?\s*([12]\d{3})\b"
MIN_CHARS, MAX_CHARS, MAX_SENTENCES, MAX_ANSWER, DIVERSITY, RELEVANCE = 25, 320, 3, 400, 0.40, 0.20
MAX_DOCUMENTS, DOCUMENT_CHARS, TOTAL_CHARS = 5, 1200, 5000


def sanitise(value: Column, most: int = 2000) -> Column:
    """Text of an untrusted page: no scripts, tags, control or direction characters; phrases that look like instructions replaced; white
    space collapsed; cut at a word's end where one lies in the last fifth, with three dots."""
    out = F.coalesce(value, F.lit(""))
    for tag in ("script", "style", "iframe"):
        out = F.regexp_replace(out, rf"(?is)<\s*{tag}[^>]*>.*?<\s*/\s*{tag}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[​-‍﻿‪-‮⁦-⁩]", "")
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(plain))
    for pattern in INJECTIONS:
        out = F.regexp_replace(out, "(?i)" + pattern, "[filtered]")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))

    def cut(t: Column) -> Column:
        part = F.substring(t, 1, most)
        last = most - F.instr(F.reverse(part), " ")  # places before the last space
        return F.when(F.length(t) <= most, t).when((F.instr(part, " ") > 0) & (last > most * 0.8), F.concat(F.substring(part, F.lit(1), last.cast("int")), F.lit("..."))).otherwise(F.concat(part, F.lit("...")))

    return text.let(out, cut)


def words(value: Column) -> Column:
    """Lower-case words of two characters or more, of letters, digits, _ and - of ASCII."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9_ -]", " ")), r"\s+"), lambda w: F.length(w) > 1)


def sentences(value: Column) -> Column:
    """Sentences in order: ends before a capital, digit or quotation mark; decimals, dotted abbreviations and known ones end none."""
    kept = F.regexp_replace(F.regexp_replace(value, r"(\d+)\.(?=\d)", "$1\u0001"), r"\b([a-zA-Z]{1,4})\.(?=[a-zA-Z]{1,4}\b)", "$1\u0001")
    parts = F.filter(F.transform(F.split(kept, r"(?<=[.!?])\s+(?=[A-Z0-9\"']|$)"), lambda p: F.trim(F.replace(p, F.lit("\u0001"), F.lit(".")))), lambda p: p != "")
    short = lambda p: F.array_contains(F.array(*[F.lit(a) for a in ABBREVIATIONS]), F.lower(F.regexp_replace(F.element_at(F.split(p, r"\s+"), -1), "[^a-zA-Z]", "")))
    joined = lambda acc, p: F.when((F.size(acc) > 0) & short(p), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), p)))).otherwise(F.array_append(acc, p))
    return F.aggregate(parts, F.array().cast("array<string>"), joined)


def is_poor(sentence: Column) -> Column:
    """Whether a sentence is boilerplate or too short, long, loud or bare to answer anything."""
    letters = F.length(F.regexp_replace(sentence, "[^a-zA-Z]", ""))
    upper = F.length(F.regexp_replace(sentence, "[^A-Z]", ""))
    out = ~F.length(sentence).between(MIN_CHARS, MAX_CHARS) | (F.size(F.split(sentence, r"\s+")) < 4) | (letters < 10) | (upper > 0.6 * letters)
    for pattern in BOILERPLATE:
        out = out | sentence.rlike("(?i)" + pattern)
    return out


def score(sentence: Column, query: Column, title: Column, rank: Column, position: Column) -> Column:
    """Struct (score, n_matched, words) of a sentence for the words of a query and of its document's title; rank is the document's from 1,
    position the sentence's from 0."""
    own = words(sentence)
    stop = F.array(*[F.lit(w) for w in QUESTION_WORDS])

    def of(w: Column) -> Column:
        matched = F.filter(query, lambda q: F.array_contains(w, q))
        often = F.aggregate(F.transform(matched, lambda q: F.least(F.size(F.filter(w, lambda x: x == q)), F.lit(3)) * F.when(F.array_contains(stop, q), 0.3).otherwise(1.0)), F.lit(0.0), lambda a, x: a + x)
        titled = F.when(F.size(title) > 0, F.least(F.lit(0.2), F.size(F.filter(title, lambda t: F.array_contains(w, t))) / F.size(title) * 0.2)).otherwise(0.0)
        lead = F.when(position == 0, 0.2).when(position == 1, 0.1).otherwise(0.0)
        length = F.when(F.length(sentence).between(60, 200), 0.1).otherwise(0.0)
        value = (F.size(matched) / F.size(query) * 0.5 + F.least(often / 5, F.lit(0.3)) + titled + lead + length) * F.greatest(F.lit(0.4), 1 - (rank - 1) * 0.12)
        value = F.when((F.size(query) == 0) | (F.size(w) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
        return F.named_struct(F.lit("score"), value, F.lit("n_matched"), F.when(F.size(w) > 0, F.size(matched)).otherwise(0), F.lit("words"), F.array_distinct(w))

    return text.let(own, of)


def choose(candidates: Column) -> Column:
    """Chosen ones of candidates (an array of structs with score, sentence, words, in order): the best first, at most MAX_SENTENCES of together
    MAX_ANSWER characters (the first may be longer), none with a Jaccard similarity above DIVERSITY to one chosen before."""
    size = lambda acc: F.aggregate(acc, F.lit(0), lambda a, x: a + F.length(x["sentence"]))

    def step(acc: Column, c: Column) -> Column:
        fits = (F.size(acc) == 0) | (size(acc) + F.length(c["sentence"]) <= MAX_ANSWER)
        alike = F.exists(acc, lambda p: text.jaccard(c["words"], p["words"]) > DIVERSITY)
        return F.when((F.size(acc) < MAX_SENTENCES) & (c["score"] > 0.05) & fits & ~alike, F.array_append(acc, c)).otherwise(acc)

    return F.aggregate(candidates, F.slice(candidates, 1, 0), step)
