"""Trackers among the resources of pages: registry, classes, multipliers and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls

# Tracker domains with their categories.
TRACKERS = {
    "google-analytics.com": "analytics", "googletagmanager.com": "analytics", "hotjar.com": "session-recording", "fullstory.com": "session-recording", "segment.com": "analytics", "segment.io": "analytics", "mixpanel.com": "analytics",
    "yandex.ru": "analytics", "clarity.ms": "session-recording", "chartbeat.com": "analytics", "doubleclick.net": "advertising", "googlesyndication.com": "advertising", "criteo.com": "advertising", "criteo.net": "advertising",
    "taboola.com": "advertising", "outbrain.com": "advertising", "adnxs.com": "advertising", "adsrvr.org": "advertising", "amazon-adsystem.com": "advertising", "rubiconproject.com": "advertising", "pubmatic.com": "advertising",
    "openx.net": "advertising", "facebook.net": "social", "facebook.com": "social", "tiktok.com": "social", "twitter.com": "social", "ads-twitter.com": "advertising", "scorecardresearch.com": "fingerprinting", "quantserve.com": "analytics",
    "voicefive.com": "fingerprinting", "nr-data.net": "telemetry", "appsflyer.com": "analytics", "adjust.com": "analytics", "browser-intake-datadoghq.com": "telemetry", "sentry-cdn.com": "telemetry",
}
HEAVY = ["fingerprinting", "session-recording"]
MIN_HTML = 50


def category(host: Column) -> Column:
    """Category of the tracker that a host belongs to: by its whole name, its registrable domain, or any suffix of it."""
    registry = F.create_map(*[F.lit(x) for p in TRACKERS.items() for x in p])
    below = F.get(F.filter(F.transform(urls.suffixes(host), lambda s: F.element_at(registry, s)), lambda c: c.isNotNull()), 0)
    return F.coalesce(F.element_at(registry, host), F.element_at(registry, urls.registrable(host)), below)


def classify(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """(page_id, status, n_resources, n_third_party, n_trackers, categories, confidence). pages: (page_id, url, html); resources: (page_id, src),
    absolute addresses. A page without the structure of one is unverified, a blank one unknown."""
    html = F.trim(F.coalesce("html", F.lit("")))
    sound = (F.length(html) >= MIN_HTML) & html.rlike(r"(?i)<(html|head|body)\b")
    p = pages.select("page_id", urls.registrable(urls.host(F.col("url"))).alias("own"), F.when(html == "", "unknown").when(~sound, "unverified").alias("state"))
    r = resources.select("page_id", urls.host(F.col("src")).alias("host")).join(p, "page_id").filter("state is null")
    third = urls.registrable(F.col("host")) != F.col("own")
    r = r.select("page_id", third.alias("third"), F.when(third, category(F.col("host"))).alias("category"))
    g = r.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("third").alias("n_third"), F.count("category").alias("n_trackers"), F.array_sort(F.collect_set("category")).alias("categories"))
    out = p.join(g, "page_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    status = F.coalesce("state", F.when(n("n_trackers") > 0, "trackers_detected").otherwise("no_trackers_detected"))
    confidence = F.when(F.col("state").isNotNull(), "none").when(n("n") > 0, "high").otherwise("medium")
    return out.select("page_id", status.alias("status"), n("n").alias("n_resources"), n("n_third").alias("n_third_party"), n("n_trackers").alias("n_trackers"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), confidence.alias("confidence"))


def is_heavy(n_trackers: Column, categories: Column) -> Column:
    return F.arrays_overlap(categories, F.array(*[F.lit(c) for c in HEAVY])) | (n_trackers >= 5)


def multiplier(status: Column, n_trackers: Column, categories: Column, confidence: Column, weight: float = 0.15) -> Column:
    """Factor on a score: above 1 for a clean page, below for trackers, 1 where nothing is known."""
    clean = (status == "no_trackers_detected") & confidence.isin("high", "medium")
    bad = 1 - weight * (1 - F.when(is_heavy(n_trackers, categories), 0.70).otherwise(0.85))
    return F.when(clean, 1 + weight * (1.10 - 1)).when(status == "trackers_detected", bad).otherwise(1.0)


def indicator(status: Column, n_trackers: Column, categories: Column) -> Column:
    """Struct (badge, severity) that a result shows."""
    badge = (F.when(status == "trackers_detected", F.when(n_trackers == 1, "1 Tracker Detected").otherwise(F.concat(n_trackers.cast("string"), F.lit(" Trackers Detected"))))
             .when(status == "no_trackers_detected", "No Trackers Detected").when(status == "unverified", "Telemetry: Unverified").otherwise("Telemetry: Unknown"))
    severity = F.when(status == "trackers_detected", F.when(is_heavy(n_trackers, categories), "alert").otherwise("warning")).when(status == "no_trackers_detected", "clean").otherwise("neutral")
    return F.struct(badge.alias("badge"), severity.alias("severity"))
