"""robots.txt and sitemaps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text

RULE = "struct<kind:string,pattern:string>"
GROUP = f"struct<agents:array<string>,rules:array<{RULE}>,delay:double>"
STATE = f"struct<groups:array<{GROUP}>,agents:array<string>,rules:array<{RULE}>,delay:double,sitemaps:array<string>,warned:boolean>"
MAX_ENTRIES = 50_000


def parse(content: Column) -> Column:
    """Struct (groups, sitemaps, warned) of a robots.txt: groups of (agents, rules (kind, pattern), delay). A user-agent line after rules
    begins a group; rules before any agent, lines without a colon and bad delays give a warning; an empty disallow allows all."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), lambda x: F.trim(F.substring_index(x, "#", 1))), lambda x: x != "")
    empty = F.lit(None).cast(STATE)
    start = F.struct(*[F.coalesce(empty[k], F.array().cast(t)).alias(k) for k, t in (("groups", f"array<{GROUP}>"), ("agents", "array<string>"), ("rules", f"array<{RULE}>"))],
                     F.lit(None).cast("double").alias("delay"), F.array().cast("array<string>").alias("sitemaps"), F.lit(False).alias("warned"))

    def closed(s: Column) -> Column:
        group = F.struct(s["agents"].alias("agents"), s["rules"].alias("rules"), s["delay"].alias("delay")).cast(GROUP)
        return F.when(F.size(s["agents"]) > 0, F.array_append(s["groups"], group)).otherwise(s["groups"])

    def step(s: Column, line: Column) -> Column:
        has = F.contains(line, F.lit(":"))
        key, value = F.lower(F.trim(F.substring_index(line, ":", 1))), F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        key = F.when(has, key).otherwise("")
        new = (key == "user-agent") & ((F.size(s["rules"]) > 0) | s["delay"].isNotNull())
        owned = F.size(s["agents"]) > 0
        number = value.try_cast("double")
        pattern = F.when((value == "") | value.rlike(r"^[/*]"), value).otherwise(F.concat(F.lit("/"), value))
        rule = F.when((key == "disallow") & (value == ""), F.struct(F.lit("allow").alias("kind"), F.lit("").alias("pattern"))).when((key == "disallow") | ((key == "allow") & (value != "")), F.struct(key.alias("kind"), pattern.alias("pattern"))).cast(RULE)
        rules = F.when(new, F.array().cast(f"array<{RULE}>")).when(rule.isNotNull() & owned, F.array_append(s["rules"], rule)).otherwise(s["rules"])
        agents = F.when(new, F.array().cast("array<string>")).otherwise(s["agents"])
        agents = F.when((key == "user-agent") & (value != ""), F.array_append(agents, F.lower(value))).otherwise(agents)
        good = (key == "crawl-delay") & owned & (number >= 0)
        return F.struct(
            F.when(new, closed(s)).otherwise(s["groups"]).alias("groups"), agents.alias("agents"), rules.alias("rules"), F.when(new, None).when(F.coalesce(good, F.lit(False)), number).otherwise(s["delay"]).alias("delay"),
            F.when((key == "sitemap") & (value != ""), F.array_append(s["sitemaps"], value)).otherwise(s["sitemaps"]).alias("sitemaps"),
            (s["warned"] | ~has | (key.isin("allow", "disallow", "crawl-delay") & ~owned) | F.coalesce((key == "crawl-delay") & ~F.coalesce(number >= 0, F.lit(False)), F.lit(False))).alias("warned"))

    return F.aggregate(lines, start, step, lambda s: F.struct(closed(s).alias("groups"), s["sitemaps"].alias("sitemaps"), s["warned"].alias("warned")))


def group_for(groups: Column, agent: str) -> Column:
    """The groups' rules and delay for an agent: those that name a part of it, else those for all; as a struct (rules, delay)."""
    named = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a)))
    anyone = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    chosen = F.when(F.size(named) > 0, named).otherwise(anyone)
    return F.struct(F.flatten(F.transform(chosen, lambda g: g["rules"])).alias("rules"), F.array_max(F.transform(chosen, lambda g: g["delay"])).alias("delay"))


def pattern_regex(pattern: Column) -> Column:
    """Regular expression of a path pattern: * stands for anything, $ at the end for the end of the path."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(body, r"([\\.?+()\[\]{}|^$])", r"\\$1"), F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def allowed(rules: Column, path: Column) -> Column:
    """Whether a path may be fetched: the longest matching rule decides, allow at equal length; without one it may."""
    hits = F.filter(rules, lambda r: F.regexp_like(path, pattern_regex(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (r["kind"] == "allow").alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def sitemap(content: Column) -> Column:
    """Struct (kind, entries (loc, lastmod)) of a sitemap: an index, a set of URLs, or lines of text; MAX_ENTRIES entries at most, which is the
    format's own limit."""
    kind = F.when(content.rlike(r"(?i)<sitemapindex[\s>]"), "index").when(content.rlike(r"(?i)<urlset[\s>]"), "urlset").otherwise("text")
    blocks = F.regexp_extract_all(content, F.lit(r"(?is)<(?:url|sitemap)>.*?</(?:url|sitemap)>"), F.lit(0))
    inner = lambda b, tag: F.trim(text.decode_entities(F.regexp_extract(b, rf"(?is)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)))
    xml = F.transform(blocks, lambda b: F.struct(inner(b, "loc").alias("loc"), F.nullif(inner(b, "lastmod"), F.lit("")).alias("lastmod")))
    plain = F.transform(F.split(content, r"\r?\n"), lambda x: F.struct(F.trim(x).alias("loc"), F.lit(None).cast("string").alias("lastmod")))
    entries = F.filter(F.when(kind == "text", plain).otherwise(xml), lambda e: e["loc"].rlike("(?i)^https?://"))
    return F.struct(kind.alias("kind"), F.slice(entries, 1, MAX_ENTRIES).alias("entries"))
