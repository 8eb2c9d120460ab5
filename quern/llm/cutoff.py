"""Problem 7: texts cut off by a field limit of their site, or in transfer.

Hidden limits. Every value's length is computed as its store may have counted it: code points, UTF-8 bytes, UTF-16 units,
with entities escaped, as a JSON string, with CRLF line ends. Values are counted by (site, field, measure, length); a
limit shows as a length that far more values have than have the lengths around it. Of the measures the one with the
highest peak stands. A value at its site's limit that has no mark of a sentence's end was cut there.

Endings. Other cuts show in what the text ends with: marks or debris left at the cut; a sentence begun after a finished
one; a last word that hardly ever ends a line or sentence, or that is no word but begins one. Words and how often they
end something are counted over all records. Lines that several pages of the site share belong to the frame and are no
evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import lookalike, sitelines
from quern.llm import textblocks as tb
from quern.runtime import materialise, site_of

FIELDS = ("title", "description", "body_text")
MEASURES = ("code_points", "utf8", "utf16", "html", "json", "crlf")
FRAME_PAGES, KNOWN, FRAGMENT, END_SHARE, FREQUENT = 3, 20, 16, 0.003, 40
CLOSERS = "\"'”’»)]}*_›“"
TERMINAL = ".!?。！？"
MARK = re.compile(r"(?:…|\.{2,}|\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\))\s*$")
ENTITY = "(?:a|am|amp|ap|apo|apos|l|lt|g|gt|q|qu|quo|quot|n|nb|nbs|nbsp|#x?[0-9A-Fa-f]{0,6})"
DEBRIS = re.compile(rf"(?:\ufffd+|(?<=\w)&{ENTITY}?|\s&{ENTITY}|\\u?[0-9A-Fa-f]{{0,3}}|(?:%[0-9A-F]{{2}})+%?[0-9A-F]?|</?[A-Za-z][^<>]{{0,40}}|<)$")
MARK_ENDS, DEBRIS_SIGN = frozenset("….])"), re.compile(r"[\ufffd&\\%<]")
SENTENCE_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s)")
BULLET = re.compile(r"\s*(?:[-*•»>#|]|\d+[.)]\s)")
LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")


@lru_cache(1)
def _extras() -> np.ndarray:
    """By code point (below textblocks.LIMIT): what each of MEASURES counts for it beyond one, and whether that is anything."""
    c = np.arange(tb.LIMIT + 1)
    extras = np.zeros((len(MEASURES), tb.LIMIT + 1), np.int8)
    extras[1] = (c > 0x7F).astype(np.int8) + (c > 0x7FF) + (c > 0xFFFF)
    extras[2] = c > 0xFFFF
    extras[3, [38, 60, 62, 34, 39]] = 4, 3, 3, 5, 4
    extras[4] = np.isin(c, [34, 92, 10, 13, 9]) + 5 * (c > 0x7E) + 6 * (c > 0xFFFF)
    extras[5, 10] = 1
    return np.vstack([extras, extras.any(0)])


def measure(text: pa.Array) -> np.ndarray:
    """Lengths [values, MEASURES]. Only characters that some measure counts otherwise than once are looked at."""
    cps, offs = tb.codepoints(text)
    out = np.repeat(np.diff(offs)[:, None], len(MEASURES), 1)
    extras, at = _extras(), np.minimum(cps, tb.LIMIT)
    places = np.flatnonzero(extras[-1][at])
    if not len(places):
        return out
    weights = np.zeros((len(MEASURES), len(places) + 1), np.int32)
    np.cumsum(extras[:-1, at[places]], axis=1, out=weights[:, 1:])
    bounds = np.searchsorted(places, offs)
    out += (weights[:, bounds[1:]] - weights[:, bounds[:-1]]).T
    # a line feed after a carriage return is one already
    feeds = places[cps[places] == 10]
    paired = feeds[(cps[feeds - 1] == 13) & ~np.isin(feeds, offs)]
    np.subtract.at(out[:, 5], np.searchsorted(offs, paired, "right") - 1, 1)
    return out


def ending(text: str) -> tuple[bool, bool, bool, str, str]:
    """(complete mark at the end, mark or debris of a cut, unfinished sentence after a finished one in the last line, last word if nothing
    but it stands at the end, last line)."""
    text = text.rstrip()
    last_line = text[text.rfind("\n") + 1 :]
    # a mark ends with one of its signs; debris is shorter than 48 characters or has a part at the end that is debris itself
    if last_line[-1:] in MARK_ENDS and MARK.search(last_line):
        return False, True, False, "", last_line
    if DEBRIS_SIGN.search(last_line, max(0, len(last_line) - 48)) and DEBRIS.search(last_line):
        return False, True, False, "", last_line
    if (last_line.rstrip(CLOSERS + " ") or " ")[-1] in TERMINAL:
        return True, False, False, "", last_line
    unfinished = False
    if not BULLET.match(last_line) and "|" not in last_line:
        at = None
        for at in SENTENCE_END.finditer(last_line):
            pass
        if at is not None:
            rest = last_line[at.end() :].strip()
            unfinished = bool(rest) and rest[0] not in "–—-(" and any(c.isalpha() for c in rest) and len(last_line[: at.start()].split()) >= 3
    word = LAST_WORD.search(last_line)
    listed = 3 * last_line.count(",") >= len(last_line.split()) > 1  # tags and keywords
    word = word.group(1) if word and last_line.endswith(word.group(1)) and not BULLET.match(last_line) and not listed else ""
    return False, False, unfinished, word, last_line


def field_rows(records: DataFrame) -> DataFrame:
    """(id, site, field, lengths, ended, marked, unfinished, word, line): one row per field that is not blank; word is the hash of the last
    word in lower case (null without one), line the hash of the last line's letters."""
    names = ["id", "site", "field", "lengths", "ended", "marked", "unfinished", "word", "capital", "line"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in FIELDS:
                for part in tb.chunks(batch, field):
                    column = part.column(field)
                    lengths = measure(column)
                    canonical = lookalike.canonical_array(column)
                    rows, out = [], []
                    for i, text in enumerate(canonical.to_pylist()):
                        if text and not text.isspace():
                            rows.append(i)
                            out.append(ending(text))
                    if not rows:
                        continue
                    ended, marked, unfinished, word, line = zip(*out)
                    cps, offs = tb.codepoints(pa.array(word, pa.string()))
                    has = offs[1:] > offs[:-1]
                    low = tb.lower_table()[np.minimum(cps, tb.LIMIT)]
                    words = np.zeros(len(rows), np.uint64)
                    words[has] = tb.span_hashes(low, offs[:-1][has], offs[1:][has])
                    cps, offs = tb.codepoints(pa.array(line, pa.string()))
                    kind = tb.classes()[np.minimum(cps, tb.LIMIT)]
                    lines, _ = tb.filtered_hashes(tb.lower_table()[np.minimum(cps, tb.LIMIT)], kind == tb.LETTER, offs[:-1], offs[1:])
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(take), part.column("site").take(take), pa.array([field] * len(rows)),
                         pa.FixedSizeListArray.from_arrays(pa.array(lengths[rows].reshape(-1).astype(np.int32)), len(MEASURES)).cast(pa.list_(pa.int32())),
                         pa.array(ended), pa.array(marked), pa.array(unfinished), pa.array(words.view(np.int64), mask=~has), pa.array([w[:1].isupper() for w in word]), pa.array(lines.view(np.int64))],
                        names)

    kind = records.schema["id"].dataType.simpleString()
    return (records.select("id", F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), *FIELDS)
            .mapInArrow(scan, f"id {kind}, site string, field string, lengths array<int>, ended boolean, marked boolean, unfinished boolean, word bigint, capital boolean, line bigint"))


def word_counts(records: DataFrame) -> DataFrame:
    """(word, text, n, n_ends): every lower-case word with its count, and the count of those before the end of a sentence or line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts = np.zeros(0, np.uint64), []
        counts, ends_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for field in FIELDS:
                for part in tb.chunks(batch, field):
                    cps, offs = tb.codepoints(lookalike.canonical_array(part.column(field)))
                    if not len(cps):
                        continue
                    at = np.minimum(cps, tb.LIMIT)
                    kind, low = tb.classes()[at], tb.lower_table()[at]
                    begin, end = tb.runs((kind == tb.LETTER) | (kind == tb.MARK), offs[:-1][offs[:-1] < len(cps)])
                    if not len(begin):
                        continue
                    h = tb.span_hashes(low, begin, end)
                    last = np.append(cps, 10)
                    final = np.isin(last[end], [46, 33, 63, 10, 13, 0x2026]) | np.isin(end, offs)
                    unique, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    n_ends = np.bincount(inverse, final, len(unique)).astype(np.int64)
                    where = np.searchsorted(hashes, unique)
                    known = where < len(hashes)
                    known[known] = hashes[where[known]] == unique[known]
                    counts[where[known]] += n[known]
                    ends_counts[where[known]] += n_ends[known]
                    new = ~known
                    if new.any():
                        texts_new = [low[a:b].astype(np.uint32).tobytes().decode("utf-32-le", "replace") for a, b in zip(begin[first[new]], end[first[new]])]
                        order = np.argsort(np.concatenate([hashes, unique[new]]), kind="stable")
                        hashes = np.concatenate([hashes, unique[new]])[order]
                        counts = np.concatenate([counts, n[new]])[order]
                        ends_counts = np.concatenate([ends_counts, n_ends[new]])[order]
                        texts = np.concatenate([np.array(texts, object), np.array(texts_new, object)])[order]
                if len(hashes) > 300_000:
                    yield rows(hashes, texts, counts, ends_counts)
                    hashes, texts, counts, ends_counts = hashes[:0], [], counts[:0], ends_counts[:0]
        if len(hashes):
            yield rows(hashes, texts, counts, ends_counts)

    def rows(hashes, texts, counts, ends_counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(texts), pa.string()), pa.array(counts), pa.array(ends_counts)], ["word", "text", "n", "n_ends"])

    return (records.select(*FIELDS).mapInArrow(scan, "word bigint, text string, n bigint, n_ends bigint")
            .groupBy("word").agg(F.first("text").alias("text"), F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends")))


def field_limits(rows: DataFrame) -> DataFrame:
    """(site, field, measure, limit, n_at_limit): the hidden limit of a site's field, where one shows."""
    counted = (rows.select("site", "field", F.posexplode("lengths").alias("m", "length")).groupBy("site", "field", "m", "length").agg(F.count("*").alias("n")))
    order = W.partitionBy("site", "field", "m").orderBy("length")
    around = (F.sum("n").over(order.rangeBetween(-20, 20)) - F.col("n")) / 40
    above = F.sum("n").over(order.rangeBetween(1, W.unboundedFollowing))
    total = F.sum("n").over(W.partitionBy("site", "field", "m"))
    peaks = (counted.select("*", around.alias("around"), F.coalesce(above, F.lit(0)).alias("above"), total.alias("total"))
             .filter((F.col("n") >= 4) & (F.col("n") > 6 * F.col("around") + 3) & ((F.col("above") <= 0.03 * F.col("total")) | (F.col("n") >= 20 * F.col("around")) & (F.col("above") <= 0.25 * F.col("total")))))
    best = peaks.groupBy("site", "field").agg(F.max(F.struct("n", -F.col("m"), "length")).alias("b"))
    names = F.array(*[F.lit(m) for m in MEASURES])
    return best.select("site", "field", F.get(names, -F.col("b.col2")).alias("measure"), (-F.col("b.col2")).alias("m"), F.col("b.length").alias("limit"), F.col("b.n").alias("n_at_limit"))


def judged(records: DataFrame) -> DataFrame:
    """(id, site, field, is_cut, reason): every field that is not blank, one row per record and field."""
    rows = materialise(field_rows(records)).dropDuplicates(["id", "field"])
    rows = materialise(rows)
    limits = field_limits(rows).select("site", "field", "m", "limit")
    repeated = sitelines.template_lines(records, FRAME_PAGES).withColumn("is_frame", F.lit(True))
    words = materialise(word_counts(records).filter(F.col("n") >= 2))
    # words that others begin with: every proper beginning of a frequent word
    beginnings = (words.filter(F.col("n") >= FREQUENT).select(F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("k"), "text", "n").filter("k >= 1 and length(text) > 1")
                  .groupBy(F.expr("substring(text, 1, k)").alias("text")).agg(F.max("n").alias("begins")))
    ends = rows.filter("word is not null and not ended").select("word").distinct()
    known = ends.join(words.select("word", "n", "n_ends"), "word", "left")
    # texts of last words come from the words themselves; one that occurs once is known by its hash only
    begun = beginnings.select(_word_hash(F.col("text")).alias("word"), "begins").groupBy("word").agg(F.max("begins").alias("begins"))
    facts = known.join(begun, "word", "left")
    n, n_ends = F.coalesce("n", F.lit(1)), F.coalesce("n_ends", F.lit(1))
    # a fragment is far rarer than the word it begins, and stands at ends; both hold at every size of the corpus
    partial = F.coalesce((n * FRAGMENT <= F.col("begins")) & (2 * n_ends >= n), F.lit(False))
    facts = facts.select("word", ((n >= KNOWN) & (n_ends < END_SHARE * n)).alias("dangling"), partial.alias("partial"))
    size = F.get(F.col("lengths"), F.col("m"))
    at_limit = F.coalesce((size == F.col("limit")) | (F.col("m").isin(1, 3) & (size > F.col("limit") - 4) & (size <= F.col("limit"))), F.lit(False))
    frame = F.coalesce(F.col("is_frame") & (F.col("field") == "body_text"), F.lit(False))
    reason = (F.when(F.col("marked"), "mark").when(at_limit & ~F.col("ended"), "limit").when(F.col("ended") | frame, None)
              .when(F.col("unfinished"), "sentence").when(F.col("partial"), "word").when(F.col("dangling") & ~F.col("capital"), "dangling"))
    return (rows.join(limits, ["site", "field"], "left").join(repeated, ["site", "line"], "left").join(facts, "word", "left")
            .select("id", "site", "field", reason.alias("reason")).select("id", "site", "field", F.col("reason").isNotNull().alias("is_cut"), "reason"))


def _word_hash(text):
    @F.pandas_udf("bigint")
    def hashed(values):
        import pandas as pd

        cps, offs = tb.codepoints(pa.array(values, pa.string()))
        has = offs[1:] > offs[:-1]
        out = np.zeros(len(values), np.uint64)
        out[has] = tb.span_hashes(cps, offs[:-1][has], offs[1:][has])
        return pd.Series(out.view(np.int64))

    return hashed(text)


def found(records: DataFrame) -> DataFrame:
    """(id, field): fields whose text was cut off. Null and blank fields give no row; repeated rows of a record count once."""
    return judged(records).filter("is_cut").select("id", "field")


def rates(records: DataFrame) -> DataFrame:
    """(site, field, n_values, n_cut, cut_rate): how often each site's field is cut."""
    return (judged(records).groupBy("site", "field").agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"))
            .withColumn("cut_rate", F.col("n_cut") / F.col("n_values")))
