"""Problem 4: pages of repeated keywords, bare links or tags instead of sentences.

Phrases (two successive words of a line) are exploded over all pages and their hosts counted, apart for closed sentences and
for what stands outside of them. A phrase that closed sentences of two or more hosts hold, and that stands in sentences on
at least as many pages as outside of them, is part of the language; the phrases of keywords, tags and link texts are
replicated in lists, or nowhere. Both are counted over all pages, and compared with each other, so that the rule is the same
at every size of the corpus. What a closed sentence is, is told within the page: it ends in a mark, has more words than
dividers, and stands on a page that isn't made of a few words over and over.

This evidence is joined with the page's own: candidates are the pages with more than half of their words outside of closed
sentences or in web addresses, and those of which three words make up a good part. In these a word counts as list matter if
it is part of a web address, or if too few of the words around it in its line belong to a phrase of the language; rows of
tables (cells with numbers) count as neither. The list density of a page is the share of list matter among its words.

Labelled sentences can be given as one more host, for corpora in which a language has one host only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import lookalike
from quern.llm import textblocks as tb
from quern.runtime import materialise, site_of

WINDOW, COVERED, DENSITY, CANDIDATE, CANDIDATE_REPEATED = 5, 0.34, 0.5, 0.5, 0.18
NO_LOW, NO_HIGH = 2**31 - 1, -(2**31)
SENTENCE_WORDS, WORDS_PER_DIVIDER, REPEATED = 4, 4, 0.3
TERMINAL, DIVIDERS = ".!?…。", ",;|/#>»›·•*\t"


def line_words(text: pa.Array):
    """Words of canonical texts with their lines: (hash, word starts, word ends, line index, line arrays, code points, kinds)."""
    cps, offs = tb.codepoints(text)
    at = np.minimum(cps, tb.LIMIT)
    kind = tb.classes()[at]
    document, number, starts, ends = tb.lines(cps, offs)
    begin, end = tb.runs((kind == tb.LETTER) | (kind == tb.MARK), starts[starts < len(cps)])
    hashes = tb.span_hashes(tb.lower_table()[at], begin, end)
    line = np.searchsorted(starts, begin, "right") - 1
    return hashes, begin, end, line, (document, number, starts, ends), cps, kind


def phrase_hashes(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of words i and i + 1, whether both are of one line), one shorter than words."""
    with np.errstate(over="ignore"):
        h = tb.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return h, line[:-1] == line[1:]


def sentence_words(words: np.ndarray, begin: np.ndarray, end: np.ndarray, line: np.ndarray, document: np.ndarray, ends: np.ndarray, cps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a word is in a closed sentence, the number of its sentence, for each page the share of repeated words): a mark of a sentence's end follows in the line, there are
    SENTENCE_WORDS words at least and WORDS_PER_DIVIDER to each divider, and the three words that the page has most often make up at
    most REPEATED of its words (their first occurrences aside)."""
    mark = np.isin(cps, [ord(c) for c in TERMINAL])
    inside = np.append((kind[1:] == tb.LETTER) | (kind[1:] == tb.MARK) | (kind[1:] == tb.DIGIT), False)
    marks = np.append(np.flatnonzero(mark & (~inside | (cps == ord("。")))), len(cps))
    number = np.searchsorted(marks, end)
    closed = marks[number] < ends[line]
    # words and dividers of the sentence, from its first word on
    key = number * 2 + closed
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
    size = np.diff(np.append(first, len(words)))
    dividers = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(np.isin(cps, [ord(c) for c in DIVIDERS]), out=dividers[1:])
    n_dividers = dividers[np.minimum(marks[number[first]], len(cps))] - dividers[begin[first]]
    good = closed[first] & (size >= SENTENCE_WORDS) & (n_dividers * WORDS_PER_DIVIDER <= size)
    # the page's three most frequent words
    page = document[line]
    order = np.lexsort((words, page))
    w, d = words[order], page[order]
    at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])))
    count, owner = np.diff(np.append(at, len(w))), d[at]
    order = np.lexsort((-count, owner))
    count, owner = count[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = np.bincount(owner[rank < 3], (count - 1)[rank < 3], minlength=int(page[-1]) + 1)
    top = top / np.maximum(np.bincount(page), 1)
    good &= (top <= REPEATED)[page[first]]
    return np.repeat(good, size), np.repeat(np.arange(len(first)), size), top


def word_flags(begin: np.ndarray, line: np.ndarray, starts: np.ndarray, ends: np.ndarray, cps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a word is part of a web address, whether it stands in a row of a table: cells divided by bars or tabs, some of them numbers)."""
    web = np.zeros(len(begin), bool)
    if len(cps) > 3:
        at = np.flatnonzero((cps[:-2] == 58) & (cps[1:-1] == 47) & (cps[2:] == 47))
        if len(at):
            first_of, _ = tb.runs(kind != tb.SPACE, starts[starts < len(cps)])
            hit_run = np.zeros(len(first_of), bool)
            hit_run[np.searchsorted(first_of, at, "right") - 1] = True
            web = hit_run[np.searchsorted(first_of, begin, "right") - 1]
    bars = np.zeros(len(cps) + 1, np.int64)
    np.cumsum((cps == 124) | (cps == 9), out=bars[1:])
    digits = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(kind == tb.DIGIT, out=digits[1:])
    table = (bars[ends] - bars[starts] >= 2) & (digits[ends] - digits[starts] > 0)
    return web, table[line]


def list_matter(hit: np.ndarray, line: np.ndarray, web: np.ndarray, table: np.ndarray, window: int = WINDOW, covered_least: float = COVERED) -> np.ndarray:
    """Whether each word is list matter. hit: whether word i and its successor are a phrase of the language; line: ascending numbers."""
    covered = np.zeros(len(line), bool)
    covered[:-1] |= hit[:-1]
    covered[1:] |= hit[:-1]
    first, last = np.searchsorted(line, line, "left"), np.searchsorted(line, line, "right")
    total = np.zeros(len(line) + 1, np.int64)
    np.cumsum(covered, out=total[1:])
    index = np.arange(len(line))
    low, high = np.maximum(index - window, first), np.minimum(index + window + 1, last)
    mean = (total[high] - total[low]) / (high - low)
    return (web | (mean < covered_least)) & ~table


def phrase_rows(pages: DataFrame) -> DataFrame:
    """Rows of two kinds, from one reading of pages (id, site, body_text, sentence).
    phrase set: (phrase, low, high, n_sentence, n_list): the least and the greatest host of the phrase's closed sentences, and on how many
       pages it stands in a closed sentence, or only outside of one. Each task sends a phrase once for every block of its rows. Where
       sentence is set, the whole text counts as one.
    id set: (id, n_words, phrases, layout): the candidates, with the phrase that each word begins (0 at the end of a line) and each word's line and flags."""
    id_kind = pages.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "phrases", "layout", "phrase", "low", "high", "n_sentence", "n_list"]

    def merged(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        low, high = np.minimum.reduceat(rows[:, 1], first), np.maximum.reduceat(rows[:, 2], first)
        n_sentence, n_list = (np.add.reduceat(rows[:, i], first) for i in (3, 4))
        m = len(first)
        return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()), pa.array(rows[first, 0]),
                                           *(pa.array(x.astype(np.int32)) for x in (low, high, n_sentence, n_list))], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            for part in tb.chunks(batch, "body_text"):
                words, begin, end, line, (document, _, starts, ends), cps, kind = line_words(lookalike.canonical_array(part.column("body_text")))
                if len(words) < 2:
                    continue
                sites = part.column("site").to_numpy(zero_copy_only=False)
                sampled = part.column("sentence").to_numpy(zero_copy_only=False)
                h, same = phrase_hashes(words, line)
                good, number, top = sentence_words(words, begin, end, line, document, ends, cps, kind)
                page = document[line]
                inside = good[:-1] & (number[1:] == number[:-1]) | sampled[page[:-1]]
                phrase = np.append(np.where(same, h.view(np.int64), 0), 0)
                # each phrase once a page
                at = np.flatnonzero(same)
                at = at[np.lexsort((~inside[at], page[at], phrase[at]))]
                if len(at):
                    at = at[np.append(True, (phrase[at[1:]] != phrase[at[:-1]]) | (page[at[1:]] != page[at[:-1]]))]
                    host, closed = sites[page[at]].astype(np.int64), inside[at].astype(np.int64)
                    held.append(np.stack([phrase[at], np.where(closed, host, NO_LOW), np.where(closed, host, NO_HIGH), closed, 1 - closed], 1))
                    if sum(map(len, held)) > 1_500_000:
                        yield merged(held, id_type)
                        held.clear()
                # candidates by what the page itself shows
                web, table = word_flags(begin, line, starts, ends, cps, kind)
                n_words = np.bincount(page, minlength=len(part))
                outside = np.bincount(page, (~good | web) & ~table, len(part))
                wanted = (n_words > 1) & ~sampled & ((outside > CANDIDATE * n_words) | (np.pad(top, (0, len(part) - len(top))) > CANDIDATE_REPEATED))
                rows = np.flatnonzero(wanted)
                if len(rows):
                    cuts = np.searchsorted(page, np.arange(len(part) + 1))
                    take = tb.expand(cuts[rows], n_words[rows])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_words[rows])).astype(np.int32)), pa.array(phrase[take]))
                    place = (line.astype(np.int64) << 2 | web.astype(np.int64) << 1 | table.astype(np.int64)).astype(np.int32)
                    layout = pa.array([place[cuts[r] : cuts[r + 1]].tobytes() for r in rows], pa.binary())
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array(n_words[rows].astype(np.int32)), lists, layout, pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int32())] * 4], names)
        if held:
            yield merged(held, id_type)

    hosts = pages.select("id", F.hash("site").alias("site"), "body_text", "sentence")
    return hosts.mapInArrow(scan, f"id {id_kind}, n_words int, phrases array<bigint>, layout binary, phrase bigint, low int, high int, n_sentence int, n_list int")


def densities(records: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_list_words), one row per candidate. samples: sentences (text) that count as a host."""
    kind = records.schema["id"].dataType.simpleString()
    corpus = records.select("id", F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), "body_text", F.lit(False).alias("sentence"))
    if samples is not None:
        corpus = corpus.unionByName(samples.select(F.lit(None).cast(kind).alias("id"), F.lit("#samples").alias("site"), F.col("text").alias("body_text"), F.lit(True).alias("sentence")))
    rows = materialise(phrase_rows(corpus))
    pages = rows.filter("n_words is not null").select("id", "n_words", "phrases", "layout").dropDuplicates(["id"])
    held = pages.select("id", F.explode(F.array_distinct(F.filter("phrases", lambda p: p != 0))).alias("phrase"))
    language = (rows.filter("n_words is null").join(held.select("phrase").distinct(), "phrase", "left_semi").groupBy("phrase")
                .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_sentence").alias("n_sentence"), F.sum("n_list").alias("n_list"))
                .filter((F.col("high") > F.col("low")) & (F.col("n_sentence") >= F.col("n_list"))).select("phrase"))
    known = held.join(language, "phrase").groupBy("id").agg(F.collect_list("phrase").alias("known"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n_words").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            phrase = batch.column("phrases").flatten().to_numpy()
            sizes = batch.column("known").value_lengths().fill_null(0).to_numpy()
            language_of = batch.column("known").flatten().to_numpy()
            with np.errstate(over="ignore"):
                salt = lambda r: r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                hit = (phrase != 0) & np.isin(tb.mix(phrase.view(np.uint64) + salt(row)), tb.mix(language_of.view(np.uint64) + salt(np.repeat(np.arange(len(n)), sizes))))
            place = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("layout")), np.int32).astype(np.int64)
            matter = list_matter(hit, (row << 32) + (place >> 2), (place & 2) > 0, (place & 1) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(np.bincount(row[matter], minlength=len(n)))], ["id", "n_words", "n_list_words"])

    joined = pages.join(known, "id", "left").select("id", "n_words", "phrases", "layout", "known")
    return joined.mapInArrow(judge, f"id {kind}, n_words bigint, n_list_words bigint")


def found(records: DataFrame, samples: DataFrame | None = None, density: float = DENSITY) -> DataFrame:
    """(id): pages with more list matter than density of their words. Null bodies and bodies without a word give no row; repeated rows
    count once."""
    return densities(records, samples).filter(F.col("n_list_words") > density * F.col("n_words")).select("id").distinct()
