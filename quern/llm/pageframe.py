"""Problem 3: the frame of a page (menus, notices, bylines, prompts, pointers) apart from its own text.

Wrapper induction over same-host pages. The text of a page is taken as an ordered tree: the page, its lines, and in a line
the label part before a divider (":", "|", "/", ">" and the like) and the rest. Simple tree matching pairs nodes that carry
the same label; a node that finds its partner on enough pages of the host is constant and belongs to the template, and
what a constant label part introduces is a slot. Since labels match by equality, the pages in which a node is constant
are counted by aggregation over (host, label), which gives what aligning every page with every other would give for the
nodes; copies of one page count as one page (sitelines.copy_votes). Two kinds of node are constant: a line, by the sequence of its letters, and a label part, by that and its divider.
Slots without a label of their own (titles of other pages under a pointer line) are the lines like titles that stand
between template lines, or between one and the end: an own heading has own text after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import liststuff, lookalike, sitelines
from quern.llm import textblocks as tb
from quern.runtime import materialise, site_of

MIN_PAGES, LINE_SHARE, LABEL_SHARE, MAX_LABEL_WORDS = 3, 0.002, 0.01, 5
DIVIDERS = ":|/>»›·•"
TERMINAL = ".!?…。"


def line_nodes(records: DataFrame) -> DataFrame:
    """(page, site, line_no, line, label, title_like, share): the non-blank lines. page and site are 64-bit hashes of the id and the host; line is the hash of the letters (0 without one), label that of the
    part before the first divider (null without one), title_like whether the line may be a title: words, no mark of a sentence's end, no
    bullet, no cells; share is the line's of the page's letters, in millionths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch, "body_text"):
                cps, offs = tb.codepoints(lookalike.canonical_array(part.column("body_text")))
                if not len(cps):
                    continue
                at = np.minimum(cps, tb.LIMIT)
                kind = tb.classes()[at]
                letter = kind == tb.LETTER
                document, number, starts, ends = tb.lines(cps, offs)
                black = np.flatnonzero(kind != tb.SPACE)
                if not len(black):
                    continue
                first = np.searchsorted(black, starts)
                last = np.searchsorted(black, ends)
                some = last > first
                document, number, starts, ends = document[some], number[some], black[first[some]], black[last[some] - 1] + 1
                low = tb.lower_table()[at]
                line, n_letters = tb.filtered_hashes(low, letter, starts, ends)
                # label part: up to the first divider
                divider = np.append(np.flatnonzero(np.isin(cps, [ord(c) for c in DIVIDERS])), len(cps))
                cut = divider[np.searchsorted(divider, starts + 1)]
                has = cut < ends
                stop = np.where(has, cut, starts)
                label, label_letters = tb.filtered_hashes(low, letter, starts, stop)
                with np.errstate(over="ignore"):
                    label = tb.mix(label + cps[np.minimum(cut, len(cps) - 1)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
                begin, end = tb.runs(letter | (kind == tb.MARK), np.zeros(0, np.int64))
                words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
                label_words = np.searchsorted(begin, stop) - np.searchsorted(begin, starts)
                digits = np.zeros(len(cps) + 1, np.int64)
                np.cumsum(kind == tb.DIGIT, out=digits[1:])
                has &= (label_letters > 1) & (label_words <= MAX_LABEL_WORDS) & (label_letters < n_letters)
                at_cut = np.minimum(cut, len(cps) - 2)
                has &= ~((cps[at_cut] == 58) & (cps[at_cut + 1] == 47)) if len(cps) > 1 else False  # "https:" is no label
                final, opening = cps[ends - 1], cps[starts]
                bars = np.zeros(len(cps) + 1, np.int64)
                np.cumsum(np.isin(cps, [124, 9, 123, 125, 59, 61, 40, 41, 64]), out=bars[1:])
                title_like = (words >= 2) & ~np.isin(final, [ord(c) for c in TERMINAL + ",;:)]}\"”%"]) & ~np.isin(opening, [ord(c) for c in "-*•»>“\"{}<#"]) & (bars[ends] == bars[starts])
                rows = pa.array(document)
                share = np.rint(n_letters * 1e6 / np.maximum(np.bincount(document, n_letters, len(part)), 1)[document]).astype(np.int32)
                line = np.where(n_letters > 0, line.view(np.int64), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page").take(rows), part.column("site").take(rows), pa.array(number.astype(np.int32)), pa.array(line),
                     pa.array(label.view(np.int64), mask=~has), pa.array(title_like), pa.array(share)],
                    ["page", "site", "line_no", "line", "label", "title_like", "share"])

    return (records.select(F.xxhash64("id").alias("page"), F.xxhash64(F.coalesce(site_of(F.col("url")), F.lit(""))).alias("site"), "body_text")
            .mapInArrow(scan, "page bigint, site bigint, line_no int, line bigint, label bigint, title_like boolean, share int"))


def constant_nodes(nodes: DataFrame, min_pages: int = MIN_PAGES, line_share: float = LINE_SHARE, label_share: float = LABEL_SHARE) -> DataFrame:
    """(site, node, is_label, n_pages): nodes constant on at least min_pages pages of the host and on that share of its pages, copies
    of a page counted once. Pages are counted by (site, node, page) first, so that no task holds a host."""
    pages = nodes.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    lines = nodes.filter("line != 0").select("site", F.col("line").alias("node"), F.lit(False).alias("is_label"), "page", "share")
    labels = nodes.filter("label is not null").select("site", F.col("label").alias("node"), F.lit(True).alias("is_label"), "page", F.lit(0).alias("share"))
    counted = sitelines.copy_votes(lines.unionByName(labels))
    share = F.when(F.col("is_label"), label_share).otherwise(line_share)
    return counted.filter(F.col("n_pages") >= min_pages).join(pages, "site").filter(F.col("n_pages") >= share * F.col("pages")).drop("pages")


def frame_lines(records: DataFrame) -> DataFrame:
    """(id, line_no): the frame's lines of every page, list pages included. Repeated rows of a record change nothing: their lines fall
    together at the end. Within, pages go by the hash of their id, since ids would be half of what is shuffled."""
    nodes = materialise(line_nodes(records))
    constant = constant_nodes(nodes)
    lines = constant.filter("not is_label").select("site", F.col("node").alias("line"), F.lit(True).alias("line_constant"))
    labels = constant.filter("is_label").select("site", F.col("node").alias("label"), F.lit(True).alias("label_constant"))
    marked = (nodes.drop("share").join(lines, ["site", "line"], "left").join(labels, ["site", "label"], "left")
              .select("page", "line_no", "title_like", F.coalesce("line_constant", "label_constant", F.lit(False)).alias("template")))
    order = W.partitionBy("page").orderBy("line_no")
    solid = F.when(~F.col("title_like") | F.col("template"), F.col("template"))
    marked = (marked.withColumn("before", F.last(solid, True).over(order.rowsBetween(W.unboundedPreceding, -1)))
              .withColumn("after", F.first(solid, True).over(order.rowsBetween(1, W.unboundedFollowing))))
    slot = F.col("title_like") & F.coalesce("before", F.lit(False)) & F.coalesce("after", F.lit(True))
    framed = marked.filter(F.col("template") | slot).select("page", "line_no").distinct()
    return framed.join(records.select("id", F.xxhash64("id").alias("page")).distinct(), "page").select("id", "line_no")


def found(records: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(id, line_no): the frame's lines of pages with own text. Pages of list matter and blank or null bodies give no row; repeated rows of
    a record count once."""
    return frame_lines(records).join(liststuff.found(records, samples), "id", "left_anti")


def main_text(records: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(id, body_text): the own text of every record in its order, one row per id. Blank and null bodies stay."""
    drop = found(records, samples).groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.array_join(F.filter(F.split("body_text", "\n"), lambda line, i: ~F.array_contains(F.col("drop"), (i + 1).cast("int"))), "\n")
    return (records.select("id", "body_text").dropDuplicates(["id"]).join(drop, "id", "left")
            .select("id", F.when(F.col("drop").isNull(), F.col("body_text")).otherwise(kept).alias("body_text")))
