"""Problem 1: lines and blocks of lines that many documents of one site hold.

Each document is a sequence of line identifiers (site, hash of the line's letters). Lines that fewer than min_documents
documents of the site hold can be in no repeated block and end the runs. Of the rest, the suffixes of every run are put
in order, which is the site's suffix array; neighbours' common prefixes give the blocks. An interval of common prefix 1
is one line; since a third of all rows may hold it, its documents are counted by an aggregation in two steps. Longer
intervals lie within one pair of first lines; equal suffixes are counted together first, by their hashes, so that whole
suffixes are made of distinct runs only; then each partition's sorted suffixes are read as a stream with a stack of open
intervals. An interval whose suffixes all follow the same line is a part of a longer block and isn't reported.
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

MIN_DOCUMENTS, COPY_SHARE = 8, 0.6


def line_rows(records: DataFrame, shares: bool = False) -> DataFrame:
    """(id, site, line_no, line): every line that has a letter, by the hash of its letters in lower case. NULL sites count as one. With shares
    also share, the line's of the body's letters in millionths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.chunks(batch, "body_text"):
                cps, offs = tb.codepoints(lookalike.canonical_array(part.column("body_text")))
                if not len(cps):
                    continue
                at = np.minimum(cps, tb.LIMIT)
                letter = tb.classes()[at] == tb.LETTER
                document, number, starts, ends = tb.lines(cps, offs)
                before = np.zeros(len(cps) + 1, np.int64)
                np.cumsum(letter, out=before[1:])
                some = before[ends] > before[starts]
                document, number = document[some], number[some]
                hashes, n_letters = tb.filtered_hashes(tb.lower_table()[at], letter, starts[some], ends[some])
                rows = pa.array(document)
                columns = [part.column("id").take(rows), part.column("site").take(rows), pa.array(number.astype(np.int32)), pa.array(hashes.view(np.int64))]
                if shares:
                    columns.append(pa.array(np.rint(n_letters * 1e6 / np.bincount(document, n_letters, len(part))[document]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["id", "site", "line_no", "line", "share"][: len(columns)])

    kind = records.schema["id"].dataType.simpleString()
    return (records.select("id", F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), "body_text")
            .mapInArrow(scan, f"id {kind}, site string, line_no int, line bigint" + ", share int" * shares))


def repeated_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(site, line, n_documents): the intervals of common prefix 1 that span enough documents. Counted first by (site, line, document),
    so that a hot line is spread over all partitions."""
    return (rows.select("site", "line", F.xxhash64("id").alias("h")).distinct()
            .groupBy("site", "line").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= min_documents))


def copy_votes(nodes: DataFrame) -> DataFrame:
    """(site, node, is_label, n_pages): on how many pages of the site a node stands, copies of a page together as one. nodes has a row
    (site, node, is_label, page, share) per node of a page: share is that of the node in the page's letters, in millionths. Seen from a node, a page is a
    copy if lines that at least half as many pages hold make up COPY_SHARE of its letters: around the lines of a template every page has a
    text of its own, while copies share that too. Nodes of one page only give no row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("nodes")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes) or not sizes.sum():
                continue
            flat = lists.flatten()
            n, share = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "share"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((-n, owner))
            shared = np.append(0, np.cumsum(share[order]))
            key = (owner << 40) - n  # ascending in that order
            upto = np.searchsorted(key[order], (owner << 40) - (n + 1) // 2, "right")
            mass = shared[upto] - shared[(np.cumsum(sizes) - sizes)[owner]]
            copy = mass >= COPY_SHARE * 1e6
            yield pa.RecordBatch.from_arrays([batch.column("site").take(pa.array(owner)), flat.field("node"), flat.field("is_label"), pa.array(copy)], ["site", "node", "is_label", "copy"])

    one = nodes.groupBy("site", "node", "is_label", "page").agg(F.max("share").alias("share"))
    # the share is read here too, so that both readings of one have the same columns and Spark computes and moves it once
    counted = one.groupBy("site", "node", "is_label").agg(F.count("*").alias("n"), F.max("share").alias("most")).filter("n > 1 and most >= 0").drop("most")
    pages = (one.join(counted, ["site", "node", "is_label"]).groupBy("site", "page")
             .agg(F.collect_list(F.struct("node", "is_label", "n", "share")).alias("nodes")))
    kind = nodes.schema["site"].dataType.simpleString()
    return (pages.mapInArrow(weigh, f"site {kind}, node bigint, is_label boolean, copy boolean").groupBy("site", "node", "is_label")
            .agg((F.count_if(~F.col("copy")) + F.max(F.col("copy").cast("int"))).alias("n_pages")))


def template_lines(records: DataFrame, min_pages: int) -> DataFrame:
    """(site, line): lines on at least min_pages pages of the site, copies of a page counted once."""
    nodes = line_rows(records, True).select("site", F.col("line").alias("node"), F.lit(False).alias("is_label"), F.xxhash64("id").alias("page"), "share")
    return copy_votes(nodes).filter(F.col("n_pages") >= min_pages).select("site", F.col("node").alias("line"))


def repeated_rows(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The rows of line_rows whose line is repeated."""
    return rows.join(repeated_lines(rows, min_documents), ["site", "line"], "left_semi")


def blocks(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(site, lines, n_lines, n_documents): the maximal blocks of two or more repeated lines that follow each other in at least
    min_documents documents, blank lines aside, however long. A block is maximal if no line that precedes or follows all its occurrences
    is repeated with it; parts of it come out only where they occur elsewhere too."""
    from pyspark.sql import Window as W

    repeated = rows.join(repeated_lines(rows, min_documents), ["site", "line"], "left_semi")
    # runs of repeated lines: the ordinal among all lines with letters has no gap
    ordinal = rows.select("id", "line_no").distinct().withColumn("ordinal", F.row_number().over(W.partitionBy("id").orderBy("line_no")))
    runs = materialise(repeated.distinct().join(ordinal, ["id", "line_no"])
                       .withColumn("run", F.col("ordinal") - F.row_number().over(W.partitionBy("id").orderBy("line_no")))
                       .groupBy("site", "id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]).alias("lines"))
                       .filter(F.size("lines") > 1).select("site", F.xxhash64("id").alias("page"), "lines"))
    starts = F.sequence(F.lit(1), F.size("lines") - 1)
    suffix = lambda i: F.slice("lines", i, F.size("lines"))
    counted = (runs.select("site", "page", F.explode(F.transform(starts, lambda i: F.struct(F.xxhash64(suffix(i)).alias("key"), F.get("lines", i - 2).alias("before")))).alias("s"))
               .groupBy("site", "s.key").agg(F.count_distinct("page").alias("n"), F.min("s.before").alias("low"), F.max("s.before").alias("high"), F.max(F.col("s.before").isNull()).alias("open"))
               .select("site", "key", "n", F.when((F.col("low") == F.col("high")) & ~F.col("open"), F.col("low")).alias("before")))
    suffixes = (runs.select("site", "lines").distinct().select("site", F.explode(F.transform(starts, suffix)).alias("suffix")).distinct()
                .withColumn("key", F.xxhash64("suffix")).join(counted, ["site", "key"])
                .select("site", F.element_at("suffix", 1).alias("first"), F.element_at("suffix", 2).alias("second"), "suffix", "n", "before"))
    ordered = suffixes.repartition("site", "first", "second").sortWithinPartitions("site", "suffix")
    return ordered.mapInArrow(_intervals(min_documents), "site string, lines array<bigint>, n_lines int, n_documents bigint")


def _intervals(min_documents: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # stack of open intervals: [length of the common prefix, documents, line before all of them or None]; a document that holds a block twice
        # counts twice here
        stack: list[list] = []
        previous: list[int] = []
        site = None
        out: list[tuple] = []

        def close(down_to: int) -> None:
            while stack and stack[-1][0] > down_to:
                length, count, before = stack.pop()
                if count >= min_documents and length > 1 and before is None:
                    out.append((site, previous[:length], length, count))
                if stack and stack[-1][0] >= down_to and stack[-1][0] > 0:
                    stack[-1][1] += count
                    stack[-1][2] = before if stack[-1][2] == before else None
                elif down_to > 0:
                    stack.append([down_to, count, before])

        for batch in batches:
            for s, suffix, n, before in zip(*(batch.column(c).to_pylist() for c in ("site", "suffix", "n", "before"))):
                common = 0
                if s == site:
                    for x, y in zip(previous, suffix):
                        if x != y:
                            break
                        common += 1
                close(common)
                site, previous = s, suffix
                stack.append([len(suffix), n, before])
            if len(out) > 1000:
                yield _blocks(out)
                out.clear()
        close(0)
        if out:
            yield _blocks(out)

    return scan


def _blocks(out: list[tuple]) -> pa.RecordBatch:
    sites, lines, sizes, counts = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["site", "lines", "n_lines", "n_documents"])


def found(records: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, line_no): the lines of repeated blocks, single lines included. Lines without a letter and null bodies give no row; repeated
    rows of a record count once."""
    rows = materialise(line_rows(records))
    return repeated_rows(rows, min_documents).select("id", "line_no").distinct()


def cleaned(records: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(id, body_text, n_removed): every body without its repeated lines, one row per id. Null bodies stay null."""
    drop = found(records, min_documents).groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.array_join(F.filter(F.split("body_text", "\n"), lambda line, i: ~F.array_contains(F.col("drop"), (i + 1).cast("int"))), "\n")
    return (records.select("id", "body_text").dropDuplicates(["id"]).join(drop, "id", "left")
            .select("id", F.when(F.col("drop").isNull(), F.col("body_text")).otherwise(kept).alias("body_text"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_removed")))
