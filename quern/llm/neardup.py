"""Problem 6: exact join of records whose shingle sets have a Jaccard similarity of at least a threshold.

Jaccard distance is a metric, so records can be divided among pivots and compared within regions only. Whole records make
poor pivots here: nearly all distances between two records lie between 0.95 and 1, and the triangle inequality, whose
windows are as wide as the distance bound of 0.4, separates nothing. The pivots are therefore the sets of one shingle,
rarest first. Their regions are the records that hold the shingle. The distances d(x, {t}) = 1 - 1/|x| or 1 bound how
far a pair can be apart: a pair within the bound shares `matches` of the first |x| - o + matches pivots of either side,
o being the overlap that the bound demands of the two sizes. So a record is replicated to that many regions, each region
is joined by itself, and a pair goes on if enough regions report it; what goes on is compared exactly. No pair within
the bound is lost, and order and sketch decide only how much is compared.

Rarity is read from a sketch of fixed size (sketch_bits) that counts the shingles of all records. A shingle that the
sketch puts above region_rows records is spread over pairs of blocks, so that no task holds a hot region.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm import textblocks as tb
from quern.runtime import materialise

THRESHOLD, WORDS, MATCHES, SKETCH_BITS, REGION_ROWS = 0.6, 3, 6, 20, 50_000
SLICE_BITS, BUCKET_ENTRIES = 14, 500_000


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for part in tb.chunks(batch, "body"):
            hashes, offs = shingles.batch_sets(part.column("title"), part.column("body"), k)
            yield part, hashes, offs


def shingle_sketch(texts: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all shingles in 2**bits cells. What the tasks send is added up in the cluster; the result has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for _, hashes, _ in _sets(batches, k):
            cells += np.bincount((hashes >> np.uint64(shingles.HASH_BITS - bits)).astype(np.int64), minlength=1 << bits)
        cells = np.minimum(cells, 2**31 - 1).astype(np.int32)
        if cells.any():
            rows = cells.reshape(-1, 1 << min(bits, SLICE_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows])], ["slice", "cells"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << min(bits, SLICE_BITS), np.int64)
        for raw in group.cells:
            total += np.frombuffer(raw, np.int32)
        return pd.DataFrame({"slice": group.slice.iloc[:1], "cells": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    rows = texts.mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInPandas(add, "slice int, cells binary").collect()
    cells = np.zeros(1 << bits, np.int32).reshape(-1, 1 << min(bits, SLICE_BITS))
    for r in rows:
        cells[r["slice"]] = np.frombuffer(bytes(r["cells"]), np.int32)
    return cells.reshape(-1)


def required_overlap(size: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil((size + other) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)


def set_signature(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Equal for equal sets; 64 bits of a sum of mixed members."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(tb.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), out=total[1:])
        return tb.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64)


def _block(region: np.ndarray, owner: np.ndarray, at: np.ndarray, side: np.ndarray, sigs: np.ndarray, sizes: np.ndarray) -> bytes:
    """Entries of one bucket, by region, with a table of their sets. Packed by column and compressed."""
    order = np.argsort(region, kind="stable")
    region, owner = region[order], owner[order]
    used, owner = np.unique(owner, return_inverse=True)
    steps = np.diff(region, prepend=np.uint64(0))
    columns = [steps, owner.astype(np.uint32), at[order].astype(np.uint32), side[order].astype(np.uint8), sigs[used], sizes[used].astype(np.uint32)]
    # bytes of equal rank lie together
    packed = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"" for c in columns)
    return struct.pack("<II", len(region), len(used)) + zstandard.ZstdCompressor(level=1).compress(packed)


def _unblock(data: bytes):
    n, m = struct.unpack("<II", data[:8])
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8), 0, []
    for kind, count in ((np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint8, n), (np.int64, m), (np.uint32, m)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + width * count].reshape(width, count).T).view(kind).reshape(-1))
        at += width * count
    steps, owner, position, side, sigs, sizes = out
    return np.cumsum(steps, dtype=np.uint64), sigs[owner], sizes[owner].astype(np.int64), position.astype(np.int64), side


DIAGONAL, LEFT, RIGHT = 0, 1, 2


def region_rows(texts: DataFrame, sketch: np.ndarray, k: int, threshold: float, matches: int, most: int, buckets: int) -> DataFrame:
    """Rows of two kinds. (id, sig, n): each record that has words. (bucket, data): what a task's records put into the regions of a bucket;
    of equal sets in a task only the first does."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    bits = int(len(sketch)).bit_length() - 1
    names = ["id", "sig", "n", "bucket", "data"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = shared.value, set()
        held: list[tuple] = []
        owners: list[tuple] = []
        n_held = n_owners = 0
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            region, owner, at, side = (np.concatenate(x) for x in zip(*held))
            sigs, sizes = (np.concatenate(x) for x in zip(*owners))
            bucket = (tb.mix(region) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                take = order[cuts[b] : cuts[b + 1]]
                if len(take):
                    data = _block(region[take], owner[take], at[take], side[take], sigs, sizes)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], names)
            held.clear()
            owners.clear()

        for part, hashes, offs in _sets(batches, k):
            id_type = part.column("id").type
            n = np.diff(offs)
            sig = set_signature(hashes, offs)
            keep = pa.array(n > 0)
            members = pa.RecordBatch.from_arrays([part.column("id"), pa.array(sig), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
            yield members.filter(keep)
            if len(seen) > 1_000_000:
                seen.clear()  # it only spares work: of equal sets that come again, one is dropped where the bucket is joined
            first = np.array([s not in seen and not seen.add(s) for s in sig.tolist()], bool) & (n > 0) if len(sig) else np.zeros(0, bool)
            row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            count = cells[(hashes >> np.uint64(shingles.HASH_BITS - bits)).astype(np.int64)]
            order = np.argsort(row << np.uint64(48) | np.minimum(count, 65535).astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(shingles.HASH_BITS - 32))
            # one more than needed: two shingles of a record may tie in the key above
            length = np.where(first, np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + matches + 1), 0)
            at = tb.expand(np.zeros(len(n), np.int64), length)
            take = order[tb.expand(offs[:-1], length)]
            owner = np.repeat(np.arange(len(n)), length)
            region, g = hashes[take], -(-count[take].astype(np.int64) // most)
            side = np.zeros(len(region), np.uint8)
            if (g > 1).any():
                copies = np.maximum(g, 1)
                other = tb.expand(np.zeros(len(g), np.int64), copies)
                region, at, owner, g = (np.repeat(x, copies) for x in (region, at, owner, np.maximum(g, 1)))
                block = (sig[owner].view(np.uint64) % g.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(block, other), np.maximum(block, other)
                side = np.where(block == other, DIAGONAL, np.where(block < other, LEFT, RIGHT)).astype(np.uint8)
                with np.errstate(over="ignore"):
                    region = np.where(g > 1, tb.mix(region + (low * g + high + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - shingles.HASH_BITS), region)
            held.append((region, owner + n_owners, at, side))
            owners.append((sig, n))
            n_held += len(region)
            n_owners += len(n)
            if n_held > 1_500_000:
                yield from flush()
                n_held = n_owners = 0
        if n_held:
            yield from flush()

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(assign, f"id {kind}, sig bigint, n int, bucket int, data binary")


def region_pairs(blocks: DataFrame, threshold: float, matches: int, buckets: int, pairs_at_once: int = 400_000) -> DataFrame:
    """(a, b, need, hits): pairs of sets, the number of regions in which they have to meet, and in which they do in this task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unblock(data.as_py()) for batch in batches for data in batch.column("data")]
        if not parts:
            return
        region, sig, n, at, side = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((sig, n, region))
        region, sig, n, at, side = (x[order] for x in (region, sig, n, at, side))
        again = np.zeros(len(region), bool)
        again[1:] = (region[1:] == region[:-1]) & (sig[1:] == sig[:-1])
        region, sig, n, at, side = (x[~again] for x in (region, sig, n, at, side))
        index = np.arange(len(region))
        # sizes ascend within a region: partners end where the larger size exceeds n / threshold
        number = np.cumsum(np.append(False, region[1:] != region[:-1])) if len(region) else index
        key = number * np.int64(1 << 32) + n
        stop = np.searchsorted(key, number * np.int64(1 << 32) + np.floor(n / threshold + 1e-9).astype(np.int64), "right")
        counts = np.maximum(stop - index - 1, 0)
        index, counts = index[counts > 0], counts[counts > 0]
        found: list[np.ndarray] = []
        n_found = 0
        begin, skip = 0, 0
        total = np.concatenate([[0], np.cumsum(counts)])
        while begin < len(index):
            if counts[begin] > pairs_at_once:  # one row with very many partners: some of them at a time
                some = min(pairs_at_once, counts[begin] - skip)
                a = np.repeat(index[begin], some)
                b = index[begin] + 1 + skip + np.arange(some)
                skip += some
                if skip >= counts[begin]:
                    begin, skip = begin + 1, 0
            else:
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + pairs_at_once, "right")) - 1)
                c = counts[begin:end]
                a, b = np.repeat(index[begin:end], c), tb.expand(index[begin:end] + 1, c)
                begin = end
            o = required_overlap(n[a], n[b], threshold)
            need = np.minimum(matches, o)
            ok = (at[a] < n[a] - o + need + 1) & (at[b] < n[b] - o + need + 1) & ((side[a] == DIAGONAL) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            if len(a):
                found.append(np.stack([np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b]), need[ok]], 1))
                n_found += len(a)
            if n_found > 1_000_000:
                yield counted(found)
                found, n_found = [], 0
        if found:
            yield counted(found)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found)
        with np.errstate(over="ignore"):
            key = tb.mix(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64)
        pairs = pairs[np.argsort(key, kind="stable")]
        new = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)))
        hits = np.diff(np.append(new, len(pairs)))
        return pa.RecordBatch.from_arrays([pa.array(pairs[new, 0]), pa.array(pairs[new, 1]), pa.array(pairs[new, 2].astype(np.int32)), pa.array(hits.astype(np.int32))], ["a", "b", "need", "hits"])

    return blocks.repartition(buckets, "bucket").mapInArrow(join, "a bigint, b bigint, need int, hits int")


def id_filter(ids: DataFrame, bits: int = 23) -> np.ndarray:
    """A Bloom filter of fixed size for the values of column id; it only spares work, what passes wrongly is joined away."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, bool)
        for batch in batches:
            cells[batch.column("h").to_numpy() & ((1 << bits) - 1)] = True
        if cells.any():
            rows = np.packbits(cells).reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array([r.tobytes() for r in rows])], ["slice", "cells"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group.cells.iloc[0]), np.uint8)
        for raw in group.cells:
            total |= np.frombuffer(raw, np.uint8)
        return pd.DataFrame({"slice": group.slice.iloc[:1], "cells": [total.tobytes()]})

    out = np.zeros((64, (1 << bits) // 8 // 64), np.uint8)
    hashed = ids.select(F.xxhash64("id").alias("h"))
    for r in hashed.mapInArrow(mark, "slice int, cells binary").groupBy("slice").applyInPandas(merge, "slice int, cells binary").collect():
        out[r["slice"]] = np.frombuffer(bytes(r["cells"]), np.uint8)
    return out.reshape(-1)


def record_sets(texts: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(sig, members) of the records whose id may be in the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    mask = len(wanted) * 8 - 1

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.unpackbits(shared.value).view(bool)

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(cells[batch.column("h").to_numpy() & mask]))

        for _, hashes, offs in _sets(chosen(), k):
            yield pa.RecordBatch.from_arrays([pa.array(set_signature(hashes, offs)), pa.array([hashes[a:b].tobytes() for a, b in zip(offs, offs[1:])], pa.binary())], ["sig", "members"])

    return texts.select("title", "body", F.xxhash64("id").alias("h")).mapInArrow(sets, "sig bigint, members binary")


def similar_sets(texts: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, matches: int = MATCHES, sketch_bits: int = SKETCH_BITS, most: int = REGION_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members (id, sig, n), pairs (a, b, similarity) of different sets). texts has id, title, body."""
    spark = texts.sparkSession
    sketch = shingle_sketch(texts, k, sketch_bits)
    # a bucket is joined by one task: there are as many as the records' entries need, whatever the session's number of partitions
    entries = int(sketch.sum(dtype=np.int64)) * (1 - threshold) + 1
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-entries // BUCKET_ENTRIES)))
    rows = materialise(region_rows(texts, sketch, k, threshold, matches, most, buckets))
    members = rows.filter("bucket is null").select("id", "sig", "n").distinct()
    counted = region_pairs(rows.filter("bucket is not null").select("bucket", "data"), threshold, matches, buckets)
    candidates = materialise(counted.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("hits").alias("hits")).filter("hits >= need").select("a", "b"))
    chosen = candidates.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    one = members.join(chosen, "sig", "left_semi").groupBy("sig").agg(F.min("id").alias("id"))
    sets = record_sets(texts, k, id_filter(one)).join(chosen, "sig", "left_semi").groupBy("sig").agg(F.first("members").alias("members"))
    sets = materialise(sets)
    full = (candidates.join(sets.select(F.col("sig").alias("a"), F.col("members").alias("members_a")), "a")
            .join(sets.select(F.col("sig").alias("b"), F.col("members").alias("members_b")), "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("members_a"), batch.column("members_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                similarity[i] = common / (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similarity)], ["a", "b", "similarity"])

    pairs = full.select("a", "b", "members_a", "members_b").mapInArrow(compare, "a bigint, b bigint, similarity double")
    return members, pairs.filter(F.col("similarity") >= threshold - 1e-12)


def record_texts(records: DataFrame) -> DataFrame:
    return records.select("id", "title", F.col("body_text").alias("body"))


def found(records: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records whose title and body have a similarity of threshold or more. Records without k
    words or with a null or blank body are in no pair; repeated rows of a record count once."""
    members, pairs = similar_sets(record_texts(records), threshold, k)
    members = members.select("id", "sig")
    copies = members.withColumnRenamed("id", "id_a").join(members.withColumnRenamed("id", "id_b"), "sig").filter("id_a < id_b").select("id_a", "id_b")
    others = (pairs.join(members.select(F.col("id").alias("x"), F.col("sig").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("sig").alias("b")), "b")
              .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))
    return copies.unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches. Stars are made larger and smaller in turn until they stay, which
    takes a number of rounds that grows with the logarithm of the longest chain; no round gathers the neighbours of a node."""
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = mark(e)
        if after == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after


def groups(records: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """(id, copy_class, n_links, group_id): one row per record that has words. copy_class is the least id of the records with the same
    set, n_links the number of other sets within the bound, group_id the least id that a chain of pairs reaches."""
    members, pairs = similar_sets(record_texts(records), threshold, k)
    pairs = materialise(pairs.select("a", "b"))
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = members.groupBy("sig").agg(F.min("id").alias("copy_class"))
    links = edges.groupBy(F.col("a").alias("sig")).agg(F.count("*").alias("n_links"))
    reached = materialise(components(pairs).select(F.col("node").alias("sig"), "root"))
    label = reached.join(reached.join(names, "sig").groupBy("root").agg(F.min("copy_class").alias("label")), "root").select("sig", "label")
    return (members.select("id", "sig").join(names, "sig").join(links, "sig", "left").join(label, "sig", "left")
            .select("id", "copy_class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "copy_class").alias("group_id")))
