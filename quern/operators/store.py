"""The stored index: generations, segments, manifests, retention, recovery, health.

A generation is a folder of Parquet tables (postings by range of term and id, positions, dictionary with score bounds, block
bounds, document table, statistics). It counts once its manifest row is written; readers take the newest published one, so
that a build that fails halfway is never seen. Segments are smaller sets of documents with the same postings; the latest
segment of a document wins as a whole. All files are in the shared folder of the session or under a root that is given.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import index, search
from quern.runtime import ensure_checkpoint_dir, materialise
from quern.sources import tables

VERSION = 1
BLOCK_DOCUMENTS, SEGMENT_DOCUMENTS, KEEP = 128, 1000, 3
MANIFEST = "generation int, folder string, status string, version int, n_documents bigint, n_terms bigint, checksum string, n_blocks int, created_at timestamp"


@dataclass
class Index:
    """Tables of an opened generation."""

    postings: DataFrame
    positions: DataFrame | None
    dictionary: DataFrame
    blocks: DataFrame
    meta: DataFrame | None
    stats: DataFrame
    n_blocks: int


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time) of what a folder holds; [] where there is none."""
    fs, target = _files(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _files(spark, path)
    fs.delete(target, True)


def block_of(key, n_blocks: int):
    """Range of documents to which an id belongs, the same for every term."""
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def impacts(postings: DataFrame, meta: DataFrame | None, dictionary: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings with impact: what the posting adds to a score for a term of weight 1. Without meta they hold the lengths of their document,
    and the dictionary is a small one that is broadcast."""
    lengths = [f"len_{f}" for f in index.FIELDS]
    if meta is None:
        p = postings.join(F.broadcast(dictionary.select("term", "df")), "term")
    else:
        p = postings.join(meta.select("id", *lengths), "id").join(dictionary.select("term", "df"), "term")
    p = p.crossJoin(F.broadcast(stats.select("n_documents", *[f"avg_{f}" for f in index.FIELDS])))  # stats has one row
    return p.withColumn("impact", search.idf(F.col("df"), F.col("n_documents")) * search.field_score()).drop(*lengths, "df", "n_documents", *[f"avg_{f}" for f in index.FIELDS])


def over_terms(documents: DataFrame, words: DataFrame) -> Index:
    """The index of documents for the terms of words (term) alone: their postings, df and bounds, and the statistics of all documents, are
    those of the full index. Bodies are shuffled once, and only what stands in words is kept of them. Postings hold the columns of their
    document that filters need (meta is None) and are laid out by block, so that joins with a broadcast query side and sums by
    document move nothing. words is broadcast. There are no positions."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{ensure_checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    found = tables.tokens(documents).join(F.broadcast(words.select("term", F.col("term").alias("word"))), "term", "left")
    counts = found.groupBy("id", "word").agg(F.count("*").cast("int").alias("tf"), *[F.count_if(F.col("field") == f).cast("int").alias(f"tf_{f}") for f in index.FIELDS])
    entry = F.struct(F.col("word").alias("term"), "tf", *[f"tf_{f}" for f in index.FIELDS])
    held = counts.groupBy("id").agg(*[F.sum(f"tf_{f}").alias(f"len_{f}") for f in index.FIELDS], F.collect_list(F.when(F.col("word").isNotNull(), entry)).alias("held"))
    meta = index.doc_meta(documents).select("id", "host", "path", "title")
    meta.join(held, "id", "left").fillna(0, [f"len_{f}" for f in index.FIELDS]).write.parquet(folder)
    rows = spark.read.parquet(folder)
    total = sum((F.col(f"len_{f}") for f in index.FIELDS), F.lit(0))
    stats = materialise(rows.agg(F.count("*").alias("n_documents"), *[(F.sum(f"len_{f}") / F.count("*")).alias(f"avg_{f}") for f in index.FIELDS], (F.sum(total) / F.count("*")).alias("avg_length")))
    n_blocks = max(1, -(-int(stats.first()["n_documents"]) // BLOCK_DOCUMENTS))
    laid = rows.withColumn("block", block_of("id", n_blocks)).repartition(n, "block")
    p = laid.select(*[c for c in laid.columns if c != "held"], F.explode("held").alias("x")).select("*", "x.*").drop("x")
    counted = materialise(index.dictionary(p))
    p = impacts(p, None, counted, stats)
    bounds = p.groupBy("term").agg(F.max("impact").alias("bound"))
    blocks = p.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.max("impact").alias("bound"))
    return Index(p, None, materialise(counted.join(bounds, "term", "left")), blocks, None, stats, n_blocks)


def build(documents: DataFrame, root: str) -> int:
    """Write and publish a new generation of the index over documents (one row per id; blank ones are skipped); returns its number."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    done = manifests(spark, root).agg(F.max("generation")).first()[0]
    generation = (done or 0) + 1
    folder = f"{root}/generations/{generation}-{uuid.uuid4().hex}"
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    index.doc_meta(documents).write.parquet(f"{folder}/meta")
    meta = read("meta")
    index.positions(documents).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/positions")
    # counts by field come from the stored positions: the texts are read once
    n = F.size("positions")
    counted = (read("positions").groupBy("term", "id")
               .agg(F.sum(n).cast("int").alias("tf"), *[F.sum(F.when(F.col("field") == f, n).otherwise(0)).cast("int").alias(f"tf_{f}") for f in index.FIELDS]))
    counted.write.parquet(f"{folder}/counts")
    index.dictionary(read("counts")).write.parquet(f"{folder}/words")
    index.stats(read("counts"), meta).write.parquet(f"{folder}/stats")
    n_blocks = max(1, -(-int(read("stats").first()["n_documents"]) // BLOCK_DOCUMENTS))
    scored = impacts(read("counts"), meta, read("words"), read("stats")).withColumn("block", block_of("id", n_blocks))
    scored.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
    blocks = read("postings").groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.max("impact").alias("bound"))
    blocks.sort("term", "block").write.parquet(f"{folder}/blocks")
    bounds = read("blocks").groupBy("term").agg(F.max("bound").alias("bound"))
    read("words").join(bounds, "term", "left").sort("term").write.parquet(f"{folder}/dictionary")
    for name in ("counts", "words"):
        delete(spark, f"{folder}/{name}")
    mark = index.checksum(read("postings"), meta).first()
    publish(spark, root, generation, folder, "ready", mark["n_documents"], mark["n_terms"], mark["checksum"], n_blocks)
    return generation


def publish(spark: SparkSession, root: str, generation: int, folder: str, status: str, n_documents: int, n_terms: int, checksum: str, n_blocks: int) -> None:
    row = spark.range(1).select(
        F.lit(generation).alias("generation"), F.lit(folder).alias("folder"), F.lit(status).alias("status"), F.lit(VERSION).alias("version"), F.lit(n_documents).cast("bigint").alias("n_documents"),
        F.lit(n_terms).cast("bigint").alias("n_terms"), F.lit(checksum).alias("checksum"), F.lit(n_blocks).alias("n_blocks"), F.current_timestamp().alias("created_at"))
    row.coalesce(1).write.parquet(f"{root}/manifest/{generation}")  # fails if another build took the number


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per published generation."""
    folders = [f"{root}/manifest/{name}" for name, _, _ in listing(spark, f"{root}/manifest") if any(n == "_SUCCESS" for n, _, _ in listing(spark, f"{root}/manifest/{name}"))]
    return spark.read.schema(MANIFEST).parquet(*folders) if folders else spark.createDataFrame([], MANIFEST)


def load(spark: SparkSession, root: str, verify: bool = True) -> Index:
    """Open the newest ready generation. With verify the checksum over its documents and terms is computed anew and compared."""
    head = manifests(spark, root).filter("status = 'ready'").orderBy(F.col("generation").desc()).first()
    if head is None:
        raise FileNotFoundError(f"no published index under {root}")
    if head["version"] != VERSION:
        raise ValueError(f"index of version {head['version']}")
    read = lambda name: spark.read.parquet(f"{head['folder']}/{name}")
    out = Index(read("postings"), read("positions"), read("dictionary"), read("blocks"), read("meta"), read("stats"), head["n_blocks"])
    if verify and index.checksum(out.postings, out.meta).first()["checksum"] != head["checksum"]:
        raise ValueError("checksum of the index differs from its manifest")
    return out


def opened(spark: SparkSession, d: str) -> Index:
    """The index of a data directory: built once in the session's shared folder for a state of its raw_documents, then only read."""
    fs, target = _files(spark, f"{d}/raw_documents.parquet")
    status = fs.getFileStatus(target)
    state = listing(spark, f"{d}/raw_documents.parquet") if status.isDirectory() else [(status.getPath().toString(), status.getLen(), status.getModificationTime())]
    key = spark.range(1).select(F.sha2(F.lit(repr((VERSION, d, state))), 256)).first()[0][:24]
    root = f"{ensure_checkpoint_dir(spark)}/index-{key}"
    if not listing(spark, f"{root}/manifest"):
        build(tables.docs(spark, d), root)
    return load(spark, root, verify=False)


# ---- segments


def segment_rows(documents: DataFrame, sequence: int) -> DataFrame:
    """(segment_seq, id, term, tf, ...) of a batch of documents; a document without terms has a row with a null term, so that it replaces
    what earlier segments hold of it."""
    p = index.postings(documents)
    return documents.select("id").join(p, "id", "left").withColumn("segment_seq", F.lit(sequence))


def flush(documents: DataFrame, root: str, sequence: int) -> None:
    """Write a batch of documents as segment number sequence, sorted by term. Repeating a batch replaces its segment."""
    segment_rows(documents, sequence).drop("segment_seq").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{root}/segments/segment_seq={sequence}")


def segments(spark: SparkSession, root: str) -> DataFrame:
    """All segments with segment_seq."""
    names = [n for n, _, _ in listing(spark, f"{root}/segments") if n.startswith("segment_seq=")]
    if not names:
        return spark.createDataFrame([], "id string, term string, tf int, segment_seq int")
    return spark.read.option("basePath", f"{root}/segments").parquet(*[f"{root}/segments/{n}" for n in names])


def merged(rows: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Postings as a reader sees them over all segments: the latest segment of each document wins, deleted documents are gone. tombstones:
    (id, segment_seq), counting for segments up to their own."""
    last = rows.groupBy("id").agg(F.max("segment_seq").alias("segment_seq"))
    if tombstones is not None:
        dead = tombstones.groupBy("id").agg(F.max("segment_seq").alias("dead_seq"))
        last = last.join(dead, "id", "left").filter(F.col("dead_seq").isNull() | (F.col("dead_seq") < F.col("segment_seq"))).drop("dead_seq")
    return rows.join(last, ["id", "segment_seq"], "left_semi").filter("term is not null")


def compact(spark: SparkSession, root: str, tombstones: DataFrame | None = None) -> int:
    """Replace all segments by one with the merged postings; returns its number. The old ones go after the new one is complete."""
    old = [n for n, _, _ in listing(spark, f"{root}/segments") if n.startswith("segment_seq=")]
    if not old:
        return 0
    sequence = max(int(n.split("=")[1]) for n in old) + 1
    merged(segments(spark, root), tombstones).drop("segment_seq").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{root}/segments/segment_seq={sequence}")
    for n in old:
        delete(spark, f"{root}/segments/{n}")
    return sequence


def recover(spark: SparkSession, root: str) -> list[str]:
    """Delete generations without a manifest and segments without a completed write; returns their names."""
    used = {r.folder.rsplit("/", 1)[-1] for r in manifests(spark, root).select("folder").collect()}  # one row a generation
    gone = [n for n, _, _ in listing(spark, f"{root}/generations") if n not in used]
    for n in gone:
        delete(spark, f"{root}/generations/{n}")
    for n, _, _ in listing(spark, f"{root}/segments"):
        if not any(x == "_SUCCESS" for x, _, _ in listing(spark, f"{root}/segments/{n}")):
            delete(spark, f"{root}/segments/{n}")
            gone.append(n)
    return gone


def prune(spark: SparkSession, root: str, keep: int = KEEP) -> list[int]:
    """Drop all but the newest ready generations; returns the numbers that went."""
    rows = manifests(spark, root).orderBy(F.col("generation").desc()).collect()  # one row a generation
    kept = [r.generation for r in rows if r.status == "ready"][:keep]
    out = []
    for r in rows:
        if r.generation not in kept:
            delete(spark, f"{root}/manifest/{r.generation}")
            delete(spark, r.folder)
            out.append(r.generation)
    return sorted(out)


# ---- single documents


def upsert(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after the documents of changed were added or replaced."""
    new = index.postings(changed)
    both = [c for c in new.columns if c in postings.columns]
    return postings.join(changed.select("id"), "id", "left_anti").select(both).unionByName(new.select(both))


def remove(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without the documents of ids; terms without a posting vanish with their last one."""
    return postings.join(ids.select("id"), "id", "left_anti")


def index_actions(documents: DataFrame, active: DataFrame, force: bool = False) -> DataFrame:
    """(id, action) for single documents: indexed, updated, skipped (same fingerprint, unless forced), deleted (no content left), or
    empty (no content, and not in the index)."""
    text = F.concat_ws("", *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "headings", "description", "body_text")])
    new = documents.withColumn("blank", text == "").select("id", "blank").join(index.fingerprints(documents).select("id", "fingerprint"), "id")
    old = active.select("id", F.col("fingerprint").alias("old"))
    action = (F.when(F.col("blank") & F.col("old").isNull(), "empty").when(F.col("blank"), "deleted").when(F.col("old").isNull(), "indexed")
              .when((F.col("old") != F.col("fingerprint")) | F.lit(force), "updated").otherwise("skipped"))
    return new.join(old, "id", "left").select("id", action.alias("action"))


def health(ix: Index, documents: DataFrame) -> DataFrame:
    """One row (status, n_issues, n_documents, n_pending, pending_share): corrupt where a check of the index fails, uninitialized without
    documents, degraded where more than a tenth of the documents wait for indexing, else healthy."""
    issues = index.integrity(ix.postings, ix.meta).agg(F.sum("n_issues").alias("n_issues"))
    n = ix.stats.select("n_documents")
    waiting = documents.agg(F.count_if(F.col("index_status").isin("pending", "stale")).alias("n_pending"), F.count("*").alias("n_all"))
    row = issues.crossJoin(n).crossJoin(waiting)  # one row each
    share = F.when(F.col("n_all") > 0, F.col("n_pending") / F.col("n_all")).otherwise(0.0)
    status = F.when(F.col("n_documents") == 0, "uninitialized").when(F.col("n_issues") > 0, "corrupt").when(share > 0.1, "degraded").otherwise("healthy")
    return row.select(status.alias("status"), "n_issues", "n_documents", "n_pending", F.round(share, 6).alias("pending_share"))
