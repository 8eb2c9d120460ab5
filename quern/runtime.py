"""Session helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where the setting is absent, a temporary folder in local mode (tests), and an error
    on a cluster, whose machines share no such folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    folder = os.path.join(tempfile.gettempdir(), f"quern-{uuid.uuid4().hex}")
    sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and continue from the files, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, group: str, order: str, name: str = "number") -> DataFrame:
    """df with the 0-based position of each row in its group, by order. Ranges of (group, order) are numbered by themselves and moved by
    what comes before them, so that a hot group is no window of one task."""
    from pyspark.sql import Window as W

    ranged = materialise(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(group, "_part").orderBy(order)) - 1
    return ranged.withColumn("_inside", inside).join(offsets, [group, "_part"]).withColumn(name, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset", "_part")


def site_of(url):
    """Host of a URL: lower case, without scheme, credentials, port and a leading www. NULL where there is no host."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.nullif(host, F.lit(""))
