"""Small helpers that all operators share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a local session has a temporary folder of its own; on a cluster that would be a folder of one
    machine, so there this raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "loomlog-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Deal the rows of a scan to at least all cores.

    A scan of large input already has more partitions than there are cores and
    is returned as it is, so nothing is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores * per_core else df.repartition(cores * per_core)


def clean_key(c: Column) -> Column:
    """An id as it is compared: without blanks around it, in lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def clean_digest(c: Column) -> Column:
    """A SHA-256 in any of its spellings as 64 lower-case hexadecimal digits; anything else is null."""
    bare = F.regexp_replace(clean_key(c), r"^sha-?256[:=]\s*", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}$"), bare)


def barrier(df: DataFrame) -> DataFrame:
    """Keep the optimizer from inlining the columns computed so far into each later use.

    Predicates are not pushed through a non-deterministic projection, so a
    costly column is computed once per row however often it is used.
    """
    return df.withColumn("_barrier", F.monotonically_increasing_id()).where("_barrier >= 0").drop("_barrier")
