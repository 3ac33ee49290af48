"""Intermediate tables that end their lineage, and the folder they stand in."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new place in the cluster's shared folder (in one of its own only where none is set, in local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", at)
    at = at.rstrip("/")
    return f"{at if '://' in at else 'file://' + at}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and without its lineage, in the cluster's shared folder (one of its own only where none is set, in local mode)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(at or f"file://{tempfile.mkdtemp()}")
    return df.checkpoint()


def met(df: DataFrame) -> DataFrame:
    """df as a join's side that is sorted and merged, never sent whole to the driver and to all tasks. Of rows that are made (nodes of pages, ancestors of nodes,
    answers to addresses) the optimizer knows only the small file they were made of, and takes them for small."""
    return df.hint("merge")
