"""Where tables that a later job reads are put: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="textcohort-")
    return shared_folder.own


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cohort-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The table written and read again, so that later jobs don't recompute it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for at most `rows` rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
