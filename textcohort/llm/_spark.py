"""What the operators share on the Spark side: tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}
_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a local master without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(shared_folder, "own", None)
    if known is None:
        known = shared_folder.own = tempfile.mkdtemp(prefix="textcohort-")
    return known


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _FOLDERS:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
            pass


class Scratch:
    """Tables written to the shared folder, so that later jobs don't recompute them and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/textcohort-{uuid.uuid4().hex}"
        _FOLDERS.append((spark, self.root))
        self.n = 0

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        with settings(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_parts(self, df: DataFrame, flag: str, **options: str) -> tuple[DataFrame, DataFrame]:
        """The rows where a boolean column is true, and those where it is false, as tables that can be dropped apart."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        with settings(self.spark):
            df.write.options(**options).partitionBy(flag).parquet(path)
        schema, out = df.drop(flag).schema, []
        for value in ("true", "false"):
            part = f"{path}/{flag}={value}"
            where = self.spark._jvm.org.apache.hadoop.fs.Path(part)
            there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
            found = self.spark.read.schema(schema).parquet(part) if there else self.spark.createDataFrame([], schema)
            found._scratch_path = part
            out.append(found)
        return out[0], out[1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _delete(self.spark, t._scratch_path)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., which can't clash with an operator's own, and the new names by the old."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def renamed(names: dict[str, str]) -> list[Column]:
    """Columns that give a numbered table its names back."""
    return [F.col(n).alias(c) for c, n in names.items()]


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast if the table has at most `rows` rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """For one statement: its shuffle files are deleted when it ends, not at some later collection of
    the driver's garbage, and Arrow batches of texts are a few megabytes, which bounds a task's memory.
    """
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
