"""Table scans, and tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: the shuffle files of a query go when it has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a purely local session may fall back to a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    with no_shuffles_left(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and reread it, so lost executors cost no recomputation.

    The table stays until the folder is cleared; tables that only lead to another one belong in a Scratch.
    """
    return _write(df, f"{shared_dir(df.sparkSession)}/tallyforge/{tag}-{uuid.uuid4().hex}")


class Scratch:
    """Written tables that lead to a result: removed when dropped or when the block ends, so disk holds the live ones only.

    A result that leaves the block must be read from a table of `written` (or be an action's value), not from a scratch table.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/tallyforge/{tag}-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.base)

    def path(self, tag: str) -> str:
        """A new place in the scratch folder, for files of another format."""
        return f"{self.base}/{tag}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        out = _write(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.paths.pop(id(t), None):
                self._remove(found[1])

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
