"""The shared folder, and cutting of lineage for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where it is unset, a master of one process (local[...], as in tests) gets a temporary folder of its own; on a cluster
    that is an error, for no local folder is seen by all executors.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def write_once(df: DataFrame, path: str) -> None:
    """Write df as Parquet, and let Spark delete the shuffle files of this write as soon as it is done; else they lie on the disks until the driver collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def cut_lineage(df: DataFrame, name: str = "step", replaces: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a lost executor then costs a reread only.

    replaces: a result of this function that nothing needs any more once df is written; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_once(df, path)
    drop_written(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete the files of a result of cut_lineage; other frames are left alone."""
    at = getattr(df, "_written_to", None) if df is not None else None
    if at:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """A table that grows by rounds, in one folder: each round is written once, and reading all of them is one scan however many there are."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path, self.count = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}", 0
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        """Write a round; `rows` may read those before it."""
        self.count += 1
        write_once(rows, f"{self.path}/round={self.count}")
        self.last = self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.count}")

    @property
    def all(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path).select(*self.schema.names)
        out._written_to = self.path
        return out
