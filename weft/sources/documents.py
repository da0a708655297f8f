"""Sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def load_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a document for each file."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")


def write_kg(result: dict[str, DataFrame], path: str, partition_by: str | None = None, mode: str = "error") -> None:
    """A Parquet table for each of input, splits, relation_schema, nodes and edges (as far as given), that appear together or not at all.

    The tables are written into a folder of their own; then the manifest is replaced, by one rename, to name that folder, and
    the tables before it are deleted. So a write that is killed leaves what was there. Tables that have the column
    `partition_by` are partitioned by it, and conditions on it read only what they need. Tables that are there are an
    error, or as mode says: overwrite, ignore.
    """
    spark = next(iter(result.values())).sparkSession
    old = _manifest(spark, path)
    if old and mode == "ignore":
        return
    if old and mode != "overwrite":
        raise FileExistsError(f"{path} already exists")
    version = f"tables-{uuid.uuid4().hex}"
    for name, df in result.items():
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(f"{path}/{version}/{name}")
    text = json.dumps({"version": version, "tables": sorted(result)})
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    own, at = files.Path(f"{path}/{version}/{MANIFEST}"), files.Path(f"{path}/{MANIFEST}")
    out = own.getFileSystem(conf).create(own)
    out.write(bytearray(text.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    files.FileContext.getFileContext(own.getFileSystem(conf).getUri(), conf).rename(own, at, replace)
    if old:
        before = files.Path(f"{path}/{old['version']}")
        before.getFileSystem(conf).delete(before, True)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """What the manifest says, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def read_kg(spark: SparkSession, path: str, names=None) -> dict[str, DataFrame]:
    """The tables that the manifest names (or those of `names`), as they were written together."""
    found = _manifest(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} holds no tables")
    return {name: spark.read.parquet(f"{path}/{found['version']}/{name}") for name in names or found["tables"]}
