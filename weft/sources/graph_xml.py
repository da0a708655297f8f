"""Saved graphs in GEXF: nodes and edges with typed attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_VALUES = "attvalues struct<attvalue: array<struct<_for: string, _value: string>>>"
_DECLARED = "_class string, attribute array<struct<_id: string, _title: string, _type: string>>"


def _typed(value: Column, kind: Column) -> Column:
    """A variant of the declared type; a value that isn't of it, or of a type that isn't known, stays a string."""
    number = F.when(kind.isin("integer", "long", "int"), value.try_cast("bigint").cast("variant")).when(kind.isin("float", "double"), value.try_cast("double").cast("variant"))
    return F.coalesce(number.when(kind == "boolean", value.try_cast("boolean").cast("variant")), value.cast("variant"))


def read_graph_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, label, attributes, file), edges(id, source, target, weight, directed, attributes, file)) of the graphs under path.

    attributes: map of title -> variant of the declared type. Each file is a graph of its own: its nodes' and edges'
    attributes go by its declarations, joined by file, and its edges are directed as they say, else by its default, else not.
    Attributes that are not declared go by their id, as strings; of several values of one title in an element the first
    stands, of several declarations of one id the first by title. Values without a key are left out.
    """

    def read(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("file"))

    each = read("attributes", _DECLARED).select("file", "_class", F.explode("attribute").alias("a")).where("a._id is not null")
    each = each.groupBy("file", "_class", F.col("a._id").alias("id")).agg(F.min(F.struct(F.coalesce("a._title", "a._id").alias("title"), "a._type")).alias("is"))
    declared = each.groupBy("file", "_class").agg(F.map_from_entries(F.collect_list(F.struct("id", "is"))).alias("declared"))
    default = read("graph", "_defaultedgetype string").groupBy("file").agg(F.min("_defaultedgetype").alias("default"))

    def with_attributes(rows: DataFrame, kind: str) -> DataFrame:
        own = rows.join(declared.where(F.col("_class") == kind).drop("_class"), "file", "left")
        values = F.filter(F.coalesce("attvalues.attvalue", F.array().cast("array<struct<_for: string, _value: string>>")), lambda x: x["_for"].isNotNull())
        known = lambda x: F.try_element_at("declared", x["_for"])
        pairs = F.transform(values, lambda x: F.struct(F.coalesce(known(x)["title"], x["_for"]).alias("key"), _typed(x["_value"], F.coalesce(known(x)["_type"], F.lit("string"))).alias("value")))
        firsts = lambda p: F.filter(p, lambda x, i: F.array_position(F.transform(p, lambda y: y["key"]), x["key"]) == i + 1)
        return own.withColumn("attributes", F.map_from_entries(T.let(pairs, firsts)))

    nodes = with_attributes(read("node", f"_id string, _label string, {_VALUES}"), "node")
    edges = with_attributes(read("edge", f"_id string, _source string, _target string, _weight double, _type string, {_VALUES}"), "edge").join(default, "file", "left")
    directed = F.coalesce("_type", "default", F.lit("undirected")) == "directed"
    nodes = nodes.select(F.col("_id").alias("id"), F.col("_label").alias("label"), "attributes", "file")
    return nodes, edges.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_weight").alias("weight"), directed.alias("directed"), "attributes", "file")
