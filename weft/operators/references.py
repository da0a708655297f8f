"""Reference naming with a context that rolls through a document's sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .phrases import rewrite_phrases


def apply_aliases(df: DataFrame, aliases: DataFrame | dict[str, str], column: str = "text") -> DataFrame:
    """Phrases become their entity: aliases(alias, entity), or a few as a dict. Of overlapping phrases the leftmost stands, of one place the longest.

    Whole words in any case; entities are not searched again (see phrases). An alias with several entities takes the least.
    """
    if not isinstance(aliases, DataFrame):
        aliases = df.sparkSession.createDataFrame(list(aliases.items()), "alias string, entity string")
    return rewrite_phrases(df, aliases, "alias", "entity", column=column)


def context_asof(updates: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, pos, path, value): for each sentence the latest value of each path from sentences before it.

    updates: (doc_id, pos, path, value); of several at one place the greatest value stands; a null value is one. Sentences
    are met with the paths of their document that were set before, which makes just the rows of the result, and a window
    over each path carries the values on. Nulls in doc_id, pos or path match nothing.
    """
    paths = updates.where("pos is not null").groupBy("doc_id", "path").agg(F.min("pos").alias("since")).where("path is not null")
    asked = sentences.select("doc_id", "pos").join(paths, "doc_id").where("pos > since").select("doc_id", "path", "pos", F.lit(0).alias("set"), F.lit(None).cast(f"struct<value: {updates.schema['value'].dataType.simpleString()}>").alias("v"))
    given = updates.where("path is not null and pos is not null").select("doc_id", "path", "pos", F.lit(1), F.struct("value"))
    latest = F.last("v", ignorenulls=True).over(Window.partitionBy("doc_id", "path").orderBy("pos", "set", "v").rowsBetween(Window.unboundedPreceding, 0))
    return asked.union(given).withColumn("v", latest).where("set = 0").select("doc_id", "pos", "path", "v.value")


def merge_context(updates: DataFrame) -> DataFrame:
    """(doc_id, path, value): the merged context. The later value of a path wins; a value kills what lies below or above its path before it."""
    last = updates.groupBy("doc_id", "path").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))
    depth = F.size(F.split("path", r"\."))
    up = last.select("doc_id", "path", "pos", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split("path", r"\."), F.lit(1), i), "."))).alias("above"))
    pairs = up.where("above <> path")
    heads = last.select("doc_id", F.col("path").alias("above"), F.col("pos").alias("head_pos"))
    both = pairs.join(heads, ["doc_id", "above"])
    dead = both.where("head_pos >= pos").select("doc_id", "path").union(both.where("head_pos < pos").select("doc_id", "above")).distinct()
    return last.join(dead, ["doc_id", "path"], "left_anti").select("doc_id", "path", "value")


def choose_standardised(sentences: DataFrame, attempts: DataFrame, most: int = 2) -> DataFrame:
    """sentences(doc_id, pos, text) with `standard`: the first non-blank of the first `most` attempts(doc_id, pos, attempt, answer), else the text."""
    good = attempts.where((F.col("attempt") < most) & (F.trim("answer") != "")).groupBy("doc_id", "pos").agg(F.min_by("answer", "attempt").alias("answer"))
    return sentences.join(good, ["doc_id", "pos"], "left").withColumn("standard", F.coalesce("answer", "text")).drop("answer")


def resolve_paired_ends(df: DataFrame, column: str = "text") -> DataFrame:
    """`one end of the X` -> [X.EndA]; a later `the other end` -> [X.EndB] of the latest X of the document."""
    named = F.nullif(F.regexp_extract(column, r"(?i)\bone end of the (\w+)", 1), F.lit(""))
    latest = F.last(named, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    columns = df.columns
    df = df.withColumn("_end_of", latest)
    first = F.regexp_replace(column, r"(?i)\bone end of the (\w+)", "[$1.EndA]")
    other = F.regexp_replace(first, F.lit(r"(?i)\bthe other end\b"), F.concat(F.lit("["), F.col("_end_of"), F.lit(".EndB]")))
    return df.withColumn(column, F.when(F.col("_end_of").isNull(), first).otherwise(other)).select(*columns)
