"""Streaming use of the stateless operators: documents that arrive as Parquet files become sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sentences import number_sentences, split_sentences


def stream_sentences(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return number_sentences(split_sentences(spark.readStream.schema(schema).parquet(path)))
