"""Joins without hot keys, sums over ranges, sliding minima and the shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import session
from weft.llm.common import gram_hashes, join_labels, running, sliding


def test_labels_reach_hot_and_other_keys(spark):
    rows = spark.range(6_000).select(F.when(F.col("id") < 4_000, 0).otherwise(F.col("id")).alias("k"), "id")
    labels = rows.groupBy("k").agg(F.count("*").alias("n")).where("k < 5000").withColumn("label", F.concat(F.lit("l"), "k"))
    got = {r["id"]: r["label"] for r in join_labels(rows, labels, ["k"]).collect()}
    assert got == {i: f"l{0 if i < 4_000 else i}" if i < 5_000 else None for i in range(6_000)}
    assert join_labels(rows.limit(0), labels, ["k"]).count() == 0 and join_labels(rows, labels.limit(0), ["k"]).where("label is null").count() == 6_000


def test_running_sums(spark):
    rows = spark.createDataFrame([(x, i * 37 % 101 + 0.5) for i, x in enumerate([None, *"zyxwvutsrqponm"])], "s string, w double")
    got = {r["s"]: (r["place"], r["before"]) for r in running(rows, [F.col("s").asc_nulls_last()], {"before": F.col("w")}).collect()}
    order, total = sorted(rows.collect(), key=lambda r: (r["s"] is None, r["s"] or "")), 0
    for place, r in enumerate(order):
        assert got[r["s"]] == (place, total)
        total += r["w"]
    assert running(rows.limit(0), [F.col("s").asc_nulls_last()], {}).count() == 0


def test_grams_and_minima():
    ids = np.random.default_rng(1).integers(1, 2**63, 300, np.uint64)
    twice = np.concatenate([ids, ids[:50]])
    assert (gram_hashes(twice, 7)[:44] == gram_hashes(twice, 7)[300:]).all() and len(gram_hashes(ids[:6], 7)) == 0
    for width in (1, 2, 7, 300, 301):
        want = [ids[i : i + width].min() for i in range(300 - width + 1)]
        assert sliding(ids, width).tolist() == want


def test_written_rounds_can_be_dropped(spark):
    first = session.cut_lineage(spark.range(5).toDF("x"), "first")
    second = session.cut_lineage(first.withColumn("x", F.col("x") + 1), "second", replaces=first)
    assert sorted(r["x"] for r in second.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception):  # noqa: B017, PT011
        spark.read.parquet(first._written_to).count()
