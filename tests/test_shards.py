"""Phrases found in the texts of a shard in vectors: pieces, mentions and rewritten texts equal those of one text after the other."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weft.operators import phrases, references, shards
from weft.plans import registry
from weft.plans.views import Views

WORDS = ["A", "b", "c-d", "É", "x.y", "_z9", "İ", "ΑΣ", "aΣb", "  ", " ", "\t\n", "\x1c", "(", "1", "𝒳y"]


def random_text(rng, n):
    return rng.choice((" ", "")).join(rng.choice(WORDS) for _ in range(n))


def strings(x):
    return pa.array(x, pa.string())


def test_pieces():
    rng = random.Random(5)
    texts = [random_text(rng, rng.randrange(12)) for _ in range(400)]
    cut = shards.Cut(strings(["skipped", *texts]).slice(1))
    keys = ["".join(map(chr, cut.keys[a:b])) for a, b in zip(cut.at, cut.at[1:])]
    for k, text in enumerate(texts):
        assert keys[cut.first[k] : cut.first[k + 1]] == phrases._cut(text)[1]


@pytest.mark.parametrize("keep", [False, True])
@pytest.mark.parametrize("weak", [False, True])
def test_mentions_against_one_text_after_the_other(monkeypatch, keep, weak):
    """weak: hashes that are often equal change nothing."""
    if weak:
        was = shards._hashed
        monkeypatch.setattr(shards, "_hashed", lambda *x: was(*x) & np.uint64(3 << 62))
    rng = random.Random(6)
    for _ in range(40):
        texts = [random_text(rng, rng.randrange(15)) for _ in range(30)]
        table = [(random_text(rng, rng.choice((1, 1, 2, 3, 9))).strip("  \t\n"), rng.choice(("<v>", "wé", None))) for _ in range(60)]
        own = phrases._Phrases(x for x in table if x[0])
        keys = list(own.own)
        first = [phrases._cut(own.own[k][0][0])[1][0] for k in keys]
        found = shards.Table(strings(keys), np.array([own.own[k][1] for k in keys]), shards.hashes(strings(first)), strings([own.own[k][2] for k in keys]))
        assert found.rewritten(strings(texts), keep).to_pylist() == [own.rewritten(x, keep) for x in texts]


def test_white_space_behind_a_blank(spark):
    """A run of white space is one blank, also where it begins with one."""
    texts = spark.createDataFrame([("a \tb a   b",)], "text string")
    assert references.apply_aliases(texts, {"a b": "<AB>", "x \t y": "z"}).first()["text"] == "<AB> <AB>"


def test_alias_table_of_many_shards(spark, tmp_path, monkeypatch):
    """The query gives the same rows whether phrases go along with each task or come to shards, and its phrases cost no shuffle of texts."""
    rng = random.Random(7)
    rows = [(k % 40 or None, ". ".join(" ".join(rng.choice(("Pump", "tank", "é", "valve", "ΑΣ", "x-y", "the")) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(6)))) for k in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    run, was = registry.queries()["r1_alias_table"], references.rewrite_phrases
    want = sorted(map(repr, run(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(references, "rewrite_phrases", lambda *x, **k: was(*x, **k, few=0))
    assert sorted(map(repr, run(spark, str(tmp_path)).collect())) == want and any("<" in x for x in want)
    monkeypatch.setattr(references, "rewrite_phrases", lambda *x, **k: was(*x, **k, few=0, many=0))
    assert sorted(map(repr, run(spark, str(tmp_path)).collect())) == want
    v = Views(spark, str(tmp_path))
    plan = registry._phrases(v.triples_of(v.sents))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
