"""Concept trees of many documents at once, in vectors, equal those of the rounds."""

import random

import pytest

from weft.operators import graph
from weft.plans import pipelines


@pytest.fixture(scope="module")
def graphs(spark):
    """Documents with cycles, equal weights, starts that aren't there, that reach nothing, and none; a null document is one like others."""
    rng, edges, starts = random.Random(11), {}, []
    for d in (None, *range(1, 25)):
        n = rng.choice((2, 5, 12))
        name = lambda: rng.choice(("n", "é", "Z")) + str(rng.randrange(n))  # noqa: B023, E731
        for _ in range(rng.choice((1, 8, 40))):
            a, b = name(), name()
            if a != b:
                edges[d, a, b] = (rng.choice(("part-of", "spatial")), float(rng.randrange(4)))
        starts += [(d, name())] if rng.random() < 0.8 else []
    starts += [(90, "alone"), (3, None)]
    edges = spark.createDataFrame([(*k, *v) for k, v in edges.items()], "doc_id int, src string, dst string, rel string, weight double").repartition(3).cache()
    return edges, spark.createDataFrame(starts, "doc_id int, id string")


def test_documents_against_rounds(spark, graphs, monkeypatch):
    columns = ["doc_id", "src", "dst", "rel", "weight", "method"]
    want = sorted(map(repr, pipelines._tree_by_rounds(*graphs).select(*columns).collect()))
    assert sum("best-parent" in x for x in want) > 20 and sum("forest" in x for x in want) > 20
    monkeypatch.setattr(graph, "best_parent_tree", None)  # no rounds
    got = graph.document_trees(*graphs)
    assert sorted(map(repr, got.where("whole").select(*columns).collect())) == want and got.where("not whole").isEmpty()
    assert graph.document_trees(graphs[0].limit(0), graphs[1]).isEmpty()


@pytest.mark.parametrize("most", [1, 6, 30])
def test_large_documents_are_handed_on(spark, graphs, most):
    """Documents of which more than `most` rows wait at once come back as they are, wherever batches part them; the others are done."""
    edges, starts = graphs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = graph.document_trees(edges, starts, most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    large = {r["doc_id"] for r in rows if not r["whole"]}
    assert large and not large & {r["doc_id"] for r in rows if r["whole"]}
    sizes = {}
    for r in edges.collect() + starts.where("id is not null").collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + 1
    assert {d for d, n in sizes.items() if n > 2 * most + 7} <= large <= {d for d, n in sizes.items() if n > most}
    given = sorted(repr(tuple(r)) for r in edges.collect() if r["doc_id"] in large) + sorted(repr(tuple(r)) for r in starts.collect() if r["doc_id"] in large and r["id"])
    back = [r for r in rows if not r["whole"]]
    assert sorted(repr(tuple(r)[:5]) for r in back if r["dst"]) + sorted(repr(tuple(r)[:2]) for r in back if not r["dst"]) == given
    done = sorted(repr(tuple(r)[:6]) for r in rows if r["whole"])
    assert done == sorted(repr(tuple(r)[:6]) for r in graph.document_trees(edges, starts).collect() if r["doc_id"] not in large)


def test_concept_tree_of_large_documents(spark):
    rng = random.Random(12)
    words = lambda n: [(k, rng.choice((0, max(k - 1, 0), k // 2)), w, w, rng.choice(("VERB", "NOUN", "ADP", "ADJ")), rng.choice(("nsubj", "dobj", "prep", "pobj", "amod"))) for k, w in enumerate(rng.choice(("to", "in", "pump", "tank", "has")) for _ in range(n))]
    rows = spark.createDataFrame([(k % 6 or None, k, words(9)) for k in range(60)], "doc_id int, sent int, t array<struct<tok int, head int, text string, lemma string, pos_tag string, dep string>>").cache()
    asked = dict.fromkeys(("part", "marker", "function", "spatial", "condition"), ("to", "in", "has"))
    want, got = (sorted(map(repr, pipelines.concept_tree(rows, most, **asked).collect())) for most in (1_000_000, 1))
    assert got == want and len(want) > 10
