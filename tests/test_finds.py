"""Relations, chunks and triples found in vectors equal those found sentence by sentence."""

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import finds, relations, tokens
from weft.plans import pipelines, registry

SCHEMA = "doc_id int, sent int, t array<struct<tok int, head int, text string, lemma string, pos_tag string, dep string>>"
WORDS = ("to", "in", "when", "the", "has", "said", "Said", "K", "K", "İ", "ſaid", "é", "", " ,", "a b", None)
TAGS = ("VERB", "NOUN", "PROPN", "ADP", "AUX", "ADJ", "DET", "NUM", "ADV", None)
DEPS = ("nsubj", "nsubjpass", "csubj", "dobj", "obj", "iobj", "prep", "pobj", "amod", "nummod", "acl", "mark", "xcomp", "advmod", "obl", "neg", "prt", "aux", None)
ASKED = {kind: ("to", "has", "the", "in", "when", "k", "said") for kind in ("part", "marker", "function", "spatial", "condition")}


@pytest.fixture(scope="module")
def rows(spark):
    """Random sentences: cycles of heads, heads that are no token, nulls, and tokens that stand twice under one number."""
    rng = random.Random(4)

    def sentence():
        n = rng.randrange(14)
        toks = sorted(rng.choice((range(n), [k + 3 for k in range(n)], [rng.randrange(n) for _ in range(n)])))
        return [(k, rng.choice((toks[0], max(k - 1, 0), k // 2, rng.choice(toks), 99, None, -1)), rng.choice(WORDS), rng.choice(WORDS), rng.choice(TAGS), rng.choice(DEPS)) for k in toks]

    return spark.createDataFrame([(k % 5 or None, k, sentence()) for k in range(1500)], SCHEMA).repartition(3).cache()


def sorted_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("most", [1, 2_000_000])
def test_concepts_in_one_pass(rows, most):
    parsed = tokens.parse(rows)
    want = relations.chunk_properties(parsed)
    for kind, rel in {"part": relations.rel_part_of, "marker": relations.rel_function_marker, "function": relations.rel_function_verb, "spatial": relations.rel_spatial, "condition": relations.rel_condition}.items():
        want = want.unionByName(rel(parsed, ASKED[kind]))
    assert sorted_rows(pipelines.concept_edges(rows, **ASKED, most=most)) == sorted_rows(want.select("doc_id", "sent", "tok", "src", "dst", "rel", "weight"))
    assert {r["rel"] for r in want.select("rel").distinct().collect()} == {"part-of", "function-of", "property-of", "spatial", "condition"}
    got = finds.concepts(rows, **ASKED).where(F.col("rel") == finds.CHUNK).select("doc_id", "sent", "tok", "src", "dst")
    assert sorted_rows(got) == sorted_rows(tokens.noun_chunks(rows).select("doc_id", "sent", "start", T.normalize_np(F.col("chunk")).alias("chunk"), "head_lemma"))


def brute_triples(t):
    """The triples of a parsed sentence, token by token."""
    kids = lambda x, *deps: [t[i] for i in x["kids"] if t[i]["dep"] in deps]
    join = lambda words, sep=" ": sep.join(w for w in words if w is not None)
    text = lambda x: join(t[i]["text"] for i in sorted(k["nth"] for k in t[x["first"] : x["first"] + x["size"]]))
    for x in t:
        if x["pos_tag"] != "VERB" or x["dep"] in (None, "aux"):
            continue
        subject = next(iter(kids(x, "nsubj", "nsubjpass", "csubj")), None)
        items = [(0, k["tok"], -1, text(k)) for k in kids(x, "dobj", "obj", "iobj")]
        items += [(0, p["tok"], o[0]["tok"], join((p["text"], text(o[0])))) for p in kids(x, "prep") if (o := kids(p, "pobj"))]
        items += [(1, k["tok"], -1, text(k)) for k in kids(x, "advmod", "obl") if k["pos_tag"] in ("NOUN", "PROPN", "ADV")]
        neg = kids(x, "neg")
        verb = join([*([neg[-1]["text"]] if neg else []), x["lemma"], *(k["text"] for k in kids(x, "prt"))])
        if subject or items or x["head"] == x["tok"]:
            yield x["tok"], text(subject) if subject else "_", verb, join((i[3] for i in sorted(items, key=lambda i: (*i[:3], i[3].encode()))), "; ") if items else "_"


@pytest.mark.parametrize("most", [1, 2_000_000])
def test_triples_against_brute_force(rows, most):
    parsed = tokens.parse(rows)
    want = sorted(repr((r["doc_id"], r["sent"], *x)) for r in parsed.collect() for x in brute_triples(r["t"]))
    assert sorted_rows(relations.svo_triples(rows, most)) == want and len(want) > 150
    assert sorted_rows(relations.svo_triples(parsed, most)) == want


def test_one_pass_over_sentences(spark, tmp_path):
    """Concepts and triples come from texts in one pass over the sentences: nothing is written, no token comes back with its tree."""
    spark.createDataFrame([(1, "A b c. D e f g! "), (2, "One two three")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("x7_concept_nodes", "x9_svo_triples"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == plan.count("MapInArrow") == 1 and "kids" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
