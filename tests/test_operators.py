"""Rules of the operators on small fixtures whose answers were worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import answers, graph, kg, references, relations, sentences, tokens
from weft.plans import pipelines
from weft.sources import documents, graph_xml
from weft.streaming.sentences import stream_sentences

SENTENCES = [
    "The/the/DET/det>1 tank/tank/NOUN/nsubj>2 includes/include/VERB/ROOT>2 a/a/DET/det>5 red/red/ADJ/amod>5 pump/pump/NOUN/dobj>2 ./././PUNCT/punct>2",
    "Said/said/DET/det>1 controller/controller/NOUN/nsubjpass>3 is/be/AUX/auxpass>3 configured/configure/VERB/ROOT>3 to/to/PART/aux>5 open/open/VERB/xcomp>3 the/the/DET/det>7 valve/valve/NOUN/dobj>5 if/if/SCONJ/mark>10 water/water/NOUN/nsubj>10 rises/rise/VERB/advcl>5",
    "A/a/DET/det>1 sensor/sensor/NOUN/nsubj>6 adapted/adapt/VERB/acl>1 to/to/PART/aux>4 measure/measure/VERB/xcomp>2 flow/flow/NOUN/dobj>4 sits/sit/VERB/ROOT>6 in/in/ADP/prep>6 the/the/DET/det>9 pipe/pipe/NOUN/pobj>7",
]


@pytest.fixture(scope="module")
def toks(spark):
    rows = []
    for sent, line in enumerate(SENTENCES):
        for tok, word in enumerate(line.replace("./././", "././").split()):
            left, head = word.rsplit(">", 1)
            text, lemma, pos, dep = left.rsplit("/", 3)
            rows.append((1, sent, tok, int(head), text, lemma, pos, dep))
    return spark.createDataFrame(rows, "doc_id bigint, sent int, tok int, head int, text string, lemma string, pos_tag string, dep string")


@pytest.fixture(scope="module")
def parsed(toks):
    return toks, tokens.parse(toks), tokens.noun_chunks(toks)


def edges(df):
    return {tuple(r) for r in df.select("src", "dst", "rel", "weight").collect()}


def test_relations(parsed):
    toks, parsed, chunks = parsed
    sensor = "A sensor adapted to measure flow"
    assert edges(relations.rel_part_of(parsed)) == {("The tank", "a red pump", "part-of", 3.0)}
    assert edges(relations.rel_function_marker(parsed)) >= {(sensor, "adapt", "function-of", 2.0)}
    assert ("the controller", "open", "function-of", 2.0) in edges(relations.rel_function_verb(parsed))
    assert edges(relations.rel_property(toks, chunks)) == {("a red pump", "red", "property-of", 1.0)}
    assert edges(relations.rel_spatial(parsed)) == {(sensor, "the pipe", "spatial", 1.0)}
    assert edges(relations.rel_condition(parsed)) == {("water", "if water rises", "condition", 1.0)}


def test_svo(parsed):
    got = {(r["subject"], r["verb"], r["object"]) for r in relations.svo_triples(parsed[1]).collect()}
    assert got >= {("The tank", "include", "a red pump"), ("Said controller", "configure", "_"), ("_", "open", "the valve"), ("water", "rise", "_"), ("_", "measure", "flow"), ("A sensor adapted to measure flow", "sit", "in the pipe")}


def test_spans(spark):
    spans = spark.createDataFrame([(1, 0, 0, 9, ["S"]), (1, 0, 2, 5, ["SBAR"]), (1, 0, 6, 9, ["NP"]), (1, 1, 0, 3, ["NP"])], "doc_id int, sent int, start int, end int, labels array<string>")
    assert [(r["sent"], r["start"], r["end"]) for r in sentences.top_level_spans(spans).collect()] == [(0, 0, 9)]
    words = spark.createDataFrame([(1, 0, 9), (1, 1, 3)], "doc_id int, sent int, n_words int")
    finite = spark.createDataFrame([(1, 0)], "doc_id int, sent int")
    assert sentences.fallback_full_sentence(words, finite).count() == 0
    assert [r["sent"] for r in sentences.fallback_full_sentence(words, finite.where("false")).collect()] == [0]


def test_answers(spark):
    raws = ['{"sentences":["a","b"]}', 'sure: {"sentences":["a"]} bye', '{"sentences":["a",1]}', '{"sentences":"a"}', "no json", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r["s"] for r in df.orderBy("i").select(answers.answer_sentences(answers.parse_json_answer(F.col("raw"))).alias("s")).collect()]
    assert got == [["a", "b"], ["a"], ["a"], [], [], [], []]
    tries = {"p": [[], ["x", "y"], ["z"]], "q": [[" "], ["k"], ["m"]], "r": [[], [], []]}
    import json

    rows = [(1, k, i, json.dumps({"sentences": s})) for k, v in tries.items() for i, s in enumerate(v)]
    responses = spark.createDataFrame(rows, "doc_id int, request_id string, attempt int, raw string")
    got = answers.first_valid_attempt(responses.select("doc_id", "request_id").distinct(), responses)
    assert {r["request_id"]: r["answer"] for r in got.collect()} == {"p": "z", "q": "k", "r": ""}


def test_context(spark):
    updates = spark.createDataFrame([(1, 0, "pipe.type", "part"), (1, 0, "pipe.links", '["a"]'), (1, 1, "pipe.links", '["b"]'), (1, 3, "tank", "T"), (1, 4, "pipe", "P")], "doc_id int, pos int, path string, value string")
    assert {(r["path"], r["value"]) for r in references.merge_context(updates.where("pos < 2")).collect()} == {("pipe.type", "part"), ("pipe.links", '["b"]')}
    assert {(r["path"], r["value"]) for r in references.merge_context(updates).collect()} == {("pipe", "P"), ("tank", "T")}
    asof = references.context_asof(updates, spark.createDataFrame([(1, 0), (1, 2)], "doc_id int, pos int")).collect()
    assert {(r["pos"], r["path"], r["value"]) for r in asof} == {(2, "pipe.type", "part"), (2, "pipe.links", '["b"]')}


@pytest.fixture(scope="module")
def small_graph(spark):
    rows = [("a", "b", "spatial", 1.0), ("a", "b", "part-of", 3.0), ("a", "b", "function-of", 3.0), ("a", "a", "spatial", 1.0), ("b", "c", "property-of", 1.0), ("a", "c", "part-of", 3.0), ("c", "d", "spatial", 1.0), ("e", "f", "spatial", 1.0)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, dst string, rel string, weight double, pos int")


def test_graph(spark, small_graph):
    strong = graph.strongest_edges(small_graph)
    assert edges(strong) == {("a", "b", "part-of", 3.0), ("b", "c", "property-of", 1.0), ("a", "c", "part-of", 3.0), ("c", "d", "spatial", 1.0), ("e", "f", "spatial", 1.0)}
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    deg = graph.degrees(nodes, strong)
    assert {r["id"]: (r["degree"], r["in_degree"]) for r in deg.collect()} == {"a": (2, 0), "b": (2, 1), "c": (3, 2), "d": (1, 1), "e": (1, 0), "f": (1, 1), "g": (0, 0)}
    assert [r["id"] for r in graph.root_by_degree(deg).collect()] == ["c"]
    boosted = graph.boost_part_of(strong)
    tree = graph.best_parent_tree(boosted)
    assert {(r["src"], r["dst"]) for r in tree.collect()} == {("a", "b"), ("a", "c"), ("c", "d"), ("e", "f")}
    root = spark.createDataFrame([("a",)], "id string")
    assert {r["id"] for r in graph.reachable(strong, root).collect()} == set("abcd")
    parts = graph.connected_components(strong)
    assert {r["id"]: r["component"] for r in parts.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}
    assert graph.largest_component(parts).count() == 4
    forest = graph.maximum_spanning_forest(boosted).collect()
    assert {(r["u"], r["v"]) for r in forest} == {("a", "b"), ("a", "c"), ("c", "d"), ("e", "f")} and sum(r["weight"] for r in forest) == 18
    assert [(r["id"], r["depth"]) for r in graph.tree_rows(tree, root).orderBy("path").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_best_parents_with_a_cycle(spark):
    rows = [("x", "y", 3.0), ("y", "z", 2.0), ("z", "x", 1.0), ("r", "x", 0.5)]
    df = spark.createDataFrame([(a, b, "rel", w, 0) for a, b, w in rows], "src string, dst string, rel string, weight double, pos int")
    assert {(r["src"], r["dst"]) for r in graph.best_parent_tree(df).collect()} == {("x", "y"), ("y", "z"), ("r", "x")}


def test_votes(spark):
    votes = [(1, "s1", "a", "b", "p", x) for x in "xyy"] + [(2, "s1", "a", "b", "p", x) for x in "xy"] + [(3, "s1", "a", "b", "p", "")]
    df = spark.createDataFrame([(*r, 0, v) for v, r in enumerate(votes)], "doc_id int, sid string, subject string, object string, surface_pred string, canonical_pred string, pos int, v int")
    assert {r["doc_id"]: (r["predicate"], r["confidence"]) for r in kg.majority_predicate(kg.tally_votes(df)).collect()} == {1: ("y", 0.666667), 2: ("x", 0.5)}
    triples = spark.createDataFrame([(3, 0, "s1", "The a", "b", "is in")], "doc_id int, pos int, sid string, subject string, object string, surface_pred string")
    assert kg.fallback_edges(triples, df).count() == 0
    only = kg.fallback_edges(triples, df.where("doc_id < 3")).first()
    assert (only["subject"], only["object"], only["predicate"], only["confidence"]) == ("", "b", "custom_is_in", 0.4)


def test_annotated_mentions(spark):
    splits = spark.createDataFrame([(1, "s1", "The red pump drives a Pump and pumps."), (1, "s2", "axb, a.b"), (1, "s3", "nothing"), (1, "s4", None), (2, "s1", "a red pump")], "doc_id int, sid string, text string")
    entities = spark.createDataFrame([(1, "pump", "E1"), (1, "red pump", "E2"), (1, "a.b", "E3"), (2, "pump", "E1")], "doc_id int, label string, id string")
    got = {(r["doc_id"], r["sid"]): r["text"] for r in kg.annotate_refs(splits, entities).collect()}
    assert got == {(1, "s1"): "The red pump[Ref:E2] drives a Pump[Ref:E1] and pumps.", (1, "s2"): "axb, a.b[Ref:E3]", (1, "s3"): "nothing", (1, "s4"): None, (2, "s1"): "a red pump[Ref:E1]"}


def test_clauses_of_three_levels(spark):
    """Punctuation, markers and conjuncts cut one sentence; a conjunct of another clause's root doesn't."""
    text = "The pump runs and  stops ;it heats wherein valves open, and close and leak: done"
    words = "The>1 pump>2 runs>2 and>4 stops>2:conj ;>2 it>7 heats>2 wherein>10 valves>10 open>7 ,>12 and>13 close>10:conj and>15 leak>10:conj :>2 done>2:conj"
    rows = [(1, 0, k, int(w.split(">")[1].split(":")[0]), w.split(">")[0], "conj" if w.endswith(":conj") else "x") for k, w in enumerate(words.split())]
    toks = spark.createDataFrame(rows + [(None, 0, k, 0, w, "conj" if k else "ROOT") for k, w in enumerate(["a", "b"])], "doc_id bigint, sent int, tok int, head int, text string, dep string")
    df = spark.createDataFrame([(1, 0, text, "x", 7), (1, 1, "no tokens: here", "x", 7), (1, 2, None, "x", 7), (1, 3, " ", "x", 7), (None, 0, "a b", "x", 7)], "doc_id bigint, pos int, text string, at string, part int")
    got = sorted(((r["doc_id"], r["pos"], r["part"], r["clause"]) for r in sentences.split_clauses(df, tokens=toks).collect()), key=str)
    want = ["The pump runs and", "stops", "it heats", "wherein valves open, and", "close and", "leak", "done"]
    assert got == sorted([*((1, 0, k, c) for k, c in enumerate(want)), (1, 1, 0, "no tokens"), (1, 1, 1, "here"), (None, 0, 0, "a"), (None, 0, 1, "b")], key=str)
    long = spark.createDataFrame([(1, 0, "ab " * 30_000)], "doc_id bigint, pos int, text string")
    many = spark.range(30_000).selectExpr("1L as doc_id", "0 as sent", "id as tok", "0 as head", "'ab' as text", "if(id in (7, 29999), 'conj', 'x') as dep")
    assert [len(r["clause"].split()) for r in sentences.split_clauses(long, tokens=many).orderBy("part").collect()] == [7, 29_992, 1]
    plain = sentences.split_clauses(df, tokens=toks.limit(0))
    assert sorted(map(str, plain.collect())) == sorted(map(str, sentences.split_clauses(df).collect()))


def test_mentions_beside_punctuation_and_inside_tags(spark):
    schema = "doc_id bigint, sid string, text string, by string, h string, spans string"
    splits = spark.createDataFrame([(1, "s1", "The pump, runs. A valve; (pump)", *"xyz"), (2, "s1", "the pump runs and ref is E1", *"xyz"), (None, "s1", "a  pump", *"xyz"), (2, "s1", "the pump runs and ref is E1", *"xyz"), (3, "s1", "pump", *"xyz")], schema)
    entities = spark.createDataFrame([(1, "pump", "E1"), (1, "valve", "E2"), (2, "pump", "E1"), (2, "ref", "E2"), (2, "e1", "E3"), (None, "a pump", "E9"), (1, " ", "E7"), (1, None, "E8")], "doc_id bigint, label string, id string")
    out = kg.annotate_refs(splits, entities)
    assert out.columns == splits.columns
    both = (2, "the pump[Ref:E1] runs and ref[Ref:E2] is E1[Ref:E3]")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "The pump[Ref:E1], runs. A valve[Ref:E2]; (pump[Ref:E1])"), both, both, (None, "a  pump[Ref:E9]"), (3, "pump")], key=str)
    assert [r["text"] for r in kg.annotate_refs(splits, entities.limit(0)).where("doc_id = 3").collect()] == ["pump"] and kg.annotate_refs(splits.limit(0), entities).count() == 0


def test_phrases_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "B", "ab", "ñ", "(", ".", "a1", "_"])
    texts = ["".join(word() + rnd.choice(["", " ", "  "]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    aliases = {"".join(word() + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 4))).strip(): f"<{k}>" for k in range(60)}
    table = {}
    for alias, entity in sorted(aliases.items(), reverse=True):  # the first of those that are equal but for case stands
        table[alias.lower()] = entity

    def rewritten(text):
        parts, out, at = re.findall(r"\w+|\s+|[^\w\s]", text), "", 0
        while at < len(parts):
            for n in range(len(parts) - at, 0, -1):
                found = table.get("".join(" " if p.isspace() else p.lower() for p in parts[at : at + n]))
                if found:
                    out, at = out + found, at + n
                    break
            else:
                out, at = out + parts[at], at + 1
        return out

    got = references.apply_aliases(spark.createDataFrame([(t,) for t in texts], "text string"), aliases)
    assert sorted(r[0] for r in got.collect()) == sorted(map(rewritten, texts))


def test_many_aliases(spark):
    """A hundred thousand aliases, most of one first word, cost joins and no pattern each."""
    aliases = spark.range(100_000).selectExpr("concat('the part ', id) as alias", "concat('<P', id, '>') as entity")
    texts = spark.range(2000).selectExpr("concat('The  part ', id * 7, ', the part x and THE PART ', id, '.') as text", "id")
    got = references.apply_aliases(texts, aliases)
    assert got.where("text <> concat('<P', id * 7, '>, the part x and <P', id, '>.')").count() == 0 and got.count() == 2000


def test_spans_against_brute_force(spark):
    """Containment and finite verbs of random spans, with equal extents, nulls and other columns."""
    rnd = random.Random(11)
    rows = [(rnd.choice([1, None]), rnd.randrange(12), a, None if rnd.random() < 0.05 else a + rnd.randrange(12), rnd.choice([["S"], ["SBAR", "VP"], ["NP"]]), k) for k in range(400) for a in [rnd.randrange(20)]]
    spans = spark.createDataFrame(rows, "doc_id bigint, sent int, start int, end int, labels array<string>, _at int")
    clause = [r for r in rows if r[4] != ["NP"]]
    held = lambda a, b: a[:2] == b[:2] and None not in (a[3], b[3]) and b[2] <= a[2] and a[3] <= b[3] and a[2:4] != b[2:4]
    got = sentences.top_level_spans(spans)
    assert got.columns == spans.columns and {r[5] for r in got.collect()} == {a[5] for a in clause if not any(held(a, b) for b in clause)}
    toks = [(d, s, t, rnd.random() < 0.2, rnd.choice(["VERB", "AUX", "NOUN"])) for d in (1, None) for s in range(12) for t in range(30)]
    finite = sentences.finite_spans(spans, spark.createDataFrame(toks, "doc_id bigint, sent int, tok int, finite boolean, pos_tag string"))
    want = {a[5] for a in rows if a[3] is not None and a[3] - a[2] > 2 and any(t[:2] == a[:2] and t[3] and t[4] != "NOUN" and a[2] <= t[2] < a[3] for t in toks)}
    assert finite.columns == spans.columns and {r[5] for r in finite.collect()} == want
    # one sentence with very many nested spans: a sort, no pairs
    many = spark.range(200_000).selectExpr("1L as doc_id", "0 as sent", "cast(id as int) as start", "cast(400000 - id as int) as end", "array('S') as labels")
    assert [tuple(r)[2:4] for r in sentences.top_level_spans(many).collect()] == [(0, 400000)]
    verbs = spark.range(200_000).selectExpr("1L as doc_id", "0 as sent", "cast(id * 3 as int) as tok", "id % 2 = 0 as finite", "'VERB' as pos_tag")
    assert sentences.finite_spans(many, verbs).count() == 199_999  # the last has two tokens


def test_attempts_and_their_retries(spark):
    raw = [(0, '{"sentences": ["a", ""]}'), (1, '{"sentences": [" ", 3]}'), (2, 'so {"sentences": ["  b "]} ok'), (3, '{"sentences": ["c"]}')]
    rows = [(1, "r", k, x) for k, x in raw] + [(2, "r", 0, "no"), (2, "r", 1, None), (3, "r", 0, '{"sentences": ["x"]}'), (3, "r", 1, "no")]
    responses = spark.createDataFrame(rows, "doc_id bigint, request_id string, attempt int, raw string")
    got = answers.first_valid_attempt(responses.select("doc_id", "request_id").distinct(), responses)
    assert {(r["doc_id"], r["answer"]) for r in got.collect()} == {(1, "b"), (2, ""), (3, "x")}
    assert {tuple(r) for r in answers.retry_rows(responses).collect()} == {(1, "r", 0, 2), (1, "r", 1, 1), (2, "r", 0, 0), (2, "r", 1, 0)}
    pairs = spark.createDataFrame([('{"sentence1": "a", "sentence2": "b"}',), ('{"sentence2": "b", "sentence1": ""}',), ('{"sentence1": " ", "x": 1}',), ("[1]",), ("so {}",), ("{}",), (None,)], "raw string")
    assert [r[0] for r in pairs.select(answers.answer_pair(F.col("raw"), F.lit(" t "))).collect()] == [["a", "b"], ["b"], [" "], ["t"], ["t"], [], ["t"]]


def test_audit_totals(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([(1, 0, "ab", "ab"), (1, 1, "abc", "a"), (2, 0, None, None)], "doc_id bigint, pos int, original string, cleaned string").repartition(3)
    seen, none = Observation(), Observation()
    assert answers.cleaning_audit(rows, seen).count() == 3 and len(answers.cleaning_audit(rows.limit(0), none).collect()) == 0
    assert seen.get == {"n_sentences": 3, "n_changed": 1, "chars_before": 5, "chars_after": 3}
    assert none.get == {"n_sentences": 0, "n_changed": 0, "chars_before": 0, "chars_after": 0}


def test_dedupe_strips_and_drops_blanks(spark):
    df = spark.createDataFrame([(1, 0, " "), (1, 1, "A b ."), (1, 2, " a b. "), (1, 3, None), (2, 0, "a b.")], "doc_id bigint, pos int, text string")
    assert {tuple(r) for r in sentences.dedupe_ci(df).collect()} == {(1, 1, "A b."), (2, 0, "a b.")}


def test_concept_tree(toks):
    alone = toks.where("sent = 2").withColumn("doc_id", F.lit(2).cast("bigint"))
    got = {tuple(r) for r in pipelines.concept_tree(toks.unionByName(alone)).collect()}
    # document 1: below its first head, the tank; of the other concepts none is reached
    assert {r for r in got if r[0] == 1} == {(1, "The tank", "a red pump", "part-of", 8.0, "best-parent"), (1, "a red pump", "red", "property-of", 1.0, "best-parent")}
    # document 2: no edge leaves "A sensor" itself, so the forest of all its edges stands; its pairs have no direction
    sensor = "A sensor adapted to measure flow"
    assert {r for r in got if r[0] == 2} == {(2, sensor, "adapt", None, 2.0, "forest"), (2, sensor, "the pipe", None, 1.0, "forest")}
    assert all(r[5] == "forest" for r in got if r[0] == 2)


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.scrub_boilerplate, "According to the present invention , said pump should run.", "According to, pump run."),
        (T.scrub_boilerplate, "according to present invention it may be so", "it so"),
        (T.normalize_np, " said  tank , ;", "the tank"),
        (T.simple_label, "The lid of a tank", "lid tank"),
        (T.predicate_slug, " Is Part-of! ", "custom_is_part_of"),
        (T.ensure_final_period, " a ", "a."),
        (T.standardise_figures, "see FIG.1 and FIG 2", "see <FIG_1> and <FIG_2>"),
        (T.normalize_units, "5mm wide", "5 mm wide"),
        (T.normalize_synonyms, "the control unit and the Controller", "the <CONTROL_UNIT> and the <CONTROL_UNIT>"),
        (T.tag_modality, "it must", "requirement"),
        (T.extract_condition, "open if water rises", "if water rises"),
    ],
)
def test_text(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t"))).first()[0] == want


def test_clauses(spark):
    cut = lambda parts, t: spark.createDataFrame([(t,)], "t string").select(parts(F.col("t"))).first()[0]
    assert cut(sentences.punct_parts, "; a: b;") == ["; a", " b;"]
    assert cut(sentences.punct_parts, "ratio 3:1") == ["ratio 3", "1"]
    assert cut(sentences.marker_parts, "a  b wherein c Thereby d") == ["a b", "wherein c", "Thereby d"]
    assert cut(sentences.marker_parts, "a  b") == ["a  b"]
    got = sentences.split_sentences(spark.createDataFrame([(1, "Mr. A. Smith runs. It\nstops!  ")], "doc_id int, text string")).orderBy("pos").collect()
    assert [r["s"] for r in got] == ["Mr", "A. Smith runs", "It stops"]
    ok, lost = sentences.refine_splits(spark.createDataFrame([(1, 0, "one two three four five six; a b")], "doc_id int, pos int, text string"), max_len=28)
    assert [r["text"] for r in ok.collect()] == ["one two three four five six"] and [r["text"] for r in lost.collect()] == ["a b"]


def test_sources_and_stream(spark, tmp_path, sf_dir):
    doc = '<gexf><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="freq" type="long"/></attributes><attributes class="edge"><attribute id="1" title="why" type="string"/><attribute id="2" title="w" type="double"/></attributes><nodes><node id="a" label="A"><attvalues><attvalue for="0" value="3"/></attvalues></node><node id="b" label="B"/></nodes><edges><edge id="0" source="a" target="b" weight="2"><attvalues><attvalue for="1" value="x"/><attvalue for="2" value="1.5"/><attvalue for="9" value="y"/></attvalues></edge></edges></graph></gexf>'
    (tmp_path / "g.gexf").write_text(doc)
    nodes, links = graph_xml.read_graph_xml(spark, str(tmp_path / "g.gexf"))
    shown = F.transform_values("attributes", lambda _, v: F.to_json(v)).alias("a")
    assert {r["id"]: r["a"] for r in nodes.select("id", shown).collect()} == {"a": {"freq": "3"}, "b": {}}
    assert [tuple(r) for r in links.select("source", "target", "weight", "directed", shown).collect()] == [("a", "b", 2.0, True, {"why": '"x"', "w": "1.5", "9": '"y"'})]
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.gexf").write_text(doc)
    (tmp_path / "two" / "b.gexf").write_text('<gexf><graph><attributes class="node"><attribute id="0" title="lemma" type="string"/><attribute id="1" title="n" type="long"/></attributes><nodes><node id="a"><attvalues><attvalue for="0" value="3"/><attvalue for="0" value="4"/><attvalue for="1" value="x"/></attvalues></node></nodes><edges><edge id="0" source="a" target="a"/><edge id="1" source="a" target="b" type="directed"/></edges></graph></gexf>')
    (tmp_path / "two" / "c.gexf").write_text("<gexf><graph/></gexf>")
    both, ties = graph_xml.read_graph_xml(spark, str(tmp_path / "two"))
    name = F.substring_index("file", "/", -1)
    assert {(r["n"], r["id"]): r["a"] for r in both.select(name.alias("n"), "id", shown).collect()} == {("a.gexf", "a"): {"freq": "3"}, ("a.gexf", "b"): {}, ("b.gexf", "a"): {"lemma": '"3"', "n": '"x"'}}
    assert sorted(tuple(r) for r in ties.select(name, "id", "directed").collect()) == [("a.gexf", "0", True), ("b.gexf", "0", False), ("b.gexf", "1", True)]
    documents.write_kg({"nodes": nodes.select("id", "label")}, str(tmp_path / "kg"))
    assert documents.read_kg(spark, str(tmp_path / "kg"), ["nodes"])["nodes"].count() == 2
    with pytest.raises(Exception, match="exists"):
        documents.write_kg({"nodes": nodes.select("id", "label")}, str(tmp_path / "kg"))
    docs = documents.load_documents(spark, sf_dir)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    q = stream_sentences(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("sents").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sents").count() == sentences.split_sentences(docs).count()


def test_tables_appear_together(spark, tmp_path):
    """Partitioned tables behind a manifest: a write that fails leaves the old ones, an overwrite replaces all, a condition prunes."""
    import os

    at = str(tmp_path / "kg")
    first = {"nodes": spark.range(10).selectExpr("id", "id % 3 as part"), "edges": spark.range(4).selectExpr("id as source")}
    documents.write_kg(first, at, partition_by="part")
    broken = {"nodes": spark.range(3).selectExpr("id"), "edges": spark.range(4).selectExpr("raise_error('lost') as source")}
    with pytest.raises(Exception, match="lost"):
        documents.write_kg(broken, at, mode="overwrite")
    kept = documents.read_kg(spark, at)
    assert set(kept) == {"nodes", "edges"} and kept["nodes"].count() == 10 and kept["edges"].count() == 4
    one = kept["nodes"].where("part = 1")
    assert one.count() == 3 and "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()
    documents.write_kg({"nodes": spark.range(2).selectExpr("id")}, at, mode="ignore")
    assert documents.read_kg(spark, at, ["nodes"])["nodes"].count() == 10
    documents.write_kg({"nodes": spark.range(2).selectExpr("id")}, at, mode="overwrite")
    assert {k: df.count() for k, df in documents.read_kg(spark, at).items()} == {"nodes": 2}
    assert len([x for x in os.listdir(at) if x.startswith("tables-")]) == 2  # the one in use and what the broken write left
    with pytest.raises(FileNotFoundError):
        documents.read_kg(spark, str(tmp_path / "none"))


def test_streamed_contexts_equal_the_batch(spark, tmp_path):
    """Micro-batches of a document's sentences give what the whole table gives."""
    import time

    from weft.streaming.context import stream_context_asof, stream_paired_ends

    rnd = random.Random(8)
    rows = [(d, pos, rnd.choice([None, None, "a", "a.b", "c"]), rnd.choice(["x", "y", "z", None])) for d in (1, 2, 3) for pos in range(30) for _ in range(rnd.randint(1, 3))]
    texts = [(d, pos, rnd.choice(["one end of the pipe", "and The other end", "One end of the Rod or the other end", "none", None])) for d in (1, 2) for pos in range(30)]
    contexts, pairs = "doc_id bigint, pos bigint, path string, value string", "doc_id bigint, pos bigint, text string"
    for k in range(6):
        for name, all_rows, schema in (("c", rows, contexts), ("p", texts, pairs)):
            spark.createDataFrame([r for r in all_rows if r[1] // 5 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(1.1)  # files are taken by age
    got = {}
    for name, schema, step in (("c", contexts, stream_context_asof), ("p", pairs, stream_paired_ends)):
        stream = step(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
        q = stream.writeStream.format("memory").queryName(f"streamed_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got[name] = sorted(map(str, spark.table(f"streamed_{name}").collect()))
    df = spark.createDataFrame(rows, contexts)
    asked = df.where("path is null").select("doc_id", "pos")
    want = references.context_asof(df.where("path is not null"), asked)
    assert got["c"] == sorted(map(str, want.collect())) and len(got["c"]) > 100
    assert got["p"] == sorted(map(str, references.resolve_paired_ends(spark.createDataFrame(texts, pairs)).collect()))


def test_entry_imports_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_sentence_rows_of_any_shape(spark):
    """Subtrees against a walk up the heads: gaps in the numbers, crossing trees, missing heads, a cycle, a deep chain."""
    rnd = random.Random(3)
    rows = []
    for sent in range(25):
        toks = sorted(rnd.sample(range(40), rnd.randrange(1, 12)))
        rows += [(1, sent, t, rnd.choice([*toks, 99]), f"w{t}", f"l{t}", rnd.choice(["VERB", "NOUN"]), "x") for t in toks]
    rows += [(2, 0, t, max(0, t - 1), f"w{t}", f"l{t}", "NOUN", "x") for t in range(300)]
    head = {(d, s, t): h for d, s, t, h, *_ in rows}
    below = {}
    for d, s, t in head:
        up, seen = t, set()
        while (d, s, up) in head and up not in seen:
            seen.add(up)
            below.setdefault((d, s, up), []).append(t)
            up = head[d, s, up]
    verb = {(d, s, t): pos for d, s, t, _, _, _, pos, _ in rows}
    toks = spark.createDataFrame(rows, "doc_id bigint, sent int, tok int, head int, text string, lemma string, pos_tag string, dep string").repartition(5)
    words = lambda x: F.transform(tokens.subtree(F.col("t"), x), lambda k: k["tok"])
    got = tokens.parse(toks).select("doc_id", "sent", F.explode(F.transform("t", lambda x: F.struct(x.alias("x"), words(x).alias("members"), tokens.subtree_text(F.col("t"), x).alias("sub")))).alias("y")).select("doc_id", "sent", "y.*", "y.x.*").collect()
    assert {(r["doc_id"], r["sent"], r["tok"]): (r["members"], r["left"], r["right"], r["sub"], r["verb"]) for r in got} == {
        (d, s, t): (sorted(m), min(m), max(m), " ".join(f"w{x}" for x in sorted(m)), next((f"l{x}" for x in sorted(m) if verb[d, s, x] == "VERB"), None)) for (d, s, t), m in below.items()
    }
    spans = {tuple(r)[:3]: (r["left"], r["right"], r["text"]) for r in tokens.subtree_spans(tokens.parse(toks)).collect()}
    assert spans == {(r["doc_id"], r["sent"], r["tok"]): (r["left"], r["right"], r["sub"]) for r in got}
    assert tokens.parse(toks.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 0, 0, None, "a", None, None, None), (None, 0, 1, 0, "b", "b", "VERB", "x"), (None, 0, 1, 0, "b", "b", "VERB", "x"), (1, None, -3, -3, "c", "c", "NOUN", "x"), (1, None, None, -3, "d", "d", "VERB", "x")], toks.schema)
    assert {(r["doc_id"], r["tok"], r["size"]) for r in tokens.subtree_extents(tokens.parse(odd)).collect()} == {(None, 0, 3), (None, 1, 1), (1, -3, 2), (1, None, 1)}


def test_deep_and_wide_trees(spark):
    """A chain of 20,000 tokens in one sentence, and 20,000 children of one head, in memory that goes with the tokens; relations read them too."""
    deep = spark.range(20_000).selectExpr("1L as doc_id", "0 as sent", "cast(id as int) as tok", "cast(greatest(id - 1, 0) as int) as head", "concat('w', id) as text", "'l' as lemma", "if(id = 0, 'VERB', 'NOUN') as pos_tag", "if(id = 1, 'nsubj', 'x') as dep")
    wide = deep.selectExpr("2L as doc_id", "sent", "tok", "0 as head", "text", "lemma", "pos_tag", "dep")
    parsed = tokens.parse(deep.union(wide))
    for r in tokens.subtree_extents(parsed).collect():
        last = 19_999 if r["doc_id"] == 1 or r["tok"] == 0 else r["tok"]
        assert (r["left"], r["right"], r["size"]) == (r["tok"], last, last - r["tok"] + 1)
    found = {r["doc_id"]: r["subject"] for r in relations.svo_triples(parsed).collect()}
    assert found[2] == "w1" and found[1].startswith("w1 w2 ") and found[1].endswith(" w19999")


def brute_best_parents(edges):
    """The heaviest edge into each node; the lightest edge of each cycle gives way to its node's next one."""
    left = {}
    for s, t, rel, w in sorted({e for e in edges if e[0] != e[1]}, key=lambda e: (-e[3], e[0], e[2])):
        left.setdefault(t, []).append((w, s, t, rel))
    while True:
        up = {t: es[0][1] for t, es in left.items() if es}
        cycles = set()
        for x in up:
            seen = []
            while x in up and x not in seen:
                seen.append(x)
                x = up[x]
            if x in seen:
                cycles.add(frozenset(seen[seen.index(x) :]))
        if not cycles:
            return {(s, t, rel, w) for es in left.values() for w, s, t, rel in es[:1]}
        for c in cycles:
            left[min((left[t][0] for t in c), key=lambda e: e[:3])[2]].pop(0)


def shared_folders(spark):
    import os

    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))


def test_best_parents_with_cycles(spark):
    rnd = random.Random(2)
    rows = [(f"n{rnd.randrange(60):02}", f"n{rnd.randrange(60):02}", rnd.choice("ab"), float(rnd.randrange(5))) for _ in range(170)] + [(None, "n01", "a", 9.0), ("n01", None, "a", 9.0)]
    rings = [(f"r{c}_{i}", f"r{c}_{(i + 1) % 3}", "a", float(i)) for c in range(1000) for i in range(3)]
    df = spark.createDataFrame(rows + rings + rows[:5], "src string, dst string, rel string, weight double")
    before = shared_folders(spark)
    got = graph.best_parent_tree(df)
    assert {tuple(r) for r in got.collect()} == brute_best_parents([r for r in rows if None not in r] + rings)
    assert len(shared_folders(spark) - before) == 1  # the result's
    assert graph.best_parent_tree(df.limit(0)).count() == 0


def test_long_paths(spark):
    """A path of 2,000 nodes takes rounds by the logarithm of its length; two ways in, cycles without a way in, and null ends."""
    path = spark.range(2000).selectExpr("concat('p', id) as src", "concat('p', id + 1) as dst")
    more = spark.createDataFrame([("p5", "q"), ("z", "q"), ("q", "q2"), ("c1", "c2"), ("c2", "c1"), ("p7", "p6"), (None, "x"), ("p9", None)], "src string, dst string")
    before = shared_folders(spark)
    got = graph.reachable(path.union(more), spark.createDataFrame([("p3",), ("lone",), (None,), ("p3",)], "id string"))
    assert sorted(r[0] for r in got.collect()) == sorted([*(f"p{k}" for k in range(3, 2001)), "q", "q2", "lone"])
    assert len(shared_folders(spark) - before) == 1
    assert graph.reachable(more.limit(0), got.limit(0)).count() == 0


def test_graphs_of_null_documents(spark):
    df = spark.createDataFrame([(None, "a", "b", 0), (None, "c", "d", 1), (1, "a", None, 2), (1, None, "d", 3), (1, "d", "e", 4)], "doc_id bigint, src string, dst string, pos int").selectExpr("*", "'part-of' as rel", "1.0D as weight")
    plain = graph.named(df, "src", "dst")
    got = graph.unnamed(graph.connected_components(plain), "id", "component")
    assert {tuple(r) for r in got.select("doc_id", "id", "component").collect()} == {(None, "a", "a"), (None, "b", "a"), (None, "c", "c"), (None, "d", "c"), (1, "d", "d"), (1, "e", "d")}
    assert {tuple(r) for r in graph.simple_digraph(df).collect()} == {(None, "a", "b", "part-of"), (None, "c", "d", "part-of"), (1, "d", "e", "part-of")}
    assert {tuple(r) for r in graph.unnamed(graph.maximum_spanning_forest(plain), "u", "v").select("doc_id", "u", "v").collect()} == {(None, "a", "b"), (None, "c", "d"), (1, "d", "e")}
    assert graph.degrees(df.select("doc_id", F.col("src").alias("id")).where("id is not null"), df).where("degree > 0").count() == 3


def test_concept_trees_of_null_documents(toks):
    none = toks.withColumn("doc_id", F.lit(None).cast("bigint"))
    own, both = pipelines.concept_tree(toks), pipelines.concept_tree(toks.union(none))
    rows = {tuple(r)[1:] for r in own.collect()}
    got = both.collect()
    assert {tuple(r)[1:] for r in got if r[0] is None} == rows and {tuple(r)[1:] for r in got if r[0] == 1} == rows


def test_graphs_by_brute_force(spark):
    """Components, reachability and the spanning forest of random graphs with cycles and equal weights; two documents at once."""
    rnd = random.Random(9)
    rows = [(d, f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}", rnd.choice(["part-of", "spatial"]), float(rnd.randrange(4)), i) for d in (1, 2) for i in range(26)]
    df = spark.createDataFrame(rows, "doc_id bigint, src string, dst string, rel string, weight double, pos int")
    plain = graph.named(df, "src", "dst")
    comp = {(d, x): x for d, s, t, *_ in rows for x in (s, t)}
    for _ in range(60):
        for d, s, t, *_ in rows:
            comp[d, s] = comp[d, t] = min(comp[d, s], comp[d, t])
    parts = graph.unnamed(graph.connected_components(plain), "id", "component")
    assert {(r["doc_id"], r["id"]): r["component"] for r in parts.collect()} == comp
    sizes = {d: max((sum(1 for k, v in comp.items() if k[0] == d and v == c), c) for c in {v for k, v in comp.items() if k[0] == d}) for d in (1, 2)}
    top = {d: min(c for c in {v for k, v in comp.items() if k[0] == d} if sum(1 for k, v in comp.items() if k[0] == d and v == c) == sizes[d][0]) for d in (1, 2)}
    assert {(r["doc_id"], r["id"]) for r in graph.largest_component(parts).collect()} == {k for k, c in comp.items() if c == top[k[0]]}
    seen = {(d, "n3") for d in (1, 2)}
    for _ in range(60):
        seen |= {(d, t) for d, s, t, *_ in rows if (d, s) in seen}
    start = graph.named(spark.createDataFrame([(1, "n3"), (2, "n3")], "doc_id bigint, id string"), "id")
    assert {(r["doc_id"], r["id"]) for r in graph.unnamed(graph.reachable(plain, start), "id").collect()} == seen
    best = {}
    for d, s, t, _, w, _ in rows:
        if s != t:
            best[d, min(s, t), max(s, t)] = max(w, best.get((d, min(s, t), max(s, t)), 0.0))
    root, forest = {k: k for k in comp}, set()
    find = lambda k: k if root[k] == k else find(root[k])
    for (d, u, v), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if find((d, u)) != find((d, v)):
            root[find((d, u))] = find((d, v))
            forest.add((d, u, v, w))
    got = graph.unnamed(graph.maximum_spanning_forest(plain), "u", "v")
    assert {(r["doc_id"], r["u"], r["v"], r["weight"]) for r in got.collect()} == forest
    tree = graph.unnamed(graph.best_parent_tree(graph.strongest_edges(plain)), "src", "dst").collect()
    assert len({(r["doc_id"], r["dst"]) for r in tree}) == len(tree)  # one parent, and no way leads back
    up = {(r["doc_id"], r["dst"]): (r["doc_id"], r["src"]) for r in tree}
    for k in up:
        steps, at = 0, k
        while at in up:
            at, steps = up[at], steps + 1
            assert steps <= len(up)


def test_clashing_names_and_nulls(spark):
    df = spark.createDataFrame([(1, 0, "A b; c", 7, "x", "y", "z"), (1, 1, "a B; c", 8, "x", "y", "z"), (1, 2, None, 9, "x", "y", "z"), (1, 3, "", 1, "x", "y", "z")], "doc_id int, pos int, text string, n int, part string, clause string, end_of string")
    assert [(r["pos"], r["n"]) for r in sentences.dedupe_ci(df.where("text <> ''")).collect()] == [(0, 7)]
    cut = sentences.split_clauses(df)
    assert cut.columns.count("part") == cut.columns.count("clause") == 1 and [r["clause"] for r in cut.where("pos = 0").orderBy("part").collect()] == ["A b", "c"]
    assert sentences.isolate_enumerations(df).where("pos > 1").count() == 0
    ends = references.resolve_paired_ends(df)
    assert ends.columns == df.columns and {r["end_of"] for r in ends.collect()} == {"z"} and ends.count() == 4
    short = sentences.finalize_short_docs(cut.withColumn("short", F.lit(5)))
    assert {r["short"] for r in short.collect()} == {5}
    updates = spark.createDataFrame([(1, 0, "p", "a"), (1, 0, "p", "b"), (1, 2, "p", None), (None, 0, "p", "x")], "doc_id int, pos int, path string, value string")
    asof = references.context_asof(updates, spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (1, 3), (None, 5)], "doc_id int, pos int"))
    assert sorted((r["pos"], r["value"]) for r in asof.where("value is not null").collect()) == [(1, "b"), (2, "b")] and asof.where("value is null and pos = 3").count() == 2
