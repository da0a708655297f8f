"""What must not grow faster than the input: shuffles of tokens, scans of a whole sentence for each token, rounds over small graphs."""

import random

from pyspark.sql import functions as F

from weft.operators import graph, kg, phrases, references, relations, sentences, tokens
from weft.plans import registry
from weft.plans.views import Views
from weft.session import cut_lineage


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_sentence_rows_from_texts(spark, tmp_path):
    """Sentence rows equal the gathered token table, also where a doc_id is repeated or null, and only the texts are shuffled."""
    rows = [(1, "A b c. D e f g! "), (1, "The x y. Z"), (1, None), (2, ""), (3, None), (None, "One. Two words"), (4, "Mr. A b, c d e f g h i j k l m")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    made, gathered = v.token_rows(), tokens.sentence_rows(v.toks)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, gathered.collect()))
    assert exchanges(tokens.parse(made)) == 1
    assert exchanges(tokens.noun_chunks(made)) == 1
    assert exchanges(tokens.word_edges(made)) == 2
    assert sorted(map(tuple, v.sentence_toks.collect()), key=repr) == sorted(map(tuple, v.toks.collect()), key=repr)


def test_children_and_walk(spark):
    """Children, heads and the walk of each token, with a token number that stands twice, a cycle and heads that are no token."""
    heads = [(0, 0), (1, 0), (2, 1), (2, 0), (3, 9), (4, 5), (5, 4), (6, 2), (7, None)]
    toks = spark.createDataFrame([(1, 0, t, h, f"w{k}", f"w{k}", "NOUN", "d") for k, (t, h) in enumerate(heads)], "doc_id int, sent int, tok int, head int, text string, lemma string, pos_tag string, dep string")
    t = tokens.parse(toks).first()["t"]
    at = [(x["tok"], x["head"]) for x in t]
    for x in t:
        assert list(x["kids"]) == [i for i, (tok, head) in enumerate(at) if head == x["tok"] and tok != x["tok"]]
        assert x["up"] == next((i for i, (tok, _) in enumerate(at) if tok == x["head"]), None)
    assert sorted(x["nth"] for x in t) == list(range(len(t)))
    words = tokens.parse(toks).select(F.transform("t", lambda x: tokens.subtree_text(F.col("t"), x)).alias("w")).first()["w"]
    assert len(words[0].split()) == max(x["size"] for x in t)


def test_components_of_documents(spark, monkeypatch):
    """Documents' components equal those of the rounds, without rounds where documents are small, and where their nodes come in several pieces."""
    rng = random.Random(5)
    rows = [(d, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}é"[: rng.choice((3, 4))]) for d in (None, 1, 2, 3, 7) for _ in range(25)] + [(4, "a", "a"), (5, None, "b"), (6, "b", "c"), (6, "c", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, src string, dst string").repartition(3)
    want = sorted(map(repr, graph.unnamed(graph.connected_components(graph.named(df, "src", "dst")), "id", "component").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (3, 12, 40, 1_000_000):
            assert sorted(map(repr, graph.document_components(df, most).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(graph, "connected_components", None)  # no rounds
    assert sorted(map(repr, graph.document_components(df).collect())) == want
    assert graph.document_components(df.limit(0)).count() == 0


def test_one_scan_and_one_shuffle(spark, tmp_path):
    """Refinement reads its rows once however many rounds there are; votes of documents are gathered where their texts were."""
    spark.createDataFrame([(1, "A b c. D e f g! "), (2, "One two three")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    accepted, dropped = sentences.refine_splits(v.claims, max_len=80)
    for df in (accepted, dropped):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert exchanges(kg.tally_votes(v.votes)) == 1
    assert exchanges(sentences.top_level_spans(v.spans_of_clauses)) == 1


def test_phrases_by_shards(spark):
    """Phrases too many to go along with each task come to the texts' shards by their first pieces: the same results, and no piece of a text is shuffled by itself."""
    rng = random.Random(3)
    words = ["A", "b", "c-d", "É", "x.y", "_z9", "İ", "ΑΣ", "  ", "\u00a0", "\t\n", "\x1c", "(", "1"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = spark.createDataFrame([(some(rng.randrange(15)), k) for k in range(300)] + [(None, 1), ("", 2)] * 2, "text string, other int").repartition(3)
    table = [(some(rng.choice((1, 1, 2, 3, 9))), rng.choice(("<v>", "w", None))) for _ in range(80)] + [("a b c d e f g", "1"), ("a b c d e f h", "2"), (None, "n"), (" ", "n")]
    table = spark.createDataFrame(table, "alias string, entity string")
    a, b = (phrases.rewrite_phrases(texts, table, "alias", "entity", few=few) for few in (0, 1_000_000))
    got, want = (sorted(map(repr, df.collect())) for df in (a, b))
    assert got == want and got != sorted(map(repr, texts.collect()))
    assert exchanges(a) <= 3  # what stands in the texts meets the phrases, which then come to the texts
    assert exchanges(b) == exchanges(references.apply_aliases(texts, {"a b": "<AB>"})) == exchanges(texts)


def test_phrases_of_documents(spark):
    """Texts and their document's phrases meet in one shuffle, and a text of many mentions is cut once, not for each of them."""
    splits = spark.createDataFrame([(1, "s1", "a pump " * 30_000), (2, "s1", "a pump"), (None, "s1", "PUMP")], "doc_id int, sid string, text string")
    entities = spark.createDataFrame([(1, "pump", "E1"), (None, "pump", "E2"), (2, "pum", "E3")], "doc_id int, label string, id string")
    out = kg.annotate_refs(splits, entities)
    assert exchanges(out) == 1
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a pump[Ref:E1] " * 30_000, 2: "a pump", None: "PUMP[Ref:E2]"}


def test_written_steps_leave_no_shuffle_files(spark):
    """A step that is written leaves no shuffle files on the disks, and the setting for it is as it was."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, own = files(), spark.conf.get(key)
    for _ in range(3):
        assert cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert files() <= was + 3 * 2 * 4  # those of the three counts
    assert spark.conf.get(key) == own


def test_forests_of_tasks(spark):
    """Edges that a task's own edges rule out go before anything is written; the forest is that of a greedy choice, nulls first, in tasks of any size."""
    rng = random.Random(8)
    pairs = {tuple(sorted((f"n{a}", f"n{b}"))): rng.choice((None, 1.0, 2.0, 2.5, float("nan"))) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(400)) if a != b}
    top = {f"n{k}": f"n{k}" for k in range(40)}

    def find(x):
        return x if top[x] == x else find(top[x])

    want = []
    for (u, v), w in sorted(pairs.items(), key=lambda e: (e[1] is not None, e[1] != e[1], -(e[1] or 0) if e[1] == e[1] else 0, e[0])):
        if find(u) != find(v):
            top[find(u)] = find(v)
            want.append((u, v, w))
    df = spark.createDataFrame([(u, v, w) for (u, v), w in pairs.items()], "u string, v string, weight double").repartition(2)
    for most in (1, 60, 1_000_000):
        left = graph._forests(df, most)
        assert left.count() < len(pairs) or most == 1
        for single in (True, False):
            got = graph.maximum_spanning_forest(left.selectExpr("v as src", "u as dst", "weight"), single=single)
            assert sorted(map(repr, got.collect())) == sorted(f"Row(u={u!r}, v={v!r}, weight={w!r})" for u, v, w in want)


def test_nodes_are_numbered_once(spark):
    """Edges come together by document once for the nodes, which are written; what reads nodes or edges doesn't number them again."""
    triples = spark.createDataFrame([(1, 0, "s1", "x", "is", "y"), (1, 1, "s2", "y", "is", "z"), (2, 0, "s1", "z", "is", "x")], "doc_id int, pos int, sid string, subject string, surface_pred string, object string")
    votes = triples.where("doc_id = 1").selectExpr("*", "explode(array(0, 1)) as v", "'part_of' as canonical_pred")
    edges = triples.selectExpr("*", "'p' as predicate", "0.5D as confidence")
    assert exchanges(kg.assign_node_ids(edges)) == 1
    nodes, voted = kg.voted_graph(triples, votes, ("part_of",))
    assert exchanges(nodes) == 0
    assert {(r["doc_id"], r["label"], r["id"]) for r in nodes.collect()} == {(1, "x", "N1"), (1, "y", "N2"), (1, "z", "N3"), (2, "z", "N1"), (2, "x", "N2")}
    assert {(r["doc_id"], r["source"], r["target"]) for r in voted.collect()} == {(1, "N1", "N2"), (1, "N2", "N3"), (2, "N1", "N2")}


def test_clauses_with_tokens_of_texts(spark, tmp_path):
    """Clauses with their tokens are made where the texts are: no token is shuffled, also where a doc_id is repeated or null, and the clauses are those of the gathered tokens."""
    words = "a b c d wherein e f; g h i j k: l m thereby n o p q r s t é ü"
    rows = [(1, f"{words}. {words} {words}! A b"), (1, "The x y; z. B c d e f g h"), (1, None), (2, ""), (3, None), (None, f"One. {words}"), (None, "Two words. c d e f"), *((k, f"{words} {k}") for k in range(4, 14))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    made, gathered = sentences.split_clauses(v.claim_rows, tokens="t"), sentences.split_clauses(v.claims, tokens=v.clause_toks)
    assert sorted(map(repr, made.select(*gathered.columns).collect())) == sorted(map(repr, gathered.collect()))
    assert made.count() > sentences.split_clauses(v.claims).count()
    assert exchanges(registry.queries()["c6_split_clauses_conj"](spark, str(tmp_path))) == 1


def test_laid_tokens(spark):
    """Cuts before the conjuncts of a clause's root, against a search of all tokens for each clause: any white space, tokens without a character, numbers and heads that are null."""
    rng = random.Random(6)
    white, rows, want = [" ", " ", "　", "\t\n", "  ", "\x85"], [], []
    solid = lambda x: "".join(c for c in x if not c.isspace())
    for k in range(200):
        toks = [rng.choice(["ab", "é", "漢字", "wherein", "x", "", "​"]) for _ in range(rng.randrange(12))]
        text = "".join(w + (rng.choice(white) if w else "") for w in toks)
        n = [None] * rng.choice((0, 0, 0, 1)) + list(range(3, 15))
        t = [(n[i], rng.choice([None, n[i], *n[:6]]), w, rng.choice(("conj", "conj", "x", None))) for i, w in enumerate(toks)]
        rows.append((k, text, t))
        clauses, at = [[]], 0
        for w in text.split():
            clauses += [[]] if w == "wherein" and clauses != [[]] else []
            clauses[-1].append(w)
        begins = [sum(len(w) for w in toks[:i]) for i in range(len(toks))]
        for c in clauses:
            end = at + len("".join(c))
            own = [(b, *x) for b, x in zip(begins, t) if at <= b < end]
            cuts = []
            if own and own[0][1] is not None:
                lo, hi = own[0][1], own[-1][1]
                root = next((x[1] for x in own if x[2] is not None and (x[2] == x[1] or x[2] < lo or x[2] > hi)), None)
                cuts = [x[0] - at for x in own if root is not None and x[4] == "conj" and x[2] == root and x[1] > lo]
            whole = "".join(c)
            want += [(k, part) for a, b in zip([0, *cuts], [*cuts, len(whole)]) if (part := whole[a:b])]
            at = end
    df = spark.createDataFrame(rows, "doc_id int, text string, t array<struct<tok int, head int, text string, dep string>>").repartition(3)
    got = sentences.split_clauses(df, tokens="t").orderBy("doc_id", "part").collect()
    assert [(r["doc_id"], solid(r["clause"])) for r in got] == want
    assert all(r["clause"] == r["clause"].strip() and ("wherein" in rows[r["doc_id"]][1] or r["clause"] in rows[r["doc_id"]][1]) for r in got)


def test_only_sentences_with_the_words_are_parsed(spark, monkeypatch):
    """Relations of sentence rows parse only the sentences that hold a token which the relation asks for, once each; the finds are those of all sentences."""
    rng, parsed = random.Random(9), []
    words = lambda n: [(k, rng.choice([0, max(k - 1, 0), k // 2, None]), w, w, rng.choice(("VERB", "NOUN", "ADP", "AUX", None)), rng.choice(("cop", "nsubj", "dobj", "prep", "pobj", "amod", "mark", "x", None))) for k, w in enumerate(rng.choice(("to", "in", "when", "the", "has", None)) for _ in range(n))]
    df = spark.createDataFrame([(k % 3 or None, k, words(rng.randrange(12))) for k in range(900)], "doc_id int, sent int, t array<struct<tok int, head int, text string, lemma string, pos_tag string, dep string>>")
    every = tokens.parse(df)
    monkeypatch.setattr(relations, "parse", lambda rows: parsed.append(rows) or tokens.parse(rows))
    for f, some in (
        (relations.copular_triples, "x.dep = 'cop' and x.pos_tag in ('VERB', 'AUX')"),
        (lambda x: relations.rel_part_of(x, ["has"]), "x.pos_tag = 'VERB' and x.lemma = 'has'"),
        (lambda x: relations.rel_function_marker(x, ["to"]), "x.text = 'to' and x.dep = 'amod'"),
        (lambda x: relations.rel_function_verb(x, ["has"]), "x.pos_tag = 'VERB' and x.lemma = 'has'"),
        (lambda x: relations.rel_spatial(x, ["in"]), "x.pos_tag = 'ADP' and x.lemma = 'in'"),
        (lambda x: relations.rel_condition(x, ["when"]), "x.lemma = 'when' and x.dep = 'mark'"),
    ):
        got, want = f(df).collect(), f(every).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and want
        asked = df.where(f"exists(t, x -> {some})")
        assert sorted(r["sent"] for r in parsed.pop().collect()) == sorted(r["sent"] for r in asked.collect())
        assert 0 < asked.count() < 900 and not parsed
