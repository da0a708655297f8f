"""The pipeline's stages against brute force, and what each does with repeated ids, nulls and other columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import op3_quality, op5_simhash, op7_substring
from weft.llm.common import read_table

from . import cases


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows, tenths=8):
    """Indexes of rows, grouped by links of the similarity or more."""
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y and (x or (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()) or x and 10 * len(x & y) >= tenths * len(x | y):
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def brute_cut(rows, width=50):
    """Rows of (id, text) without the words of windows that stand in a row of a smaller id; rows without a cut stay as they are."""
    first = {}
    for d, text in rows:
        words = (text or "").split()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, text in rows:
        words = (text or "").split()
        gone = {i + j for i in range(len(words) - width + 1) if first[tuple(words[i : i + width])] < d for j in range(width)}
        if gone:
            text = " ".join(w for i, w in enumerate(words) if i not in gone)
        if not gone or text:
            out.append((d, text))
    return out


@pytest.mark.parametrize("which", ["cases", "sf"])
def test_near_copies_against_all_pairs(spark, sf_dir, which):
    df = cases.docs(spark) if which == "cases" else read_table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]
    got = {(r["doc_id"], r["text"]) for r in op5_simhash.keep_one_of_each(df.where("doc_id is not null")).select("doc_id", "text").collect()}
    classes = brute_classes(rows)
    first = {min((rows[i] for i in c), key=lambda x: x[0]) for c in classes}
    extra = got - first
    assert first <= got and len(extra) <= 0.05 * (len(rows) - len(first))  # what the fingerprints miss stays; nothing else goes


def test_near_copies_with_a_few_other_words(spark):
    words = cases.prose(50, 200).split()
    other = [[*words[:k], f"changed{k}", *words[k + 1 :]] for k in (20, 90, 160)]
    cut = [*words[:60], *(f"new{i}" for i in range(60)), *words[120:]]
    df = cases.docs(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate([words, *other, cut])])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 4]
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_no_stage_mixes_up_rows_of_one_id(spark):
    a, b, c, passage = cases.prose(1, 80), cases.prose(2, 80), cases.prose(3, 80), cases.prose(4, 60)
    rows = [(1, passage + " " + a), (5, passage + " " + b), (5, c), (5, c), (None, a + " x"), (None, a + " x"), (6, passage + " " + b), (7, None), (8, None)]
    df = cases.docs(spark, [(i, t, "en", "s") for i, t in rows])
    one = op5_simhash.keep_one_of_each(df)
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == sorted([(1, passage + " " + a), (5, passage + " " + b), (5, c), (None, a + " x"), (7, None)], key=str)
    cut = op7_substring.remove_repeated_passages(df)
    want = [(1, passage + " " + a), (5, b), (5, c), (5, c), (None, a + " x"), (None, a + " x"), (7, None), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted(want, key=str)
    assert one.columns == cut.columns == df.columns
    assert {r["n_chars"] for r in cut.where("doc_id = 5").collect()} == {len(b), len(c)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    item = cases.prose(900, 40)
    extra = [(500 + i, cases.prose(600 + i, 90) + ". " + (item if i % 5 == 0 else cases.prose(700 + i, 40)), "en", f"s{i % 3}") for i in range(20)]
    cases.docs(spark, [*cases.texts(), *extra]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(500 + i, 1, 0) for i in range(20)] + [(13, 0, 0), (15, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_the_whole_run(spark, folder):
    docs, seen = read_table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = stage(spark, docs, folder)
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen[name] = before, docs.collect()
        if name != "mixing":
            assert docs.schema.fieldNames() == read_table(spark, folder, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    model = op3_quality.train(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    given, kept = seen["quality_classifier"]
    p = op3_quality.probabilities(model, [(r["text"] or "").encode() for r in given])
    assert sorted(map(str, kept)) == sorted(str(r) for r, x in zip(given, p) if x >= op3_quality.THRESHOLD)
    given, kept = seen["simhash_near_dedup"]
    assert {(r["doc_id"], r["text"]) for r in kept} <= {(r["doc_id"], r["text"]) for r in given} and len(kept) >= len(brute_classes([(r["doc_id"], r["text"]) for r in given]))
    given, kept = seen["substring_dedup"]
    want, whole = brute_cut([(r["doc_id"], r["text"]) for r in given]), {(r["doc_id"], r["text"]) for r in given}
    words = lambda rows: sorted((x if x in whole else (x[0], (x[1] or "").split()) for x in rows), key=str)  # noqa: E731  what is left of a cut text keeps its white space
    assert words((r["doc_id"], r["text"]) for r in kept) == words(want) and not {x for x in want} <= whole
    given, kept = seen["benchmark_decontamination"]
    item = cases.prose(900, 40)
    assert {r["doc_id"] for r in given} - {r["doc_id"] for r in kept} == {r["doc_id"] for r in given if item in (r["text"] or "")} != set()
    given, kept = seen["mixing"]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(r["doc_id"]), str(r["text"])) for r in given)
    sources = {r["source"] for r in kept}
    for s in sources:
        own = [r for r in kept if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    for r in kept:
        words = (r["text"] or "").split()
        assert r["size"] == len(words) and r["taken"] == r["copies"] * r["size"] + r["part"] and (r["part_text"] or "").split() == words[: r["part"]]
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == docs.columns and whole.count() == len(kept)


def test_the_run_on_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        read_table(spark, folder, name).where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
