"""Near duplicates and substring removal against brute force."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import op5_simhash as simhash
from weft.llm import op7_substring as substring
from weft.llm import op10_suffix as suffix
from weft.llm.common import components, read_table
from weft.llm.repeats import PIECE, row_id

from . import cases


def table(spark, sf_dir, which):
    return cases.docs(spark) if which == "cases" else read_table(spark, sf_dir, "documents")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("which", ["cases", "sf"])
def test_simhash(spark, sf_dir, which):
    df = table(spark, sf_dir, which)
    rows = rows_of(df)
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == want


def test_simhash_of_a_very_long_text():
    text = cases.prose(9, 70_000)
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == brute_fingerprint(text)


def test_anchors_lose_no_link():
    import random

    import numpy as np

    rnd = random.Random(1)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(0, 2)):
            y ^= 1 << b
        home = simhash.anchors_of(np.array([x], np.uint64).view(np.int64), 2, True)[1]
        every = simhash.anchors_of(np.array([y], np.uint64).view(np.int64), 2, False)[1]
        assert home[0] in every


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


BOUNDS = [{}, {"common": 5, "very_common": 1000}, {"common": 2, "very_common": 4}]
TABLES = [(w, b) for w in ("cases", "sf") for b in BOUNDS] + [("long", {})]


def long_rows():
    """Texts beyond a piece of the search, with repeats across its border, long runs, and rows of one id with different texts."""
    passage, filler = cases.prose(70, 120), cases.prose(71, 195_000)
    head = filler[: PIECE - 300]
    return [
        (1, head + " " + passage + " " + filler[-2000:], "en", "a"), (2, "x " + passage, "en", "a"), (3, "a" * (PIECE + 500), "en", "a"), (8, "b" * 5000 + "a" * 70_000, "en", "a"), (4, "ab" * 3000 + passage, "en", "a"),
        (5, passage + " one", "en", "a"), (5, "two " + passage, "en", "a"), (5, cases.prose(72, 80), "en", "a"), (6, cases.prose(72, 80) + " end", "en", "a"), (7, "na " * 40_000, "en", "a"), (7, "na " * 300, "en", "a"),
    ]


def some_table(spark, sf_dir, which):
    return cases.docs(spark, long_rows()) if which == "long" else table(spark, sf_dir, which)


@pytest.mark.parametrize(("which", "bounds"), TABLES)
def test_substring(spark, sf_dir, which, bounds):
    df = some_table(spark, sf_dir, which)
    rows = [(d, t, (t or "").encode().split()) for d, t in rows_of(df)]
    first = {}
    for d, _, w in rows:
        if d is not None:
            for i in range(len(w) - 49):
                k = hash(tuple(w[i : i + 50]))
                first[k] = min(first.get(k, d), d)
    want = set()
    for d, _, w in rows:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[hash(tuple(w[i : i + 50]))] < d:
                gone.update(range(i, i + 50))
        want.add((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    base, removed = substring.removals(df, **bounds)
    lost = {(r["doc_id"], r["rid"]): r for r in removed.collect()}
    got = set()
    for r in base.collect():
        x = lost.get((r["doc_id"], r["rid"]))
        got.add((r["doc_id"], r["n"], x["n_removed"] if x else 0, x["kept_sha256"] if x else r["sha"]))
        if x:
            assert hashlib.sha256(b" ".join(bytes(x["kept_text"]).split())).hexdigest() == x["kept_sha256"]
    assert got == want


@pytest.mark.parametrize(("which", "bounds"), TABLES)
def test_suffix(spark, sf_dir, which, bounds):
    df = some_table(spark, sf_dir, which)
    df = df.dropDuplicates(["doc_id", "text"])
    rids = {(r["doc_id"], r["text"]): r["rid"] for r in df.select("doc_id", "text", row_id(F.col("text")).alias("rid")).collect()}
    rows = sorted((d, rids[d, t], (t or "").encode()) for d, t in rows_of(df) if d is not None)
    seen, want = set(), {}
    for d, rid, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            k = hash(b[i : i + 100])
            if k in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(k)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d, rid] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    base, removed = suffix.removals(df, **bounds)
    lost = {(r["doc_id"], r["rid"]): r for r in removed.collect()}
    got = {k: (r["n"], *((x["n_removed"], x["n_spans"], x["kept_sha256"]) if (x := lost.get(k)) else (0, 0, r["sha"]))) for r in base.collect() if (k := (r["doc_id"], r["rid"]))[0] is not None}
    assert got == want


def test_difference_cover_sorts_windows():
    import numpy as np

    rnd = np.random.default_rng(1)
    for letters in (1, 2, 4):
        unit = rnd.integers(97, 97 + letters, 13 * 12).astype(np.uint8)
        text = np.concatenate([unit, rnd.integers(97, 99, 13 * 10).astype(np.uint8), unit, unit[::-1], unit[:130]])
        middles = np.tile(np.concatenate([unit[:20], unit[:60], unit[:24]]), 30)
        middles[np.arange(30) * 104 + 50] = np.arange(30)
        text = np.concatenate([text, middles])
        places = np.arange(len(text) - 99)
        order, new = suffix.sorted_windows(text, places)
        key = lambda i: (text[i], i % 13, text[i : i + 100].tobytes())
        keys = [key(i) for i in places[order].tolist()]
        assert keys == sorted(map(key, places.tolist()))
        assert new.tolist() == [True, *(a != b for a, b in zip(keys, keys[1:]))]


def test_empty_tables(spark):
    empty = cases.docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    for module in (substring, suffix):
        base, removed = module.removals(empty)
        assert base.count() == 0 and removed.count() == 0


def test_filters_keep_the_columns(spark):
    df = cases.docs(spark)
    one = simhash.keep_one_of_each(df)
    assert one.columns == df.columns and {r["doc_id"] for r in one.collect()} & {1, 2, 3, None} == {1}
    cut = substring.remove_repeated_passages(df)
    assert cut.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert 2 not in left and left[1] == cases.texts()[0][1] and left[5] is None and left[11] == cases.prose(6, 60)
