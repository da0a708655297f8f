"""Periodic runs, ranked search and token files against brute force."""

import hashlib
import math
import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weft.llm import op11_runs as runs
from weft.llm import op12_search as search
from weft.llm import op13_tokens as tokens
from weft.llm.common import read_table

from . import cases

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)  # lags ascend: the smallest period stands
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_against_brute_force(letters):
    rnd = random.Random(letters)
    for trial in range(120):
        words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 120))]
        for _ in range(trial % 4):  # nested and neighbouring repetitions
            p = rnd.randint(1, 30)
            at = rnd.randint(0, len(words))
            words[at:at] = ([rnd.randrange(letters) for _ in range(p)] * 9)[: rnd.randint(p, 9 * p)]
        assert [tuple(r) for r in runs.find_runs(np.array(words, np.int64)).tolist()] == brute_runs(words)


def test_long_runs_take_linear_work():
    assert runs.find_runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    fibonacci = [0], [1]
    while len(fibonacci[1]) < 30_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert len(runs.find_runs(np.array(fibonacci[1]))) > 5_000
    assert [tuple(r) for r in runs.find_runs(np.array(fibonacci[1][:400])).tolist()] == brute_runs(fibonacci[1][:400])


def planted(doc_id, words):
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_query(doc_id, text):
    words = planted(doc_id, WORD.findall((text or "").encode()))
    found = brute_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def folder(spark, sf_dir):
    """The edge cases and the shorter documents of the test tables, as a folder of tables."""
    at = tempfile.mkdtemp(prefix="spark-")
    docs = cases.docs(spark).where("length(text) < 5000 or text is null")
    more = read_table(spark, sf_dir, "documents").where("length(text) < 3000").select("doc_id", "text", "lang", "source")
    docs.unionByName(more.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True).write.parquet(f"{at}/documents.parquet")
    items = read_table(spark, sf_dir, "benchmark").union(spark.createDataFrame([(3, None), (None, "word word 123"), (5, ""), (5, "in the of"), (5, "in the of")], "item_id bigint, text string"))
    items.write.parquet(f"{at}/benchmark.parquet")
    return at


def by_row(rows):
    return sorted(map(tuple, rows), key=str)


def test_runs_query(spark, folder):
    rows = read_table(spark, folder, "documents").select("doc_id", "text").collect()
    assert by_row(runs.query(spark, folder).collect()) == by_row(brute_query(*r) for r in rows)
    assert sum(zlib.crc32(b"%d" % r[0]) % 10 == 0 for r in rows if r[0] is not None) > 5
    empty = runs.periodic_runs(cases.docs(spark, []))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k=20):
    held = [(d, t) for d, t in ((d, terms_of(x)) for d, x in docs) if t]
    n, total = len(held), sum(len(t) for _, t in held)
    counts, df = [], {}
    for _, t in held:
        own = {}
        for w in t:
            own[w] = own.get(w, 0) + 1
        counts.append(own)
        for w in own:
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (d, t), own in zip(held, counts, strict=True):
            m = 75 + (25 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * own[w]) // (1000 * own[w] + 12 * m)) for w in terms_of(text) if w in own)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, folder, monkeypatch, small):
    docs, items = (read_table(spark, folder, x) for x in ("documents", "benchmark"))
    want = brute_search(docs.select("doc_id", "text").collect(), items.collect())
    if small:  # small blocks of documents and of items
        docs = docs.coalesce(2)
        monkeypatch.setattr(search, "BLOCK_DOCUMENTS", 40)
    got = search.search(docs, items, query_bytes=500 if small else search.QUERY_BYTES)
    assert by_row(got.collect()) == by_row(want) and len(want) > 500
    if not small:
        assert by_row(search.query(spark, folder).collect()) == by_row(want)
        assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [1, 128])
def test_search_passes_over_most_documents(monkeypatch, at_once):
    """The bounds let a search of a large block end after a small part of its documents."""
    monkeypatch.setattr(search, "SPLIT_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    n_docs, n_terms = 20_000, 12
    tf = rng.geometric(0.7, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < 0.2)
    doc, term = np.nonzero(tf)
    lists = search.Postings(rng.integers(50, 800, n_docs), doc, term, tf[doc, term], n_terms, n_docs, 400 * n_docs)
    seen = []
    largest = lists.largest
    lists.largest = lambda a, b: seen.append(len(a)) or largest(a, b)
    weights = rng.integers(100, 9000, n_terms)
    docs, scores = lists.best(np.arange(n_terms), weights, 20, 0)
    every = np.zeros(n_docs, np.int64)
    np.add.at(every, lists.doc, np.repeat(weights, np.diff(lists.start)) * lists.impact)
    order = np.lexsort((np.arange(n_docs), -every))[:20]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert sum(seen) < n_docs


STRANGE = ["", " ", "A’s it'S don't WE'LL 's", "ÀÉ é ΑΣ Σ ς ΟΔΟΣ İi ß ǅ", "x\u0085y z 　 a\x1cb\x00c\x01 \x7f", "12½ ²³ 1,234.5 a1b2 _-_ ''s", "<|endoftext|> a<|startoftext|>b <|x|>", "文字 日本語テキスト 🙂👍🏽 ا ب", "́x ́ ạ̀", "a" * 3000 + " " * 5000 + "B" * 99 + "." * 200]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_word_ids_are_those_of_the_whole_text(spark, sf_dir, monkeypatch, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CHUNK", chunk)
    own, whole = tokens.Words(open(VOCABULARY, encoding="utf-8").read()), Tokenizer.from_file(VOCABULARY)
    rnd, latin = random.Random(5), "".join(map(chr, range(0x20, 0x250)))
    alphabet = "ab'sS téñÑ İΣσ1½,.\n\t\x85<|>_" + "é"
    texts = STRANGE + ["".join(rnd.choice(alphabet) for _ in range(60)) for _ in range(2000)] + ["".join(rnd.choice(latin) for _ in range(60)) for _ in range(500)] + [r[0] or "" for r in read_table(spark, sf_dir, "documents").select("text").collect()]
    for text in texts:
        assert np.frombuffer(own.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_token_files(spark, folder):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()]
    whole = Tokenizer.from_file(VOCABULARY)
    got = tokens.query(spark, folder).orderBy("start").collect()
    ids = {}
    for d, text in rows:
        found = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        ids.setdefault(d, []).append((len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        ids[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(ids.values())


def test_token_files_of_many_stripes(spark):
    """Least and greatest ids, Bloom filters and several stripes are in the files; a read by id is pushed down; a hot id is dealt over files."""
    from pyarrow import orc

    at = tempfile.mkdtemp(prefix="spark-") + "/tokens"
    rows = [(i if i % 3 else 7, cases.prose(i, 40), "en", "a") for i in range(9000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_token_files(cases.docs(spark, rows).repartition(4), at, VOCABULARY, **{"orc.stripe.size": "65536", "orc.row.index.stride": "1000"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [r[0].removeprefix("file://") for r in spark.read.orc(at).select(F.input_file_name()).distinct().collect()]
    assert len(files) >= 2 and all(orc.ORCFile(f).nstripes > 1 for f in files)
    assert spark.read.orc(at).where("doc_id = 7").select("file").distinct().count() >= 2
    plan = spark._jvm.org.apache.orc.OrcFile
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = plan.createReader(spark._jvm.org.apache.hadoop.fs.Path(files[0]), plan.readerOptions(conf))
    stripe = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {str(stripe.getStreams(i).getKind()) for i in range(stripe.getStreamsCount())}
    assert "ROW_INDEX" in kinds and any("BLOOM_FILTER" in k for k in kinds)
    encodings = {str(stripe.getColumns(i).getKind()) for i in range(stripe.getColumnsCount())}
    assert "DIRECT_V2" in encodings
    one = tokens.read_token_files(spark, at).where("doc_id = 4001")
    assert "EqualTo(doc_id,4001)" in one._jdf.queryExecution().toString() and one.count() == 1
    every = tokens.read_token_files(spark, at).select("start", "n_tokens").orderBy("start").collect()
    assert len(every) == 9000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(every, every[1:], strict=False))
    empty = tempfile.mkdtemp(prefix="spark-") + "/tokens"
    tokens.write_token_files(cases.docs(spark, []), empty, VOCABULARY)
    assert tokens.read_token_files(spark, empty).count() == 0
