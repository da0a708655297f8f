"""Benchmark decontamination by greedy string tiling.

Documents and test items are joined on shared seeds (five consecutive words). The item words under shared seeds bound what
tiling can cover, so pairs below the threshold leave exactly. For the others the longest match of words that are still
unmarked in both is found by Karp-Rabin hashes (a match of n words implies one of n - 1, so its length is searched by
halving), marked as a tile without overlap, and so on down to five words. A document is contaminated by an item of which
its tiles cover at least `threshold`: the order of the passages doesn't matter.

The items' seeds are broadcast while their bytes allow at most BROADCAST_WORDS words; beyond, documents and items meet by the
items' rarest seeds in a shuffle, to which a document sends only seeds that a filter of the items' seeds lets through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, covered, gram_hashes, read_table, slices, write_shared

SEED_WORDS = 5
THRESHOLD = 0.6
BROADCAST_WORDS = 2_000_000
SALTS = 16
FILTER_BITS = 27
_word = re.compile(r"\w+").findall
_hashes = WordHashes()

PAIR = "doc_id bigint, item_id bigint, n_words bigint, n_covered bigint, n_tiles bigint, coverage double"


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words (letters, digits, underscores) of a text, lower-cased."""
    return _hashes.of(_word((text or "").lower()))


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), longest first; ties in order of the item, then of the document."""
    free = [np.ones(len(item), bool), np.ones(len(doc), bool)]

    def open_grams(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for words, is_free in zip((item, doc), free, strict=True):
            blocked = np.concatenate(([0], np.cumsum(~is_free)))
            starts = np.flatnonzero(blocked[k:] == blocked[:-k]) if len(words) >= k else np.empty(0, np.int64)
            out.append((starts, gram_hashes(words, k)[starts]))
        return out

    def matches(k: int) -> bool:
        (_, a), (_, b) = open_grams(k)
        return bool(np.isin(a, b).any())

    out, high = [], min(len(item), len(doc))
    while high >= least and matches(least):
        low = least
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if matches(middle) else (low, middle - 1)
        (a, ha), (b, hb) = open_grams(low)
        order = np.argsort(hb, kind="stable")
        at = np.searchsorted(hb[order], ha)
        for s, h, i in zip(a.tolist(), ha.tolist(), at.tolist(), strict=True):
            while free[0][s : s + low].all() and i < len(order) and int(hb[order[i]]) == h:
                d = int(b[order[i]])
                i += 1
                if free[1][d : d + low].all() and (item[s : s + low] == doc[d : d + low]).all():
                    free[0][s : s + low] = free[1][d : d + low] = False
                    out.append((s, d, low))
        high = low
    return out


def _compare(doc_id: int, item_id: int, item: np.ndarray, doc: np.ndarray, threshold: float) -> list[tuple]:
    found = tiles(item, doc)
    n = sum(t[2] for t in found)
    return [(doc_id, item_id, len(item), n, len(found), n / len(item))] if n >= threshold * len(item) else []


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (*[pa.int64()] * 5, pa.float64())
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage): the pairs with coverage of `threshold` or more; n_words are the item's.

    Items under five words are never found; null and empty texts match nothing; rows with a null id are left out. Repeated
    documents are each reported; of items repeated under one id, each is compared. Other columns are not looked at. Words
    are runs of letters, digits and underscores; in scripts without spaces such a run is one word, whole. Without documents
    or items there are no pairs.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    tests = _tests(items)
    return (_by_broadcast if _most_words(tests) <= broadcast_words else _by_shuffle)(texts, tests, threshold)


def _tests(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null").select(F.col("item_id").cast("bigint"), F.col("text"))


def _most_words(tests: DataFrame) -> int:
    """An item of n bytes has at most (n + 1) / 2 words in any script; the row itself counts as one more."""
    return tests.agg(F.sum(F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2) + 1)).first()[0] or 0


class Items:
    """The words of the items and their seeds in order, to find what a text holds of them."""

    def __init__(self, rows: list[tuple]):
        """rows: (id, words)."""
        known = [(i, w) for i, w in rows if len(w) >= SEED_WORDS]
        self.ids, self.words = [i for i, _ in known], [w for _, w in known]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        seeds = np.concatenate([np.empty(0, np.uint64), *(gram_hashes(w, SEED_WORDS) for w in self.words)])
        order = np.argsort(seeds, kind="stable")
        counts = self.lengths - SEED_WORDS + 1
        self.seeds, self.owner = seeds[order], np.repeat(np.arange(len(known)), counts)[order]
        self.place = (np.arange(len(seeds)) - np.repeat(np.cumsum(counts) - counts, counts))[order]
        self.bits = np.zeros(1 << 20, bool)  # most seeds of a document are in no item
        self.bits[self.seeds >> np.uint64(44)] = True

    def found(self, words: np.ndarray, threshold: float) -> Iterator[int]:
        """The items of which at least `threshold` lies under seeds that stand in the text. Time goes with the seeds found."""
        grams = gram_hashes(words, SEED_WORDS)
        grams = np.unique(grams[self.bits[grams >> np.uint64(44)]])
        first, last = np.searchsorted(self.seeds, grams), np.searchsorted(self.seeds, grams, side="right")
        count = last - first
        hits = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        hits = hits[np.argsort(self.owner[hits], kind="stable")]
        owners, begin, n = np.unique(self.owner[hits], return_index=True, return_counts=True)
        enough = SEED_WORDS * n >= threshold * self.lengths[owners]
        for k, s, m in zip(owners[enough].tolist(), begin[enough].tolist(), n[enough].tolist(), strict=True):
            under = covered(self.place[hits[s : s + m]], SEED_WORDS, int(self.lengths[k]))
            if under.sum() >= threshold * self.lengths[k]:
                yield k


def _broadcast_items(tests: DataFrame):
    return tests.sparkSession.sparkContext.broadcast(Items([(r["item_id"], words_of(r["text"])) for r in tests.collect()]))  # at most BROADCAST_WORDS words, checked before


def _by_broadcast(texts: DataFrame, tests: DataFrame, threshold: float) -> DataFrame:
    shared = _broadcast_items(tests)

    def rows(batches):
        items = shared.value
        for b in slices(batches):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for k in items.found(words, threshold):
                    out += _compare(doc_id, items.ids[k], items.words[k], words, threshold)
            yield _batch(out)

    return texts.mapInArrow(rows, PAIR)


def _seed_rows(id_name: str, df: DataFrame, bits=None) -> DataFrame:
    """(id, seed, place, n): a text's seeds, a document's once each; with `bits` (a broadcast) only those that it may hold."""
    import pyarrow as pa

    def rows(batches):
        for b in slices(batches):
            ids, hs, ps, ns = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                h = gram_hashes(words, SEED_WORDS)
                p = np.arange(len(h))
                if bits is not None:
                    place = h >> np.uint64(64 - FILTER_BITS)
                    p = p[(bits.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    h, first = np.unique(h[p], return_index=True)
                    p = p[first]
                ids += [i] * len(h)
                hs.append(h.view(np.int64))
                ps.append(p)
                ns += [len(words)] * len(h)
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([none, *hs])), pa.array(np.concatenate([none, *ps]).astype(np.int64)), pa.array(ns, pa.int64())], [id_name, "seed", "place", "n"])

    return df.mapInArrow(rows, f"{id_name} bigint, seed bigint, place bigint, n bigint")


def _by_shuffle(texts: DataFrame, tests: DataFrame, threshold: float) -> DataFrame:
    """Only seeds that a filter of FILTER_BITS bits doesn't rule out leave their documents, and pairs meet by an item's rarest seeds.

    A pair that counts shares seeds that cover threshold * n of the item's n words, so at least threshold * n / SEED_WORDS
    of them. Without the commonest seeds, one fewer than that, it still shares one. Documents of one id are told apart by their texts.
    """
    theirs = write_shared(_seed_rows("item_id", tests.withColumnRenamed("item_id", "id").withColumn("item_id", F.xxhash64("id", "text")).select("item_id", "text").distinct()), "seeds")
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    filled = theirs.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, value in filled.collect():  # at most 2 ** (FILTER_BITS - 6) rows
        bits[at] = value
    held = texts.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    own = write_shared(_seed_rows("key", keyed.select("key", "text"), held).select("key", "seed").distinct(), "found")
    shares = theirs.groupBy("seed").agg(F.count("*").alias("k"))
    order = Window.partitionBy("item_id").orderBy(F.col("k").desc(), "seed", "place")
    spared = F.ceil(F.lit(threshold) * F.col("n") / SEED_WORDS) - 1
    rare = theirs.join(shares, "seed").withColumn("rank", F.row_number().over(order)).where(F.col("rank") > spared).select("item_id", "seed").distinct()
    # a seed that stands in very many documents (a common phrase) is dealt over SALTS tasks, beyond what skew joins part
    salted = own.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    met = salted.join(rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["seed", "salt"]).select("key", "item_id").distinct()
    places = met.join(theirs, "item_id").join(own, ["key", "seed"]).select("key", "item_id", "n", F.explode(F.sequence("place", F.col("place") + SEED_WORDS - 1)).alias("at")).distinct()
    pairs = write_shared(places.groupBy("key", "item_id", "n").count().where(F.col("count") >= threshold * F.col("n")).select("key", F.col("item_id").alias("item_key")), "pairs")

    def rows(batches):
        for b in slices(batches):
            yield _batch([x for doc_id, item_id, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if len(i := words_of(item)) >= SEED_WORDS for x in _compare(doc_id, item_id, i, words_of(text), threshold)])

    items = tests.select("item_id", F.col("text").alias("item"), F.xxhash64("item_id", "text").alias("item_key"))
    both = pairs.join(items, "item_key").join(keyed, "key")
    return both.select("doc_id", "item_id", "item", "text").mapInArrow(rows, PAIR)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns. Each row is judged by its own text, whatever its id, null ids too."""
    tests = _tests(items)
    if _most_words(tests) <= broadcast_words:
        shared, text = _broadcast_items(tests), docs.columns.index("text")

        def rows(batches):
            import pyarrow as pa

            items = shared.value
            for b in slices(batches):
                clean = []
                for t in b.column(text).to_pylist():
                    words = words_of(t)
                    clean.append(not any(_compare(0, 0, items.words[k], words, threshold) for k in items.found(words, threshold)))
                yield b.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(rows, docs.schema)
    row = F.xxhash64(F.col("doc_id"), F.col("text"))  # rows of one id and text share their fate
    texts = docs.where("text is not null").select(row.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    bad = write_shared(_by_shuffle(texts, tests, threshold).select(F.col("doc_id").alias("_row")).distinct(), "bad")
    return docs.withColumn("_row", row).join(bad, "_row", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
