"""Near duplicates by 64-bit SimHash, linked through the anchors of a covering code.

Two halves of 23 bits of a fingerprint are each decoded by the binary Golay code, which is perfect: every 23-bit word
is within distance 3 (the covering radius) of exactly one codeword. The anchors are the pairs of codewords, 2**24 of
them. A fingerprint's home is its nearest anchor. It is replicated to every anchor that a fingerprint within the
threshold of it can have as its home: those within covering radius plus threshold, where the threshold is shared out
between the halves. Fingerprints are then compared per anchor, homes against replicas, over all 64 bits. No link is
missed: flipping f1 and f2 bits moves a word at most 3 + f1 and 3 + f2 away from the other's codewords.

`near_duplicates` links fingerprints, nothing else. `near_copies` is for filtering: it takes several fingerprints of a text's
words, links them in the same way, and then compares the texts themselves by the Jaccard similarity of their shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, gram_hashes, join_labels, slices, WordHashes, write_shared
from .repeats import packed, row_id, unpack

SHINGLE = 3
THRESHOLD = 2
HASH_SEED = 42
COPY_SHINGLE, COPY_TENTHS = 5, 8  # near copies: words of a shingle, least similarity in tenths
COPY_TABLES, COPY_THRESHOLD = 8, 1  # fingerprints of 46 bits, bits in which two of them may differ
COPY_BITS = 6  # bits of a fingerprint in which texts may differ on average over all of them
_BITS, _RADIUS = 23, 3
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_code: tuple | None = None


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text (UTF-8), A-Z lower-cased. No word: 0. Fewer words than a shingle: the whole sequence."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], HASH_SEED) for s, e in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed bigint."""
    import pyarrow as pa

    def of(batches):
        for b in slices(batches):
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(of, "doc_id bigint, fp bigint")


def _golay(threshold: int) -> tuple:
    """Syndromes of the words by byte, and for each syndrome the error patterns of weight at most 3 + threshold, as (start, patterns, excess over 3)."""
    global _code
    if _code is None or _code[0] != threshold:

        def rest(word: int) -> int:
            for bit in range(_BITS - 1, 10, -1):
                if word >> bit & 1:
                    word ^= _GENERATOR << (bit - 11)
            return word

        unit = [rest(1 << i) for i in range(_BITS)]
        tables = np.zeros((3, 256), np.int64)
        for j in range(3):
            for v in range(256):
                for i in range(8):
                    if v >> i & 1 and 8 * j + i < _BITS:
                        tables[j, v] ^= unit[8 * j + i]
        patterns, syndromes, excess = [], [], []
        for weight in range(_RADIUS + threshold + 1):
            for bits in combinations(range(_BITS), weight):
                p = s = 0
                for i in bits:
                    p |= 1 << i
                    s ^= unit[i]
                patterns.append(p)
                syndromes.append(s)
                excess.append(max(0, weight - _RADIUS))
        patterns, syndromes, excess = (np.array(x, np.int64) for x in (patterns, syndromes, excess))
        order = np.lexsort((excess, syndromes))
        first = np.searchsorted(syndromes[order], np.arange(2049))
        _code = (threshold, tables, first, patterns[order], excess[order])
    return _code[1:]


def anchors_of(fps: np.ndarray, threshold: int, home_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, anchor) for each anchor of each fingerprint."""
    tables, first, patterns, excess = _golay(threshold)
    bits = fps.view(np.uint64)
    halves = [((bits >> np.uint64(_BITS * j)) & np.uint64((1 << _BITS) - 1)).astype(np.int64) for j in (0, 1)]
    syn = [tables[0][h & 255] ^ tables[1][h >> 8 & 255] ^ tables[2][h >> 16] for h in halves]
    if home_only:  # the first pattern of each syndrome is its only one of weight 3 or less
        near = [h ^ patterns[first[s]] for h, s in zip(halves, syn, strict=True)]
        return np.arange(len(fps)), near[0] << _BITS | near[1]
    counts = [first[s + 1] - first[s] for s in syn]
    total = counts[0] * counts[1]
    who = np.repeat(np.arange(len(fps)), total)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(total) - total, total)
    i = first[syn[0]][who] + nth // counts[1][who]
    j = first[syn[1]][who] + nth % counts[1][who]
    keep = excess[i] + excess[j] <= threshold
    who, i, j = who[keep], i[keep], j[keep]
    return who, (halves[0][who] ^ patterns[i]) << _BITS | (halves[1][who] ^ patterns[j])


def links(distinct_fps: DataFrame, threshold: int = THRESHOLD, by: str | None = None) -> DataFrame:
    """Pairs a < b (signed order) of the distinct fingerprints `fp` that differ in 1 to `threshold` bits, each once; within each value of the int column `by`."""
    import pyarrow as pa

    kept = [by] if by else []

    def at(home_only: bool):
        def rows(batches):
            for b in slices(batches):
                all_fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                groups = b.column(1).to_numpy(zero_copy_only=False) if by else None
                for k in range(0, len(all_fps), 256):
                    fps = all_fps[k : k + 256]
                    who, anchor = anchors_of(fps, threshold, home_only)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[who]), *([pa.array(groups[k : k + 256][who], pa.int32())] if by else [])], ["anchor", "fp", *kept])

        return distinct_fps.select("fp", *kept).mapInArrow(rows, ", ".join(["anchor bigint, fp bigint", *(f"{c} int" for c in kept)]))

    home, replica = at(True).withColumnRenamed("fp", "a"), at(False).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.hint("merge").join(replica, ["anchor", *kept]).where(near).select(*kept, "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id reachable over links of `threshold` bits or fewer.

    Null and empty texts and texts without words have fingerprint 0 and link like any others. Rows with a null id get
    a component only through others. Repeated rows come back as often as they came. Other columns are not looked at. No
    rows: no rows. Copies are one fingerprint; only distinct fingerprints are compared, and their labels go back to the
    rows so that no group of copies, however large, meets in one task (join_labels).
    """
    fps = write_shared(fingerprints(docs, id_col, text_col, shingle), "fps")
    groups = write_shared(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    roots = components(links(groups, threshold))
    member = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("key", F.coalesce("root", "fp"))
    least = member.where("root is not null").groupBy("key").agg(F.min("least").alias("component_id"))
    label = member.where("n > 1 or root is not null").join(least, "key", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_labels(fps, write_shared(label, "labels"), ["fp"]).select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


_words = WordHashes()


def word_fingerprints(words: list[bytes], tables: int = COPY_TABLES) -> np.ndarray:
    """`tables` SimHashes of 46 bits of a text's words, repeats included. Texts that differ in a few words differ in a few bits of most."""
    distinct, counts = np.unique(_words.of(words), return_counts=True)
    ones, seeds = np.zeros(tables * 64, np.float64), (np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, len(distinct), 4096):
        h = distinct[at : at + 4096, None] + seeds
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        ones += counts[at : at + 4096].astype(np.float32) @ bits.astype(np.float32)
    full = np.packbits(2 * ones > len(words), bitorder="little").view("<u8")
    return (full & np.uint64((1 << 2 * _BITS) - 1)).view(np.int64)


def shingle_set(text: bytes | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (UTF-8), A-Z lower-cased. Fewer words than a shingle: the whole sequence."""
    ids = _words.of(text.lower().split() if text else [])
    return np.unique(gram_hashes(ids, max(1, min(shingle, len(ids)))))


def _alike(pairs: DataFrame, held: DataFrame, shingle: int, tenths: int, chunk: int = 250) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets reach the similarity: common / (all - common) >= tenths / 10. held: (key, text), packed.

    A hub a with many partners is dealt out in groups of about `chunk`; its text comes first in each, the partners follow
    one at a time, so a task holds two texts.
    """
    import pyarrow as pa

    hubs = write_shared(pairs.groupBy("a").agg(F.count("*").alias("n")), "hubs").withColumn("salts", F.ceil(F.col("n") / chunk).cast("int"))
    salted = join_labels(pairs, hubs, ["a"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    text = held.select(F.col("key").alias("a"), "text")
    first = hubs.join(text, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    rest = salted.join(text.withColumnRenamed("a", "b"), "b").select("a", "salt", "b", "text")

    def rows(batches):
        hub, own = None, None
        for batch in batches:
            out = [[], []]
            for a, b, packed_text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                grams = shingle_set(unpack(packed_text), shingle)
                if b is None:
                    hub, own = a, grams
                elif a == hub:
                    common = len(np.intersect1d(own, grams, assume_unique=True))
                    if common * (10 + tenths) >= tenths * (len(own) + len(grams)):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["a", "b"])

    return first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(rows, "a binary, b binary")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, tenths: int = COPY_TENTHS, tables: int = COPY_TABLES, threshold: int = COPY_THRESHOLD, bits: int = COPY_BITS) -> DataFrame:
    """(no_id, doc_id, rid, members): one row for each class of near copies, the class's first row (by id, then by row_id() of the text).

    Texts of the same words (A-Z lower-cased) are one. Each has `tables` fingerprints; texts of one fingerprint make a
    cell. The text of the least key leads its cell; it is compared with the cell's others and, where two cells'
    fingerprints differ in `threshold` bits or fewer, with the other's leader. Of these pairs those go on whose
    fingerprints differ in `bits` bits on average or fewer, and whose numbers of distinct shingles allow the similarity:
    their texts are compared. Those with a similarity of tenths / 10 or more are linked, and what is linked, over any
    steps, is one class. Pairs whose fingerprints are apart, or that no leader stands for, are not found; the README
    gives the measured share. So a large group costs a comparison for each member and table, never all pairs.

    Texts without words are copies of each other. Rows with a null id (no_id) come after all others and are only grouped
    with texts of the same words. Rows repeated under one id are told by their texts. No rows: no rows.
    """
    import pyarrow as pa
    import xxhash

    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_id(text).alias("rid"), text.alias("text"))

    def read(batches):
        for b in slices(batches):
            keys, fps, sizes = [], [], []
            for t in b.column(2).to_pylist():
                words = t.lower().split() if t else []
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fps.append(word_fingerprints(words, tables))
                sizes.append(len(shingle_set(t, shingle)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(fps, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "rid", "key", "fps", "size"])

    base = rows.mapInArrow(read, "doc_id bigint, rid bigint, key binary, fps array<bigint>, size bigint")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    nodes = write_shared(base.groupBy("key").agg(F.min(at).alias("at"), F.count("*").alias("members"), F.first("fps").alias("fps"), F.first("size").alias("size")), "nodes")
    cells = nodes.where("not at.no_id").select("key", F.posexplode("fps").alias("t", "fp"))
    groups = write_shared(cells.groupBy("t", "fp").agg(F.min("key").alias("leader"), F.count("*").alias("n")), "cells")
    inside = join_labels(cells, groups.where("n > 1"), ["t", "fp"]).where("leader < key").select(F.col("leader").alias("a"), F.col("key").alias("b"))
    close = links(groups, threshold, "t")
    for end in ("a", "b"):
        close = close.join(groups.select("t", F.col("fp").alias(end), F.col("leader").alias(f"lead_{end}")), ["t", end])
    across = close.where("lead_a <> lead_b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    pairs = inside.union(across).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("key").alias(end), F.col("fps").alias(f"fps_{end}"), F.col("size").alias(f"size_{end}")), end)
    apart = F.aggregate(F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    fits = 10 * F.least("size_a", "size_b") >= tenths * F.greatest("size_a", "size_b")
    pairs = write_shared(pairs.where(fits & (apart <= bits * tables)).select("a", "b"), "pairs")
    wanted = nodes.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key", "left_semi").select("key", "at.doc_id", "at.rid")
    held = write_shared(packed(rows).join(wanted, ["doc_id", "rid"]).select("key", "text").dropDuplicates(["key"]), "held")
    roots = components(_alike(pairs, held, shingle, tenths))
    member = nodes.select("key", "at", "members").join(roots.withColumnRenamed("node", "key"), "key", "left")
    return member.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("at").alias("at"), F.sum("members").alias("members")).select("at.*", "members")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their class of near copies, with all their columns; of equal rows one. options: see near_copies."""
    key = ["_no_id", "_doc_id", "_rid"]
    named = lambda df, doc_id, rid: df.withColumns({"_no_id": doc_id.isNull(), "_doc_id": F.coalesce(doc_id.cast("bigint"), F.lit(0).cast("bigint")), "_rid": rid})
    kept = write_shared(named(near_copies(docs, **options), F.col("doc_id"), F.col("rid")).select(*key), "kept")
    rows = named(docs, F.col("doc_id"), row_id(F.col("text")))
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
