"""Periodic runs within a document: stretches of words that repeat with a period, found by seeds that are extended along diagonals.

A run of period q is a match of the words with themselves at lag q. Lags are worked on in classes [lo, 2 lo), the first being
[1, 12). In each, a run that counts (12 words and two periods at least) is a match of at least 2 g words, so it holds a
whole block of g words that starts at a multiple of g. These g-grams are indexed; a block's occurrences at a lag of the class
are its seed pairs. So a class has a number of pairs in proportion to the words, however often a gram occurs. Pairs of a lag are
taken in order: each is extended to its maximal match, and a table with the furthest place covered on each lag passes over
the pairs that lie in it. Pairs inside a known run of which the period divides the lag are no new run.

Grams are numbered by doubling, so equal numbers mean equal words, and extension compares numbers of halving lengths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, read_table, slices

LEAST = 12
BLOCK = 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def gram_numbers(ids: np.ndarray) -> list[np.ndarray]:
    """For each l the numbers of the grams of BLOCK * 2**l words, by their place; up to the first length of which no gram occurs twice."""
    out, n = [], len(ids)
    size = BLOCK
    numbers = ids.astype(np.int64)
    base = int(numbers.max(initial=0)) + 1
    grams = numbers[: n - 2] * base + numbers[1 : n - 1]
    grams = np.unique(grams, return_inverse=True)[1] * base + numbers[2:]
    while True:
        distinct, numbers = np.unique(grams, return_inverse=True)
        out.append(numbers)
        if len(distinct) == len(numbers) or 2 * size > n:
            return out
        grams = numbers[:-size] * len(distinct) + numbers[size:]
        size *= 2


def extended(ids: np.ndarray, levels: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of places i and i + q the maximal match (start, end) of the words from i with those at lag q."""
    left, right = i.copy(), i.copy()
    for level in range(len(levels) - 1, -1, -1):
        size, numbers = BLOCK << level, levels[level]
        most = len(numbers) - 1
        at = right + q
        right += size * ((at <= most) & (numbers[np.minimum(right, most)] == numbers[np.minimum(at, most)]))
        at = left - size
        left -= size * ((at >= 0) & (numbers[np.maximum(at, 0)] == numbers[np.minimum(np.maximum(at, 0) + q, most)]) & (at + q <= most))
    most = len(ids) - 1
    for _ in range(BLOCK - 1):
        right += (right + q <= most) & (ids[np.minimum(right, most)] == ids[np.minimum(right + q, most)])
        left -= (left > 0) & (ids[np.maximum(left - 1, 0)] == ids[np.maximum(left - 1, 0) + q])
    return left, right


def seed_pairs(numbers: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): the blocks of `size` words at multiples of it, with their occurrences at lags lo <= lag < hi."""
    wide = len(numbers) + hi + 1
    order = np.argsort(numbers, kind="stable")
    index = numbers[order] * wide + order
    blocks = np.arange(0, len(numbers), size)
    first, last = (np.searchsorted(index, numbers[blocks] * wide + blocks + lag) for lag in (lo, hi))
    count = last - first
    place = np.repeat(blocks, count)
    found = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(place))]
    return place, found - place


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of the words that `ids` number, by start, then period."""
    found = np.empty((0, 3), np.int64)
    if len(ids) < LEAST:
        return found
    levels = gram_numbers(ids)
    for level, numbers in enumerate(levels):
        size = BLOCK << level
        lo, hi = 2 * size if level else 1, 4 * size
        i, q = seed_pairs(numbers, size, lo, hi)
        if len(found) and len(i):  # found by start: the known run that reaches furthest of those that start at i or before
            ends = found[:, 0] + found[:, 1]
            far = np.maximum.accumulate(ends)
            which = np.maximum.accumulate(np.where(ends == far, np.arange(len(ends)), 0))
            last = np.searchsorted(found[:, 0], i, side="right") - 1
            run = which[np.maximum(last, 0)]
            new = ~((last >= 0) & (ends[run] >= i + q + size) & (q % found[run, 2] == 0))
            i, q = i[new], q[new]
        order = np.lexsort((i, q))
        i, q = i[order], q[order]
        covered = np.zeros(hi, np.int64)
        matches = []
        while len(i):
            first = np.concatenate(([True], q[1:] != q[:-1]))
            s, e = extended(ids, levels, i[first], q[first])
            matches.append(np.stack((s, e + q[first] - s, q[first]), axis=1))
            covered[q[first]] = e
            rest = i >= covered[q]
            i, q = i[rest], q[rest]
        if matches:
            both = np.concatenate((found, *matches))
            both = both[both[:, 1] >= np.maximum(LEAST, 2 * both[:, 2])]
            both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
            same = (both[1:, 0] == both[:-1, 0]) & (both[1:, 1] == both[:-1, 1])  # one stretch: its smallest period counts
            found = both[np.concatenate(([True], ~same))] if len(both) else both
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs, in one pass without a shuffle.

    runs: array of (start, length, period) in words from 0, by start, then period: maximal stretches of 12 words and two
    periods at least, under their smallest period. collapsed: the words as binary, joined by single spaces, without those
    that a run holds after its first period. Null and empty texts have no words and no runs. Repeated rows and rows with a null
    id are like others; other columns are not looked at.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def rows(batches):
        for b in slices(batches):
            counts, sizes, all_runs, texts = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = (text or b"").split()
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                found = find_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                if len(found):
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, found[:, 0] + found[:, 2], 1)
                    np.add.at(edges, found[:, 0] + found[:, 1], -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                else:
                    kept = words
                counts.append(len(words))
                sizes.append(sizes[-1] + len(found))
                all_runs.append(found)
                texts.append(b" ".join(kept))
            flat = np.concatenate(all_runs) if all_runs else np.empty((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    whole = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return whole.mapInArrow(rows, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed binary")


def with_periods(text: Column, doc_id: Column) -> Column:
    """The contract's change of the text: of each tenth document the words from some place on repeat with a period drawn from crc32 of the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        own = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(own, " "))

    once = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"))), changed)  # words are taken out once
    return F.coalesce(F.when(h % 10 == 0, F.get(once, F.lit(0))), text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
