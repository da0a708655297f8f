"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: ASCII white space: a word is a maximal run of other characters. bytes.split() cuts at exactly these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


write_shared = cut_lineage


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def slices(batches, rows: int = 512):
    """The batches in parts of a few hundred rows, so that a task's Python objects stay few."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with `place`, each row's place in the order from 0, and for each of `sums` the sum over the rows before it.

    The order must be total and its columns not null but where it says so. Rows are range-partitioned by it; what is put
    together in one place is one row of sums for each partition.
    """
    parts = write_shared(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(F.count("*").alias("_place"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_{x}") for x in ("place", *sums)))
    own = Window.partitionBy("_part").orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.select("*", (F.row_number().over(own) - 1).alias("place"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in sums.items()))
    out = inside.join(F.broadcast(totals), "_part")  # a row for each shuffle partition
    return out.select(*df.columns, *((F.col(x) + F.col(f"_{x}")).alias(x) for x in ("place", *sums)))


class WordHashes(dict):
    """64-bit hash of a word, remembered; cleared when it holds 200,000 words, so memory stays bounded."""

    def __missing__(self, word):
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(12, (n - 1).bit_length())
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        _powers[base] = table = np.multiply.accumulate(factors)
    return table[:n]


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive ids (rolling polynomial modulo 2**64, mixed). Equal runs have equal hashes anywhere."""
    n = len(ids)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(ids * _power_table(_BASE, n), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _power_table(_INVERSE, n - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over each `width` consecutive values (block prefixes and suffixes, so linear in the number of values)."""
    n = len(values)
    if n < width:
        return np.empty(0, values.dtype)
    if width == 1:
        return values
    fill = np.iinfo(values.dtype).max if op is np.minimum else np.iinfo(values.dtype).min
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n places that a window of this width from one of the starts covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, n), -1)
    return np.cumsum(edges[:-1]) > 0


def runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of each maximal run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def join_labels(rows: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """rows left-joined with labels(*on, n, ...), one per key, n the number of rows that have it; n is left out.

    Labels of keys that more than a ten-thousandth of all rows share, so of fewer than 10,000 keys, are broadcast; the
    other keys meet by shuffle, where none is hot. Columns of `on` must not be null where they are to match.
    """
    total = labels.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > 1_000 + total // 10_000
    extra = [c for c in labels.columns if c not in (*on, "n")]
    found = rows.join(F.broadcast(labels.where(hot).select(*on, *extra, F.lit(True).alias("_hot"))), on, "left")
    rest = found.where(F.col("_hot").isNull()).select(*rows.columns).join(labels.where(~hot).select(*on, *extra), on, "left")
    return found.where(F.col("_hot")).select(*rows.columns, *extra).union(rest.select(*rows.columns, *extra))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b: of one type that can be ordered): one row (node, root) per node that has a link, root its component's smallest.

    Alternating large-star and small-star steps, each written to the shared folder, until no link changes; the number
    of steps grows with the logarithm of the number of nodes. Self-links and repeated links are harmless; no links: no rows.
    """
    edges = write_shared(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = mark(edges)
    while True:
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        stars = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = write_shared(stars.where("a <> b"), "stars", replaces=edges)
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        stars = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = write_shared(stars.distinct(), "stars", replaces=edges)
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
