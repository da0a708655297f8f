"""Ranked lexical search: best-first over intervals of documents, bounded by range maxima of the terms' posting lists.

Documents are reduced once to the counts of the terms that the queries hold. Each task takes blocks of documents, in order
of their ids, and lays out a posting list of impacts for each term with a sparse table of range maxima. A query starts with one
interval, the block. An interval's bound is the sum, over the query's terms, of the weighted maximum of each term's
postings in it. The intervals of highest bound are split at the document of their largest weighted impact: it is scored, and
what lies before and after it becomes two intervals with bounds of their own. When no bound reaches the k-th best score so far, the
rest of the block holds no result. The best of a task's blocks go on to its next block, and those of all tasks are merged.

Queries go by blocks of bounded size, each with its terms broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, slices, write_shared

#: Bytes of queries to a block; what is broadcast is a small multiple of it.
QUERY_BYTES = 8 << 20
#: A block of documents ends with the document that fills it.
BLOCK_POSTINGS, BLOCK_DOCUMENTS = 1_000_000, 1 << 17
SPLIT_AT_ONCE = 128
#: A-Z lower-cased, the separators as blanks; bytes of other letters as they are.
_LETTERS = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


@dataclass(frozen=True)
class Queries:
    ids: list  # of each query
    terms: list[dict[int, int]]  # of each query: term number -> how often
    numbers: dict[bytes, int]  # of the terms

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        """rows: (id, text as bytes or None)."""
        numbers: dict[bytes, int] = {}
        terms = [dict(Counter(numbers.setdefault(w, len(numbers)) for w in terms_of(text))) for _, text in rows]
        return Queries([r[0] for r in rows], terms, numbers)


def term_counts(docs: DataFrame, queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its number of terms, and those of the queries (a broadcast) with their counts."""
    import pyarrow as pa

    def rows(batches):
        numbers = queries.value.numbers
        for b in slices(batches):
            ids, ns, sizes, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                own = Counter(filter(numbers.__contains__, words))
                ids.append(doc_id)
                ns.append(len(words))
                terms += map(numbers.__getitem__, own)
                tfs += own.values()
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(rows, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Postings:
    """The posting lists of a block, end to end: documents in order, impacts, and the sparse table of places of range maxima."""

    def __init__(self, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, n: int, total: int):
        """lengths: of the documents; doc, term and tf of each posting, by document."""
        order = np.argsort(term, kind="stable")
        self.n_docs, self.doc, tf = len(lengths), doc[order], tf[order].astype(np.int64)
        m = 75 + (25 * lengths * n) // total
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.key = term[order].astype(np.int64) * (self.n_docs + 1) + self.doc
        longest = int(np.diff(self.start).max(initial=0))
        self.table = [np.arange(len(doc), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            half = 1 << (len(self.table) - 1)
            a, b = self.table[-1][:-half], self.table[-1][half:]
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a))

    def largest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each range first <= place < last of one list the place of its largest impact; -1 for empty ranges."""
        size = last - first
        out = np.full(first.shape, -1, np.int32)
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]):
            at = (level == k) & (size > 0)
            a, b = self.table[k][first[at]], self.table[k][last[at] - (1 << k)]
            out[at] = np.where(self.impact[b] > self.impact[a], b, a)
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best documents of the block with a score of `least` and above 0; ties by document."""
        some = self.start[terms + 1] > self.start[terms]
        terms, weights = terms[some], weights[some]
        docs = scores = np.empty(0, np.int64)
        if not len(terms):
            return docs, scores
        least = max(least, 1)
        base = terms.astype(np.int64) * (self.n_docs + 1)

        def bounded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bound of each interval, and the document to split it at. A row for each interval, a column for each term."""
            top = self.largest(first, last)
            worth = np.where(top >= 0, weights * self.impact[top], -1)
            at = np.argmax(worth, axis=1)
            return np.maximum(worth, 0).sum(axis=1), self.doc[top[np.arange(len(top)), at]]

        first, last = self.start[terms][None, :], self.start[terms + 1][None, :]
        bound, split = bounded(first, last)
        while len(bound):
            keep = bound >= least
            if not keep.all():
                first, last, bound, split = first[keep], last[keep], bound[keep], split[keep]
                if not len(bound):
                    break
            if len(bound) > SPLIT_AT_ONCE:
                order = np.argpartition(-bound, SPLIT_AT_ONCE)
                now, later = order[:SPLIT_AT_ONCE], order[SPLIT_AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            f, e, d = first[now], last[now], split[now]
            place = np.searchsorted(self.key, base[None, :] + d[:, None])
            held = (place < e) & (self.doc[np.minimum(place, len(self.doc) - 1)] == d[:, None])
            score = (weights * self.impact[np.minimum(place, len(self.doc) - 1)] * held).sum(axis=1)
            docs, scores = np.concatenate((docs, d)), np.concatenate((scores, score))
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(docs) == k:
                least = max(least, int(scores[-1]))
            fresh = np.concatenate((f, place + held)), np.concatenate((place, e))
            found = bounded(*fresh)
            alive = found[0] >= least
            first, last = np.concatenate((first[later], fresh[0][alive])), np.concatenate((last[later], fresh[1][alive]))
            bound, split = np.concatenate((bound[later], found[0][alive])), np.concatenate((split[later], found[1][alive]))
        good = scores >= max(least, 1) if len(docs) == k else scores > 0
        return docs[good], scores[good]


def best_of_tasks(counts: DataFrame, queries, weights, k: int, n: int, total: int) -> DataFrame:
    """(q, doc_id, score): for each query (its number) the k best documents of each task. queries, weights (of each term): broadcasts."""
    import pyarrow as pa

    def rows(batches):
        wanted, weight = queries.value, weights.value
        asked = [(np.fromiter(t, np.int64, len(t)), np.fromiter(t.values(), np.int64, len(t)) * weight[np.fromiter(t, np.int64, len(t))]) for t in wanted.terms]
        best = [[] for _ in asked]  # (-score, id is null, id) of each query

        def search(held: list) -> None:
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls last
            ids, terms = table["doc_id"].to_pylist(), table["terms"].combine_chunks()
            size = np.diff(terms.offsets.to_numpy())
            tf = table["tfs"].combine_chunks().flatten().to_numpy()
            lists = Postings(table["n"].to_numpy(), np.repeat(np.arange(len(ids)), size), terms.flatten().to_numpy(), tf, len(weight), n, total)
            for x, (own, w) in enumerate(asked):
                docs, scores = lists.best(own, w, k, -best[x][-1][0] if len(best[x]) == k else 0)
                more = ((-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True))
                best[x] = sorted([*best[x], *more])[:k]

        held, postings, documents = [], 0, 0
        for b in slices(batches):
            held.append(b)
            postings, documents = postings + len(b.column(2).flatten()), documents + b.num_rows
            if postings >= BLOCK_POSTINGS or documents >= BLOCK_DOCUMENTS:
                search(held)
                held, postings, documents = [], 0, 0
        if held:
            search(held)
        out = [(x, None if null else i, -s) for x, found in enumerate(best) for s, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["q", "doc_id", "score"])

    return counts.where("size(terms) > 0").mapInArrow(rows, "q int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its k best rows of docs with a score above 0, all if fewer.

    Ranks run from 1; equal scores go by ascending doc_id, null last. Null and empty texts hold no terms: such items have no
    rows, such documents aren't ranked and don't count. Each row is a document or an item of its own, whatever its
    id, so rows of repeated items come once for each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16)).first()[0] or 0) // query_bytes
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about query_bytes
        wanted = Queries.of([(r[0], bytes(r[1]) if r[1] is not None else None) for r in held])
        if not wanted.numbers:
            continue
        queries = spark.sparkContext.broadcast(wanted)
        counts = write_shared(term_counts(own, queries), "terms")
        n, total = counts.agg(F.count("*"), F.sum("n")).first()
        df = {r[0]: r[1] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # of the block's terms
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(wanted.numbers))]
        found = best_of_tasks(counts, queries, spark.sparkContext.broadcast(np.array(weight, np.int64)), k, n, total or 1)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("part", F.spark_partition_id() % 64)
        for key in (["q", "part"], ["q"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(wanted.ids)), "q int, item_id bigint")
        out = out.union(found.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
