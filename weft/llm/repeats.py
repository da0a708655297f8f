"""Candidate search for repeated windows, shared by the two substring deduplications.

Every window of `length` units (words or bytes) is anchored at the gram of k units that has the least hash in it, the first
if there are several, and represented by that gram. Equal windows have equal representatives at equal distances from their starts,
and neighbouring windows mostly share an anchor, so a text has few runs of windows. Representatives that occur once in the
corpus rule out all their windows exactly; only the windows of repeated ones travel on, as short segments of text routed by
representative, to the method that compares them. Which windows are equal is the method's decision alone.

A representative of many runs (a common line) is routed by finer keys: windows at about the same distance from it meet by
the units that they all hold; one of very many runs by whole windows. So a route's segments stay few however common a
passage is. Nothing is dropped or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, slices, sliding, write_shared

PIECE = 1 << 20


@dataclass(frozen=True)
class Windows:
    length: int  # units of a window
    gram: int  # units of the grams whose least hash represents a window
    within: bool  # do repeats within one document count?
    split: int  # windows per segment where a representative is common
    units: Callable[[bytes], tuple]  # text -> (ids of its units, units that `join` takes)
    join: Callable[[object, int, int], bytes]  # units, start, end -> bytes of a segment
    common: int  # a representative of more runs than this is common
    very_common: int  # and of more than this, very common

    @property
    def width(self) -> int:
        return self.length - self.gram + 1

    def pieces(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By pieces of bounded size, the runs of windows of one anchor: (first window of the piece, starts, ends, anchors, representatives)."""
        place = np.uint64((1 << 21) - 1)  # enough for the places of a piece
        for at in range(0, max(0, len(ids) - self.length + 1), PIECE):
            grams = gram_hashes(ids[at : at + PIECE + self.length - 1], self.gram)
            least = sliding(grams & ~place | np.arange(len(grams), dtype=np.uint64), self.width)
            cuts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1], [True])))
            anchors = (least[cuts[:-1]] & place).astype(np.int64)
            yield at, cuts[:-1], cuts[1:], anchors, grams[anchors]


def row_id(text):
    """Tells rows apart that have one id but different texts."""
    return F.xxhash64(text.cast("binary"))


def with_row_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rid, text), the text as bytes."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_id(text).alias("rid"), text.alias("text"))


def base_table(docs: DataFrame, w: Windows) -> DataFrame:
    """Per row: doc_id, rid, n units, sha256 of all units, its representatives and of how many runs each is. Written."""
    import pyarrow as pa

    def rows(batches):
        for b in slices(batches):
            out = [[], [], [], []]
            for text in b.column(2).to_pylist():
                ids, units = w.units(text or b"")
                found = [piece[4] for piece in w.pieces(ids)]
                reps, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(w.join(units, 0, len(ids))).hexdigest())
                out[2].append(reps.view(np.int64))
                out[3].append(times)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "rid", "n", "sha", "reps", "times"])

    return write_shared(docs.mapInArrow(rows, "doc_id bigint, rid bigint, n bigint, sha string, reps array<bigint>, times array<bigint>"), "base")


def repeated_by_document(base: DataFrame, w: Windows) -> DataFrame:
    """(doc_id, reps, ranks, twin): the document's representatives that also stand elsewhere, with their ranks; written.

    Ranks 0, 1, 2: rare, common, very common. twin: the id has several rows.
    """
    known = base.where("doc_id is not null")
    pairs = known.select("doc_id", F.explode("reps").alias("h"))  # a row lists each of its representatives once
    counts = pairs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    again = known.select(F.explode(F.arrays_zip("reps", "times")).alias("r")).where("r.times > 1").groupBy(F.col("r.reps").alias("h")).agg(F.sum(F.col("r.times") - 1).alias("more"))
    if w.within:
        counts = counts.where("n > 1").join(again, "h", "full")
    else:
        counts = counts.where("low < high").join(again, "h", "left")
    n = F.coalesce("n", F.lit(1)) + F.coalesce("more", F.lit(0))
    counts = counts.select("h", F.when(n > w.very_common, 2).when(n > w.common, 1).otherwise(0).alias("rank"))
    found = pairs.join(counts, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "rank")).alias("r"))
    twins = known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", F.lit(True).alias("twin"))
    return write_shared(found.join(twins, "doc_id", "left").select("doc_id", F.col("r.h").alias("reps"), F.col("r.rank").alias("ranks"), F.coalesce("twin", F.lit(False)).alias("twin")), "repeated")


def candidate_runs(ids: np.ndarray, reps: list, ranks: list, w: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """(representatives, ranks, starts, ends, anchors) of the text's runs whose representative stands elsewhere too, by pieces."""
    known = np.array(reps, np.int64).view(np.uint64)
    order = np.argsort(known)
    known, rank_of = known[order], np.array(ranks, np.int64)[order]
    for at, starts, ends, anchors, own in w.pieces(ids):
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        found = np.flatnonzero(known[place] == own)
        yield own[found].view(np.int64), rank_of[place[found]], at + starts[found], at + ends[found], at + anchors[found]


def candidate_windows(ids: np.ndarray, reps: list, ranks: list, w: Windows) -> np.ndarray:
    """Mask of the text's windows that may stand elsewhere too."""
    edges = np.zeros(len(ids) + 1, np.int8)
    for _, _, starts, ends, _ in candidate_runs(ids, reps, ranks, w):
        edges[starts] += 1  # runs don't overlap
        edges[ends] -= 1
    return np.cumsum(edges, dtype=np.int8).astype(bool)


def routed(ids: np.ndarray, s: int, e: int, anchor: int, split: int, w: Windows) -> Iterator[tuple[int, int, int]]:
    """(route, start, end) of the parts of a run whose representative is common; each depends on a window's own content alone, so equal windows meet.

    Windows are grouped by their distance from the anchor, `split` to a group; what all windows of a group hold makes the route.
    """
    windows = np.arange(s, e)
    core_at = anchor - (anchor - windows) // split * split
    cores = gram_hashes(ids[s : e - 1 + w.length], w.length - split + 1).view(np.int64)
    edges = [s, *(s + 1 + np.flatnonzero(np.diff(core_at))).tolist(), e]
    for x, y in zip(edges, edges[1:], strict=False):
        yield int(cores[core_at[x - s] - s]), x, y


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, text) with the text compressed, for the joins that must move whole texts. Rows with a null id go."""
    import pyarrow as pa
    import zstandard

    def rows(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([compress(t or b"") for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "rid", "text"])

    return docs.where("doc_id is not null").mapInArrow(rows, "doc_id bigint, rid bigint, text binary")


def unpack(text: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(text)


def segments(docs: DataFrame, repeated: DataFrame, w: Windows) -> DataFrame:
    """(route, seg, off, own, doc_id, start): candidate windows as the text that they cover, with the first place where a task met that text.

    docs: packed(). off: distance of the anchor from the segment's start. own: see own_row(); by it each row of an id gets
    its own places. Copies meet in a table of bounded size in the task, before they are shuffled.
    """
    import pyarrow as pa

    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["route", "seg", "off", "own", "doc_id", "start"]

    def batch(met: dict):
        columns = list(zip(*((*k, *v) for k, v in met.items()), strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    def rows(batches):
        met: dict[tuple, tuple[int, int]] = {}
        for b in slices(batches):
            for doc_id, own, text, reps, ranks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, units = w.units(unpack(text))
                last = None
                for piece in candidate_runs(ids, reps, ranks, w):
                    for rep, rank, s, e, anchor in zip(*(x.tolist() for x in piece), strict=True):
                        last, before = (rep, w.join(units, s, e - 1 + w.length), anchor - s, own), last
                        if last == before:  # within a run of one character, say: these windows stand just before
                            continue
                        parts = routed(ids, s, e, anchor, w.split if rank == 1 else 1, w) if rank else ()
                        keys = [((route, w.join(units, x, y - 1 + w.length), anchor - x, own), (doc_id, x)) for route, x, y in parts] or [(last, (doc_id, s))]
                        for key, at in keys:
                            if (was := met.get(key)) is None or at < was:
                                met[key] = at
                        if len(met) >= 50_000:
                            yield batch(met)
                            met.clear()
        yield batch(met)

    joined = docs.join(repeated, "doc_id").select("doc_id", own_row(), "text", "reps", "ranks")
    return joined.mapInArrow(rows, ", ".join(f"{n} {'binary' if n == 'seg' else 'bigint'}" for n in names))


def own_row():
    """0, but the row's rid where its id has several rows."""
    return F.when(F.col("twin"), F.col("rid")).otherwise(F.lit(0)).alias("own")


def shards(found: DataFrame) -> DataFrame:
    """(route, seg, off, own, doc_id, start): distinct segments with their first place, dealt by route, each task's rows sorted by route. One shuffle."""
    first = F.min(F.struct("doc_id", "start")).alias("at")
    return found.repartition("route").groupBy("route", "seg", "off", "own").agg(first).sortWithinPartitions("route").select("route", "seg", "off", "own", "at.*")


def first_places(shard_rows: DataFrame, decide: Callable, most: int) -> DataFrame:
    """(doc_id, own, s array, e array): for each row the ranges of candidate windows that `decide` finds to stand nowhere before.

    decide: Arrow table (route, seg, off, own, doc_id, start) -> four arrays doc_id, own, from, to. It is given whole
    routes, as many at a time as hold about `most` bytes together.
    """
    import pyarrow as pa

    names = ["doc_id", "own", "s", "e"]

    def rows(batches):
        def decided(table):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in decide(table)], names)

        held, size = [], 0
        for b in slices(batches):
            held.append(b)
            size += b.column(1).nbytes
            if size < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            routes = table["route"].to_numpy()
            cut = int(np.searchsorted(routes, routes[-1]))  # the last route may go on
            if cut:
                yield decided(table.slice(0, cut))
                table = table.slice(cut)
            held, size = table.to_batches(), table["seg"].nbytes
        if held:
            yield decided(pa.Table.from_batches(held).combine_chunks())

    places = shard_rows.mapInArrow(rows, "doc_id bigint, own bigint, s bigint, e bigint")
    return places.groupBy("doc_id", "own").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
