"""Exact removal of byte strings that stand earlier in the corpus, by blockwise suffix sorting with a difference cover.

`repeats` narrows the corpus to segments whose 100-byte windows can repeat, routed so that equal windows meet. Sorted by
route they form blocks of bounded size. Segments are laid into a block with their anchors at multiples of 13, so equal
windows start at equal residues. The suffixes at a difference cover's positions (4 of 13 residues) are ranked first, by
doubling, up to 91 bytes. Then one suffix bucket (a leading byte) is sorted at a time: a window's first bytes lead to the
next cover position, whose rank settles the long tie in one comparison, and the bytes behind settle the rest. Equal
windows stand together in this order; the earliest (document, start) of each stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, read_table, runs, slices
from .repeats import Windows, base_table, candidate_windows, first_places, own_row, packed, repeated_by_document, segments, shards, unpack, with_row_ids

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1 << 20
_MODULUS, _COVER = 13, (0, 1, 3, 9)
_IN_COVER = np.isin(np.arange(_MODULUS), _COVER)
#: From each residue the steps, one at least, to the next cover position.
_STEP = np.array([next(d for d in range(1, _MODULUS + 1) if _IN_COVER[(r + d) % _MODULUS]) for r in range(_MODULUS)])
_BYTE_IDS = np.random.default_rng(100).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


def byte_units(text: bytes) -> tuple[np.ndarray, bytes]:
    return _BYTE_IDS[np.frombuffer(text, np.uint8)], text


def byte_windows(common: int = 2048, very_common: int = 65_536) -> Windows:
    return Windows(LENGTH, GRAM, True, 32, byte_units, lambda text, s, e: text[s:e], common, very_common)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, in their order: equal keys share a rank."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.zeros(len(order), np.uint64)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    ranks = np.empty(len(order), np.uint64)
    ranks[order] = np.cumsum(new)
    return ranks


def _pair(high: np.ndarray, low: np.ndarray, bits: int = 32) -> np.ndarray:
    return high << np.uint64(bits) | low


def sorted_windows(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the places in the order of (leading byte, residue modulo 13, window of 100 bytes); new: does a window differ from the one before?

    Windows of different residues are not compared: equal ones must start at equal residues. Blocks hold fewer than 2**31 bytes.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(2 * LENGTH, np.uint8))).astype(np.uint64)
    eight = np.zeros(n + LENGTH, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | padded[i : i + n + LENGTH]
    sample = np.flatnonzero(_IN_COVER[np.arange(n + 8) % _MODULUS])
    index = np.full(n + 2 * LENGTH, len(sample), np.int64)
    index[sample] = np.arange(len(sample))

    def after(ranks: np.ndarray, shift: int) -> np.ndarray:  # 0 beyond the end
        return np.append(ranks + np.uint64(1), np.uint64(0))[index[sample + shift]]

    rank13 = _ranks(_pair(_ranks(eight[sample]), eight[sample + 8] >> np.uint64(24), 40)) if n < 1 << 24 else _ranks(_pair(_ranks(eight[sample]), _ranks(eight[sample + 8] >> np.uint64(24))))
    rank26 = _ranks(_pair(rank13, after(rank13, 13)))
    rank52 = _ranks(_pair(rank26, after(rank26, 26)))
    rank78 = _ranks(_pair(rank52, after(rank26, 52)))
    rank91 = _ranks(_pair(rank78, after(rank13, 78)))
    orders, news = [], []
    leading = text[places]
    by_byte = np.argsort(leading, kind="stable")
    ends = np.cumsum(np.bincount(leading, minlength=256))
    for byte in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        bucket = by_byte[ends[byte - 1] if byte else 0 : ends[byte]]
        p = places[bucket]
        residue = p % _MODULUS
        step = _STEP[residue]
        first = eight[p] >> (np.uint64(64) - np.uint64(8) * step.astype(np.uint64))  # the bytes before the next cover position, six at most
        head = _ranks(first | residue.astype(np.uint64) << np.uint64(48))
        middle = _ranks(_pair(head, rank91[index[p + step]]))
        key = _pair(middle, _ranks(eight[p + LENGTH - 8]))
        order = np.argsort(key)
        orders.append(bucket[order])
        news.append(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    return np.concatenate(orders), np.concatenate(news)


def decide(block) -> tuple[np.ndarray, ...]:
    """doc_id, own, from, to: the windows of a block's segments that stand nowhere earlier."""
    off, doc_ids, owns, starts = (block[c].to_numpy() for c in ("off", "doc_id", "own", "start"))
    segs = block["seg"].combine_chunks()
    bounds = np.frombuffer(segs.buffers()[1], np.int32)[segs.offset : segs.offset + len(segs) + 1].astype(np.int64)
    sizes = np.diff(bounds)
    # anchors at multiples of 13
    room = sizes + 2 * _MODULUS
    begin = np.cumsum(room) - room
    begin += -(begin + off) % _MODULUS
    text = np.zeros(int(room.sum()), np.uint8)
    text[np.repeat(begin - bounds[:-1], sizes) + np.arange(bounds[0], bounds[-1])] = np.frombuffer(segs.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    count = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(segs)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, new = sorted_windows(text, begin[which] + offset)
    # the earliest of each group of equal windows: places as one number in the order of (document, row, start)
    by_row = np.lexsort((owns, doc_ids))
    row = np.empty(len(segs), np.int64)
    row[by_row] = np.cumsum(np.concatenate(([0], (np.diff(doc_ids[by_row]) != 0) | (np.diff(owns[by_row]) != 0))))
    place = (row[which] << 36) + starts[which] + offset
    ordered = place[order]
    heads = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ordered, heads), np.diff(np.append(heads, len(order))))
    kept = np.zeros(len(which), bool)
    kept[order[ordered == least]] = True
    edge = np.concatenate(([True], which[1:] != which[:-1]))
    began = kept & (edge | ~np.concatenate(([False], kept[:-1])))
    ended = kept & (np.concatenate((edge[1:], [True])) | ~np.concatenate((kept[1:], [False])))
    first, at = which[began], starts[which] + offset
    return doc_ids[first], owns[first], at[began], at[ended] + 1


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> tuple[DataFrame, DataFrame]:
    """(base, removed). base: (doc_id, rid, n, sha) of every row; removed, for rows that lose bytes: (doc_id, rid, n_removed, n_spans, kept_sha256, kept).

    rid is the hash of the text. Null, empty and short texts lose nothing, nor do rows with a null id, which are not
    compared. Rows of one id come one after the other, by rid; equal rows count as one. Other columns are not looked at.
    `kept` is binary: a cut can part a character. bounds: see byte_windows.
    """
    import pyarrow as pa

    w = byte_windows(**bounds)
    texts = with_row_ids(docs, id_col, text_col)
    base = base_table(texts, w)
    repeated = repeated_by_document(base, w)
    moved = packed(texts)
    firsts = first_places(shards(segments(moved, repeated, w)), decide, BLOCK_BYTES)

    def rows(batches):
        for b in slices(batches):
            out = [[], [], [], [], [], []]
            for doc_id, rid, text, reps, ranks, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = unpack(text)
                ids, _ = byte_units(text)
                late = candidate_windows(ids, reps, ranks, w)
                for s, e in zip(begin or [], end or [], strict=True):
                    late[s:e] = False
                if late.any():
                    gone = covered(np.flatnonzero(late), LENGTH, len(text))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    for x, v in zip(out, (doc_id, rid, int(gone.sum()), sum(1 for _ in runs(gone)), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "rid", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = moved.join(repeated, "doc_id").withColumn("own", own_row()).join(firsts, ["doc_id", "own"], "left").select("doc_id", "rid", "text", "reps", "ranks", "s", "e")
    removed = joined.mapInArrow(rows, "doc_id bigint, rid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return base.select("doc_id", "rid", "n", "sha"), removed


def query(spark, sf_dir: str) -> DataFrame:
    base, removed = removals(read_table(spark, sf_dir, "documents"))
    removed = removed.select("doc_id", "rid", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["doc_id", "rid"])
    zero = F.lit(0).cast("bigint")
    return base.join(removed, ["doc_id", "rid"], "left").select("doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: DuckDB over the same tables; bytes as pairs of hexadecimal digits.
ORACLE_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select doc_id, p, substring(h, 2 * p - 1, 200) as s from (select doc_id, h, unnest(generate_series(1, n - 99)) as p from d where n >= 100)),
late as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from win) where k > 1),
edge as (select doc_id, p, p - lag(p, 1, -1000) over (partition by doc_id order by p) > 100 as new from late),
part as (select doc_id, p, sum(new::int) over (partition by doc_id order by p) as k from edge),
span as (select doc_id, k, min(p) as s, max(p) + 100 as e from part group by 1, 2),
piece as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 1) as f from span),
cut as (select piece.doc_id, sum(e - s) as n_removed, count(*) as n_spans,
        concat(string_agg(substring(h, 2 * f - 1, 2 * (s - f)), '' order by s), substring(any_value(h), 2 * max(e) - 1)) as kept
        from piece join d using (doc_id) group by 1)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut using (doc_id)
"""
