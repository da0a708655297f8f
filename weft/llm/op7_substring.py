"""Exact removal of word passages that an earlier document holds, by suffix automata.

The corpus is its own reference. `repeats` narrows it to passages that can repeat, routed so that equal passages of
`length` words meet. Sorted by route they form reference shards of bounded size; a suffix automaton is built over each
shard's words, its states know the smallest document in which their strings stand, and the shard's passages are streamed
through it for matching statistics: at each word the longest match, cut to `length` words, gives the first document of that
window. A word goes if a window over it has its first document before its own. Shards travel by shuffle to the task that
builds their automaton, not by broadcast, for the reference grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import covered, gram_hashes, read_table, runs, slices, WordHashes, write_shared
from .repeats import Windows, base_table, candidate_windows, first_places, own_row, packed, repeated_by_document, row_id, segments, shards, unpack, with_row_ids

LENGTH = 50
SHARD_BYTES = 150_000  # of text under one automaton, about
_hashes = WordHashes()
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def word_units(text: bytes) -> tuple[np.ndarray, list]:
    words = text.split()
    return _hashes.of(words), words


def passage_windows(length: int = LENGTH, common: int = 64, very_common: int = 2048) -> Windows:
    return Windows(length, max(1, length // 2), False, max(1, min(8, length // 4)), word_units, lambda words, s, e: b" ".join(words[s:e]), common, very_common)


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added, with the smallest label of the sequences that hold each."""

    def __init__(self):
        self.next, self.link, self.size, self.label = [{}], [-1], [0], [None]

    def add(self, tokens: list, label: int) -> None:
        follow, link, size, labels = self.next, self.link, self.size, self.label
        last = 0
        for t in tokens:
            q = follow[last].get(t)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, q, t)
            else:
                new = len(size)
                follow.append({})
                size.append(size[last] + 1)
                labels.append(None)
                p = last
                while p >= 0 and t not in follow[p]:
                    follow[p][t] = new
                    p = link[p]
                up = 0
                if p >= 0:
                    q = follow[p][t]
                    up = q if size[q] == size[p] + 1 else None
                link.append(0 if up is None else up)
                if up is None:
                    link[new] = self._split(p, q, t)
                last = new
            if labels[last] is None or label < labels[last]:
                labels[last] = label

    def _split(self, p: int, q: int, t) -> int:
        clone = len(self.size)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.label.append(None)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def finish(self) -> SuffixAutomaton:
        """Hand the labels down the suffix links. To be called once all sequences are added."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and (self.label[up] is None or self.label[s] < self.label[up]):
                self.label[up] = self.label[s]
        return self

    def first_labels(self, tokens: list, length: int) -> Iterator[tuple[int, int]]:
        """(start, smallest label) of every window of `length` tokens that the automaton holds, from the matching statistics."""
        follow, link, size = self.next, self.link, self.size
        s = matched = 0
        for i, t in enumerate(tokens):
            while s and t not in follow[s]:
                s = link[s]
                matched = size[s]
            if t in follow[s]:
                s = follow[s][t]
                matched += 1
            while s and size[link[s]] >= length:  # the state of the last `length` tokens
                s = link[s]
                matched = size[s]
            if matched >= length:
                yield i - length + 1, self.label[s]


def decide(shard, length: int) -> tuple[list, list, list, list]:
    """doc_id, own, from, to: the windows of a shard's passages of which their document is the first."""
    words = [seg.split() for seg in shard["seg"].to_pylist()]
    doc_ids, owns, starts = (shard[c].to_pylist() for c in ("doc_id", "own", "start"))
    automaton = SuffixAutomaton()
    for tokens, doc_id in zip(words, doc_ids, strict=True):
        automaton.add(tokens, doc_id)
    automaton.finish()
    out = ([], [], [], [])
    for tokens, doc_id, own, start in zip(words, doc_ids, owns, starts, strict=True):
        begin = None
        for i, label in automaton.first_labels(tokens, length):
            if (label == doc_id) == (begin is None):  # a range begins or ends
                if begin is None:
                    begin = i
                else:
                    for x, v in zip(out, (doc_id, own, start + begin, start + i), strict=True):
                        x.append(v)
                    begin = None
        if begin is not None:
            for x, v in zip(out, (doc_id, own, start + begin, start + len(tokens) - length + 1), strict=True):
                x.append(v)
    return out


def same_windows(words: list, ids: np.ndarray, late: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """Those of the places `late` whose window equals, word by word, the window at one of the places `known`."""
    hashes = gram_hashes(ids, length)
    order = known[np.argsort(hashes[known], kind="stable")]
    low, high = (np.searchsorted(hashes[order], hashes[late], side) for side in ("left", "right"))
    hit = np.flatnonzero(high > low)
    equal = [any(words[i : i + length] == words[j : j + length] for j in order[a:b].tolist()) for i, a, b in zip(late[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True)]
    return late[hit[np.array(equal, bool)]]


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, each with the white space up to the next word."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    pieces, at = [], 0
    for s, e in runs(gone):
        pieces.append(text[at : starts[s]])
        at = int(starts[e]) if e < len(starts) else len(text)
    pieces.append(text[at:])
    return b"".join(pieces)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **bounds) -> tuple[DataFrame, DataFrame]:
    """(base, removed). base: (doc_id, rid, n, sha) of every row; removed, for rows that lose words: (doc_id, rid, n_removed, kept_sha256, kept_text).

    rid is row_id() of the text. Null, empty and short texts lose nothing, nor do rows with a null id, which are not
    compared. Rows repeated under one id are one document: none is before the other; each has its own row in the results,
    once for equal texts. Other columns are not looked at. bounds: see passage_windows.
    """
    import pyarrow as pa

    w = passage_windows(length, **bounds)
    texts = with_row_ids(docs, id_col, text_col)
    base = base_table(texts, w)
    repeated = repeated_by_document(base, w)
    moved = packed(texts)
    passages = shards(segments(moved, repeated, w))
    firsts = first_places(passages, lambda shard: decide(shard, length), SHARD_BYTES)

    def rows(batches):
        for b in slices(batches):
            out = [[], [], [], [], []]
            for doc_id, rid, text, reps, ranks, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = unpack(text)
                ids, words = word_units(text)
                late = candidate_windows(ids, reps, ranks, w)
                if begin:
                    own = np.zeros(len(ids) + 1, bool)
                    for s, e in zip(begin, end, strict=True):
                        own[s:e] = True
                    late &= ~own
                    late[same_windows(words, ids, np.flatnonzero(late), np.flatnonzero(own), length)] = False
                if late.any():
                    gone = covered(np.flatnonzero(late), length, len(ids))
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                    for x, v in zip(out, (doc_id, rid, int(gone.sum()), hashlib.sha256(kept).hexdigest(), cut(text, gone)), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "rid", "n_removed", "kept_sha256", "kept_text"])

    joined = moved.join(repeated, "doc_id").withColumn("own", own_row()).join(firsts, ["doc_id", "own"], "left").select("doc_id", "rid", "text", "reps", "ranks", "s", "e")
    removed = joined.mapInArrow(rows, "doc_id bigint, rid bigint, n_removed bigint, kept_sha256 string, kept_text binary")
    return base.select("doc_id", "rid", "n", "sha"), removed


def remove_repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages cut from `text`; documents of which nothing is left go. Other rows are unchanged, in all columns.

    A row is told by its id and its text, so rows repeated under one id each keep their own text.
    """
    _, removed = removals(docs, length=length)
    cuts = write_shared(removed.select("doc_id", "rid", F.col("kept_text").cast("string").alias("kept_text")).dropDuplicates(["doc_id", "rid"]), "cuts")
    d, c = docs.alias("d"), cuts.alias("c")
    out = d.join(c, (F.col("d.doc_id") == F.col("c.doc_id")) & (row_id(F.col("d.text")) == F.col("c.rid")), "left")
    out = out.where("c.kept_text is null or c.kept_text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    lost, text = F.col("c.kept_text").isNotNull(), F.coalesce("c.kept_text", "d.text")
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.char_length("c.kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars")).alias("n_chars")
    return out.select(*(new.get(x, F.col(f"d.`{x}`")) for x in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    base, removed = removals(read_table(spark, sf_dir, "documents"))
    removed = removed.select("doc_id", "rid", "n_removed", "kept_sha256").dropDuplicates(["doc_id", "rid"])
    return base.join(removed, ["doc_id", "rid"], "left").select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


#: DuckDB over the same tables.
ORACLE_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, p, list_aggregate(w[p:p+49], 'string_agg', ' ') as s
        from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as p from w where len(w) >= 50)),
late as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by s) as lo from win) where lo < doc_id),
gone as (select distinct doc_id, unnest(generate_series(p, p + 49)) as i from late),
words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from w where len(w) > 0),
kept as (select words.doc_id, count(gone.i) as n_removed, coalesce(string_agg(word, ' ' order by words.i) filter (where gone.i is null), '') as t
         from words left join gone using (doc_id, i) group by 1)
select w.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""
