"""Phrases of a table found in texts, with their places; and texts rewritten at these places in one pass.

A text is cut into pieces whose concatenation it is: words (letters, digits and _), runs of white space, and single other
characters. A phrase is found where consecutive pieces equal its own, ignoring case and the length of white space; so a
mention starts and ends with a whole word, whatever stands beside it. Of overlapping mentions the leftmost stands, of those of one
start the longest. What is put in is never searched.

A text and the phrases that it may hold are dealt to one task, the phrases first, so that no piece of a text is shuffled by
itself. Where phrases belong to a document, texts come by document. Phrases for all texts go along with the task while they
are few; beyond, texts are dealt into shards, and a shard gets the phrases of which the first pieces stand in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..session import cut_lineage

#: Java's (?U)[\p{L}\p{N}_]+|\s+|. (Python counts four control characters as white space too)
_PIECE = re.compile(r"\w+|[^\S\x1c-\x1f]+|[\s\S]")
_SPACE = re.compile(r"[^\S \x1c-\x1f]|  ")  # other than a single blank
#: Pieces by which phrases come to a shard.
_LEAD = 7


def _cut(text: str) -> tuple[list[str], list[str]]:
    """A text's pieces, and these as they are compared: in lower case, white space as one blank."""
    pieces = _PIECE.findall(text)
    keys = list(map(str.lower, pieces))
    if _SPACE.search(text):
        keys = [" " if _SPACE.search(x) else key for x, key in zip(pieces, keys)]
    return pieces, keys


def _key(df: DataFrame, by: tuple[str, ...]) -> Column:
    """One column of the columns `by`, in which nulls equal each other; a constant where there are none."""
    return F.struct(*(F.col(c) for c in by)) if by else F.lit(0)


class _Phrases:
    """Phrases to look for. Of those that are equal but for case and white space the first by code points stands, with its least value."""

    def __init__(self, rows: Iterable[tuple[str, str | None]] = ()):
        self.own: dict[str, tuple] = {}
        self.lengths: dict[str, list[int]] = {}  # of the phrases of one first piece, longest first
        for row in rows:
            self.add(*row)

    def add(self, phrase: str, value: str | None) -> None:
        keys = _cut(phrase)[1]
        key, n, rank = "".join(keys), len(keys), (phrase, value is not None, value or "")
        if key not in self.own or rank < self.own[key][0]:
            self.own[key] = rank, n, value or ""
        if n not in (have := self.lengths.setdefault(keys[0], [])):
            have.append(n)
            have.sort(reverse=True)

    def rewritten(self, text: str | None, keep: bool) -> str | None:
        """The text with each mention's value in its place, or behind it."""
        if not text or not self.own:
            return text
        (pieces, keys), out, end = _cut(text), [], 0
        for at, head in enumerate(keys):
            if at < end:
                continue
            for n in self.lengths.get(head, ()):
                if at + n <= len(keys) and (hit := self.own.get("".join(keys[at : at + n]) if n > 1 else head)) and hit[1] == n:
                    out += pieces[at : at + n] if keep else []
                    out.append(hit[2])
                    end = at + n
                    break
            else:
                out.append(pieces[at])
        return "".join(out)


def _rewritten(rows: DataFrame, keep: bool, given: list[tuple] | None = None) -> DataFrame:
    """(row, words) of the texts among rows(by, text, words, value, row): the text in which its phrases are replaced.

    Rows of one `by` come after each other, its phrases (not `text`) first; given: the phrases of all texts instead.
    """
    import pyarrow as pa

    def rewritten(batches):
        at, own = None, _Phrases(given or ())
        for b in batches:
            new, by = [], b.column(0)
            keys = zip(*(c.to_pylist() for c in (by.flatten() if pa.types.is_struct(by.type) else [by])))
            for key, is_text, words, value in zip(keys, *(b.column(k).to_pylist() for k in range(1, 4))):
                if given is None and at != key:
                    at, own = key, _Phrases()
                if is_text:
                    new.append(own.rewritten(words, keep))
                else:
                    own.add(words, value)
            yield pa.RecordBatch.from_arrays([b.column(4).filter(b.column(1)), pa.array(new, pa.string())], ["row", "words"])

    return rows.mapInArrow(rewritten, S.StructType([rows.schema["row"], S.StructField("words", S.StringType())]))


def _leads(table: DataFrame) -> DataFrame:
    """What texts are compared with, of table(phrase, value): (key, n, first, lead, shape, value), once for phrases that are equal but for case and white space (as _Phrases chooses): the pieces as they
    are compared, how many, hashes of the first and of the first few, and the shape of these."""
    import numpy as np
    import pyarrow as pa

    from . import shards

    def leads(batches):
        for b in batches:
            keys = [_cut(x)[1] for x in b.column(0).to_pylist()]
            kind = lambda x: shards.SPACE if x == " " else shards.WORD if x[0].isalnum() or x[0] == "_" else shards.OTHER
            first, lead = (pa.array(shards.hashes(pa.array(["".join(x[:n]) for x in keys], pa.string()))) for n in (1, _LEAD))
            n, shape = (pa.array(np.array(x, np.int64)) for x in (list(map(len, keys)), [shards.shape_code(map(kind, x[:_LEAD])) for x in keys]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(["".join(x) for x in keys], pa.string()), n, first, lead, shape], ["phrase", "value", "key", "n", "first", "lead", "shape"])

    led = table.mapInArrow(leads, "phrase string, value string, key string, n long, first long, lead long, shape long")
    least = F.min(F.struct("phrase", F.col("value").isNotNull().alias("some"), "value", "n", "first", "lead", "shape")).alias("x")
    return led.groupBy("key").agg(least).select("key", "x.n", "x.first", "x.lead", "x.shape", F.coalesce("x.value", F.lit("")).alias("value"))


def _standing(texts: DataFrame, led: DataFrame) -> DataFrame:
    """(by, lead): hashes of what stands in the texts(by, words) of a shard and may be first pieces of a phrase, seldom more than once. A filter of a bit for each hash, 16 MB, goes along."""
    import numpy as np
    import pyarrow as pa

    from . import shards

    shapes = {r[0] for r in led.select("shape").distinct().collect()}  # of three kinds: a few thousand at most
    place = F.shiftrightunsigned("lead", 64 - shards._BITS)
    bits = led.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(lead, {64 - shards._BITS}) & 63 as int))")).alias("bits")).toArrow()
    given = texts.sparkSession.sparkContext.broadcast((shapes, *(np.asarray(bits.column(k)) for k in ("word", "bits"))))

    def standing(batches):
        held, at, known = [], None, shards.Filter(*given.value)

        def out():
            own = shards.distinct(np.concatenate(held)) if held else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), at if at is not None else 0)), pa.array(own)], ["by", "lead"])

        for b in batches:
            by = b.column(0).to_numpy()
            ends = np.append(np.flatnonzero(by[1:] != by[:-1]) + 1, len(by))
            for a, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                if by[a] != at or sum(map(len, held)) > 3_000_000:
                    yield out()
                    at = by[a]
                texts = b.column(1).slice(a, e - a)
                held += [known.standing(texts.slice(s.start, s.stop - s.start), _LEAD) for s in shards.pieces_of(texts)]
        yield out()

    return texts.mapInArrow(standing, "by long, lead long")


def _rewritten_shards(rows: DataFrame, keep: bool) -> DataFrame:
    """_rewritten() of rows(by, text, words, value, row, n, first), each shard's phrases as _leads() has them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from . import shards

    def rewritten(batches):
        at, held, table = None, [], None
        for b in batches:
            by, is_text = b.column(0).to_numpy(), np.asarray(b.column(1))
            ends = np.append(np.flatnonzero((by[1:] != by[:-1]) | (is_text[1:] != is_text[:-1])) + 1, len(by))
            for a, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                if by[a] != at:
                    at, held, table = by[a], [], None
                own = b.slice(a, e - a)
                if not is_text[a]:
                    held.append(own.select(["words", "n", "first", "value"]))
                    continue
                if held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    table, held = shards.Table(t.column(0).combine_chunks(), *(t.column(k).to_numpy() for k in (1, 2)), t.column(3).combine_chunks()), []
                words = own.column(2)
                if table:
                    texts = pc.fill_null(words, "")
                    new = pa.concat_arrays([table.rewritten(texts.slice(s.start, s.stop - s.start), keep) for s in shards.pieces_of(texts)])
                    words = pc.if_else(words.is_valid(), new, None)
                yield pa.RecordBatch.from_arrays([own.column(4), words], ["row", "words"])

    return rows.mapInArrow(rewritten, S.StructType([rows.schema["row"], S.StructField("words", S.StringType())]))


def rewrite_phrases(texts: DataFrame, phrases: DataFrame, phrase: str, value: str, by: tuple[str, ...] = (), column: str = "text", keep: bool = False, few: int = 1_000_000, many: int = 10_000_000) -> DataFrame:
    """texts with each mention of a phrase replaced by its value, or with `keep` followed by it.

    A text is searched for the phrases of equal `by` only. Rows come back as often as they came, null texts as null; other
    columns are kept, whatever their names. Null and blank phrases are none; without phrases nothing changes. A null value is
    an empty one. few: characters of phrases without `by` up to which they go along with each task; many: texts beyond which a
    shard has four times as many.
    """
    blank = r"(?U)^\s+|\s+$"
    table = phrases.select(_key(phrases, by).alias("by"), F.regexp_replace(phrase, blank, "").alias("phrase"), F.col(value).alias("value")).where("phrase <> ''")
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(texts.columns) if c != column]
    own = texts.select(_key(texts, by).alias("by"), F.col(column).alias("words"), F.struct(F.lit(0).alias("any"), *others).alias("row"))
    given = None
    if not by:
        table = cut_lineage(table.select("phrase", "value").distinct(), "phrases")
        size = table.agg(F.sum(F.length("phrase") + F.coalesce(F.length("value"), F.lit(0)) + 50)).first()[0] or 0
        if size <= few:
            given = [tuple(r) for r in table.collect()]
        else:
            led = cut_lineage(_leads(table), "leads", replaces=table)
            shard = F.shiftright(F.monotonically_increasing_id(), 16)  # 65,536 rows of a partition
            own = cut_lineage(own.withColumn("by", shard), "texts")
            if own.count() > many:  # larger shards share more of their phrases
                own = own.withColumn("by", F.shiftright("by", 2))
            table = _standing(own.select("by", "words").where("words is not null"), led).join(led, "lead")
    own = own.select("by", F.lit(True).alias("text"), "words", F.lit(None).cast("string").alias("value"), "row")
    none = F.lit(None).cast(own.schema["row"].dataType).alias("row")
    dealt = lambda phrases, texts: phrases.union(texts).repartition("by").sortWithinPartitions("by", "text")
    if by:
        done = _rewritten(dealt(table.select("by", F.lit(False).alias("text"), "phrase", "value", none), own), keep)
    elif given is not None:
        done = _rewritten(own, keep, given)
    else:
        number = F.lit(None).cast("long")
        done = _rewritten_shards(dealt(table.select("by", F.lit(False).alias("text"), "key", "value", none, "n", "first"), own.select("*", number.alias("n"), number.alias("first"))).select("by", "text", F.col("key").alias("words"), "value", "row", "n", "first"), keep)
    return done.select(*((F.col("words") if c == column else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(texts.columns)))
