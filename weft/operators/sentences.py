"""Sentences and clauses: split, refine, select. Order is always a column.

Null and blank texts give no rows where texts are cut, and stay as they are where they are judged. Repeated rows come back
as often as they came. Columns that a function adds replace those of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import lexicon as lex
from ..functions import text as T

SENTENCE_END = r"(?<!\b[A-Z])[.!?](?=\s|$)"


def split_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, s): the terminator goes, single capitals with a period are no end, empty sentences go."""
    return docs.select("doc_id", F.posexplode(sentence_parts(F.col("text"))).alias("pos", "s"))


def sentence_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.clean_whitespace(c), SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")


def number_sentences(sents: DataFrame) -> DataFrame:
    return sents.withColumn("sid", F.concat(F.lit("s"), F.col("pos") + 1))


def number_splits(splits: DataFrame) -> DataFrame:
    """Ids s1.1, s1.2 ... from pos and part."""
    return splits.withColumn("sid", F.concat(F.lit("s"), F.col("pos") + 1, F.lit("."), F.col("part") + 1))


def punct_parts(c: Column) -> Column:
    """Cut at ; and : before a letter, digit, < or (; a separator with nothing before it stays with what follows."""

    def joined(parts: Column) -> Column:
        first = F.concat(F.get(parts, F.lit(0)), F.substr(c, F.length(F.get(parts, F.lit(0))) + 1, F.lit(1)), F.get(parts, F.lit(1)))
        rest = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
        return F.when((F.size(parts) > 1) & (F.trim(F.get(parts, F.lit(0))) == ""), F.concat(F.array(first), rest)).otherwise(parts)

    return T.let(F.split(c, r"[;:](?=\s*[A-Za-z0-9<(])"), joined)


def marker_parts(c: Column) -> Column:
    """Cut before the clause markers; white space is joined by single spaces only if there is one."""
    is_marker = lambda w: F.lower(w).isin(*lex.CLAUSE_MARKERS)

    def cut(tokens: Column) -> Column:
        joined = F.array_join(F.transform(tokens, lambda w, i: F.when(is_marker(w) & (i > 0), F.concat(F.lit("\u0001"), w)).otherwise(w)), " ")
        return F.when(F.exists(tokens, is_marker), F.split(F.replace(joined, F.lit(" \u0001"), F.lit("\u0001")), "\u0001")).otherwise(F.array(c))

    return T.let(T.words(c), cut)


def clause_parts(c: Column) -> Column:
    """Punctuation, then markers; stripped, empties dropped."""
    pieces = F.flatten(F.transform(punct_parts(c), marker_parts))
    return F.filter(F.transform(pieces, T.strip), lambda x: x != "")


def split_clauses(df: DataFrame, column: str = "text", parts=clause_parts, tokens: DataFrame | str | None = None) -> DataFrame:
    """The rows of df, one for each clause (part, clause).

    tokens(doc_id, sent, tok, head, text, dep): the tokens of each row's text, df's (doc_id, pos) being their (doc_id, sent); or the
    name of df's column that has them in order, as structs of the other four, which needs no shuffle and goes. With
    them the clauses of punctuation and markers (parts is not looked at) are also cut before each token of dep conj that hangs
    on its clause's root, the first of its tokens of which the head is itself or outside the clause. Tokens are laid over the
    clauses by counting characters other than white space, in batches; time goes with characters and tokens. Sentences without
    tokens, and clauses in which none starts, stay.
    """
    if tokens is None:
        return _exploded(df, parts(F.col(column)), "part", "clause")
    if isinstance(tokens, str):
        both = df.withColumnRenamed(tokens, "_tokens")
    else:
        rows = tokens.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("tok", "head", "text", "dep"))).alias("_tokens"))
        key = [F.col("_doc").eqNullSafe(F.col("doc_id")) & F.col("_sent").eqNullSafe(F.col("pos"))]
        both = df.join(rows.withColumnsRenamed({"doc_id": "_doc", "sent": "_sent"}), key, "left").drop("_doc", "_sent")
    kept = [c for c in both.columns if c not in ("part", "clause", "_tokens")]
    pieces = F.transform(punct_parts(F.col(column)), lambda x: F.struct(F.length(F.regexp_replace(x, r"(?U)\s+", "")).alias("n"), marker_parts(x).alias("own")))
    laid = both.select(*kept, pieces.alias("_pieces"), F.col("_tokens").getField("tok").alias("_tok"), F.col("_tokens").getField("head").alias("_head"), F.col("_tokens").getField("text").alias("_text"), F.col("_tokens").getField("dep").alias("_dep"))
    schema = S.StructType([*(laid.schema[c] for c in kept), S.StructField("_clauses", S.ArrayType(S.StringType()))])
    return _exploded(laid.mapInArrow(_lay, schema), F.col("_clauses"), "part", "clause").drop("_clauses")


#: The characters that (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and the end of all."""
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow array of strings, and where each begins in them, with the end of all."""
    texts = texts.cast("string")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _solid(data: np.ndarray) -> np.ndarray:
    """In UTF-8 bytes, is this the first one of a character that is no white space?"""
    solid = ((data & 0xC0) != 0x80) & (data != 32) & ((data < 9) | (data > 13))
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(at):
        wide = np.concatenate((data, np.zeros(2, np.uint8))).astype(np.int32)
        code = np.where(data[at] == 0xC2, wide[at] << 8 | wide[at + 1], wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2])
        solid[at[np.isin(code, [int.from_bytes(x.encode(), "big") for x in WHITE if x > "\x7f"])]] = False
    return solid


def _lay(batches):
    """Batches of (..., _pieces, _tok, _head, _text, _dep), a row for each text -> (..., _clauses)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def numbers(lists) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten()
        return pc.fill_null(flat.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), np.asarray(flat.is_null())

    for b in batches:
        *kept, pieces, toks, heads, texts, deps = b.columns
        in_row = sizes(pieces)
        n, own = pieces.flatten().flatten()
        in_piece = sizes(own)
        row = np.repeat(np.arange(len(in_row)), in_row)  # of each piece
        piece = np.repeat(np.arange(len(row)), in_piece)  # of each clause
        clauses = pc.utf8_trim(own.flatten(), WHITE)
        data, begin = text_bytes(clauses)
        solid = _solid(data)
        count = _starts(solid)
        # the range of characters of its text that each clause covers; separators count between pieces
        before, first = _starts(n.to_numpy(zero_copy_only=False)), _starts(in_row)
        piece_at = before[:-1] - before[first[row]] + np.arange(len(row)) - first[row]
        at = piece_at[piece] + count[begin[:-1]] - count[begin[_starts(in_piece)[piece]]]
        end = at + count[begin[1:]] - count[begin[:-1]]

        tok, no_tok = numbers(toks)
        head, no_head = numbers(heads)
        of_row = sizes(toks)
        conj = np.asarray(pc.fill_null(pc.equal(deps.flatten(), "conj"), False))
        letters, ends = text_bytes(texts.flatten())
        sums = _starts(_solid(letters))[ends]
        of = np.repeat(np.arange(len(of_row)), of_row)
        tok_at = sums[:-1] - sums[_starts(of_row)[of]]
        wide = int(max(end.max(initial=0), tok_at.max(initial=0))) + 1
        place = of * wide + tok_at
        lo, hi = (np.searchsorted(place, row[piece] * wide + x) for x in (at, end))
        mine = np.repeat(np.arange(len(lo)), hi - lo)  # of each token in a clause, that clause
        here = np.repeat(lo - _starts(hi - lo)[:-1], hi - lo) + np.arange(len(mine))
        least, most = tok[lo[mine]], tok[hi[mine] - 1]
        sure = ~no_head[here] & ~no_tok[lo[mine]]
        rooted = np.flatnonzero(sure & ((head[here] == tok[here]) | (head[here] < least) | (head[here] > most)))
        clause, one = np.unique(mine[rooted], return_index=True)
        has, root = np.zeros(len(lo), bool), np.zeros(len(lo), np.int64)
        has[clause], root[clause] = True, tok[here[rooted[one]]]
        cuts = np.flatnonzero(sure & conj[here] & has[mine] & (head[here] == root[mine]) & (tok[here] > least) & (tok_at[here] > at[mine]))
        cut, cut_clause = here[cuts], mine[cuts]
        # a part ends behind the last solid character before the cut: that many of all clauses' stand before
        nth = count[begin[cut_clause]] + tok_at[cut] - at[cut_clause]
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        last = np.flatnonzero(solid)[nth - 1]
        behind = chars[np.searchsorted(chars, last) + 1]
        bounds = np.sort(np.concatenate((begin, behind)), kind="stable")
        cut_parts = pc.utf8_trim(pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)), WHITE)
        of_part = np.repeat(row[piece], 1 + np.bincount(cut_clause, minlength=len(lo)))
        full = np.asarray(pc.not_equal(cut_parts, ""))
        out = pa.ListArray.from_arrays(pa.array(_starts(np.bincount(of_part[full], minlength=len(in_row))), pa.int32()), cut_parts.filter(pa.array(full)))
        yield pa.RecordBatch.from_arrays([*kept, out], [*b.schema.names[: len(kept)], "_clauses"])


def _exploded(df: DataFrame, parts: Column, place: str, item: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in (place, item)), F.posexplode(parts).alias(place, item))


def split_on_conj(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, part, clause): cut before each token with dep conj whose head is the root; no root: the whole segment."""
    key = ["doc_id", "sent"]
    roots = tokens.where("dep = 'ROOT'").groupBy(*key).agg(F.min("tok").alias("root"))
    order = Window.partitionBy(*key).orderBy("tok")
    cut = F.coalesce(((F.col("dep") == "conj") & (F.col("head") == F.col("root")) & (F.col("tok") > 0)).cast("int"), F.lit(0))
    marked = tokens.join(roots, key, "left").withColumn("part", F.sum(cut).over(order))
    return marked.groupBy(*key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok", "text"))), lambda x: x["text"]), " ").alias("clause"))


def finalize_short_docs(clauses: DataFrame, limit: int = 80) -> DataFrame:
    """A document of which all clauses have at most `limit` characters gets final periods; others are unchanged."""
    short = clauses.groupBy("doc_id").agg(F.min((F.length("clause") <= limit).cast("int")).alias("_short"))
    out = clauses.join(short, "doc_id").withColumn("clause", F.when(F.col("_short") == 1, T.ensure_final_period(F.col("clause"))).otherwise(F.col("clause")))
    return out.where("clause is not null").drop("_short")


def refine_splits(df: DataFrame, max_iters: int = 3, **limits) -> tuple[DataFrame, DataFrame]:
    """(accepted, dropped) of (doc_id, pos, text): pieces that fit are accepted, others split again.

    At the cap what is left is cut into sentences: those that fit are accepted (round max_iters + 1), the others dropped.
    path tells a piece's place; order by (pos, round, path). Nulls are neither.
    """
    fits = T.fits_constraints(F.col("text"), **limits)
    rows = df.select("doc_id", "pos", "text", F.array().cast("array<int>").alias("path"), F.lit(0).alias("round"), fits.alias("ok")).where("ok is not null")
    for k in range(1, max_iters + 2):  # one pass: what fits is handed on, each other piece is cut
        cut = F.when(F.col("ok"), F.array("text")).otherwise((clause_parts if k <= max_iters else sentence_parts)(F.col("text")))
        pieces = rows.select("doc_id", "pos", "path", "round", "ok", F.posexplode(cut).alias("part", "text"))
        path = F.when(F.col("ok"), F.col("path")).otherwise(F.concat("path", F.array("part")))
        round_ = F.when(F.col("ok"), F.col("round")).otherwise(F.lit(k))
        rows = pieces.select("doc_id", "pos", "text", path.alias("path"), round_.alias("round"), (F.col("ok") | fits).alias("ok"))
    return rows.where("ok").select("doc_id", "pos", "text", "path", "round"), rows.where(~F.col("ok")).select("doc_id", "pos", "text", "path")


def top_level_spans(spans: DataFrame) -> DataFrame:
    """Clause spans that lie in no other clause span of their sentence; spans of one extent don't hold each other.

    A sweep: in the order of (start, end descending) whatever may hold a span stands before it, so it is held if an end so far
    reaches its own. Spans with a null start or end hold none and are held by none.
    """
    sent, extent = ["doc_id", "sent"], ["doc_id", "sent", "start", "end"]
    cand = spans.where(F.arrays_overlap("labels", F.array(*map(F.lit, lex.CLAUSE_LABELS))))
    before = Window.partitionBy(*sent).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = cand.withColumn("_reach", F.max(F.when(F.col("start").isNotNull(), F.struct(F.lit(1), F.col("end").cast("bigint").alias("end")))).over(before))
    # equal extents stand together; the first of them hasn't met the others
    reach = reach.withColumn("_reach", F.min(F.coalesce("_reach", F.struct(F.lit(0), F.lit(0).cast("bigint").alias("end")))).over(Window.partitionBy(*extent)))
    held = (F.col("_reach.col1") == 1) & (F.col("_reach.end") >= F.col("end")) & F.col("start").isNotNull()
    return reach.where(~F.coalesce(held, F.lit(False))).select(*spans.columns)


def finite_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans of more than two tokens that hold a finite verb (a column `finite` of tokens).

    Going back through a sentence, each span is told the nearest finite verb from its start on: one sort, no pairs.
    """
    verbs = tokens.where("finite and pos_tag in ('VERB', 'AUX') and tok is not null")
    row = F.struct(*spans.columns)
    asked = spans.where("end - start > 2").select("doc_id", "sent", F.col("start").cast("bigint").alias("_at"), F.lit(None).cast("bigint").alias("_verb"), row.alias("_row"))
    given = verbs.select("doc_id", "sent", F.col("tok").cast("bigint"), F.col("tok").cast("bigint"), F.lit(None).cast(asked.schema["_row"].dataType))
    back = Window.partitionBy("doc_id", "sent").orderBy(F.col("_at").desc(), F.col("_verb").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return asked.union(given).withColumn("_verb", F.last("_verb", ignorenulls=True).over(back)).where("_row is not null and _verb < _row.end").select("_row.*")


def fallback_full_sentence(sentences: DataFrame, clauses: DataFrame) -> DataFrame:
    """Sentences (doc_id, sent, n_words) that stand for themselves: more than two words, and nothing came before in the text.

    A fallback is a result too, so a text has one at most: its first sentence of more than two words, if no clause stands before or in it.
    """
    first = clauses.groupBy("doc_id").agg(F.min("sent").alias("first_clause"))
    own = sentences.where("n_words > 2").groupBy("doc_id").agg(F.min("sent").alias("sent"))
    return own.join(first, "doc_id", "left").where("first_clause is null or sent < first_clause").select("doc_id", "sent")


def dedupe_ci(df: DataFrame, column: str = "text") -> DataFrame:
    """The first row of each text of a document, whatever the case, after the weak punctuation fix and stripped. Null and blank texts go."""
    fixed = df.withColumn(column, T.strip(T.fix_period_comma(F.col(column)))).where(F.col(column) != "")
    place = F.row_number().over(Window.partitionBy("doc_id", F.lower(column)).orderBy("pos"))
    return fixed.withColumn("_place", place).where("_place = 1").drop("_place")


def flatten_splits(items: DataFrame) -> DataFrame:
    """items(doc_id, id, original, splits array<struct<sid, simple>>) -> (doc_id, sid, text, parent)."""
    return items.select("doc_id", F.col("id").alias("parent"), F.inline("splits")).select("doc_id", "sid", F.col("simple").alias("text"), "parent")


def identity_splits(sents: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits, but a document without any has each sentence as its own single split."""
    none = number_sentences(sents).join(splits.select("doc_id").distinct(), "doc_id", "left_anti")
    own = none.select("doc_id", F.concat("sid", F.lit(".1")).alias("sid"), F.col("s").alias("text"), F.col("sid").alias("parent"))
    return splits.select("doc_id", "sid", "text", "parent").unionByName(own)


def isolate_enumerations(df: DataFrame, column: str = "text") -> DataFrame:
    """A row for each item (i), (ii), ... and for what stands before the first."""
    parts = F.filter(F.transform(F.split(F.col(column), r"(?=\((?:[ivx]+)\))"), T.strip), lambda x: x != "")
    return _exploded(df, parts, "part", "item")


def length_report(df: DataFrame, column: str = "text", n: int = 10) -> DataFrame:
    return df.select("*", F.length(column).alias("chars"), (F.length(column) < n).alias("short"))
