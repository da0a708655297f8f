"""Relations, noun chunks and triples of many sentences at once: what relations.py finds with one sentence's array, found in vectors.

Sentence rows come in Arrow batches. A token is its place among the batch's tokens, -1 none; what is found are places, and words are put
together last, for what stands in the result only. Results come in pieces of bounded size, however long subtrees are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import lexicon as lex
from ..functions import text as T
from .tokens import CHUNK_TAGS, KEY, NOMINAL, sentence_rows, trees_of

SUBJECTS = ("nsubj", "nsubjpass")
OBJECTS = ("dobj", "obj")
#: The kind of the rows that are noun chunks.
CHUNK = "chunk"
#: What normalize_np() may change beside what it trims, in Arrow's pattern language.
_ODD = r"(?i)said|  |[\t\n\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that are put together at a time.
_WORDS = 2_000_000


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and the end of all."""
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _steps(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, end to end."""
    off = _starts(sizes)
    return np.repeat(begins - off[:-1], sizes) + np.arange(off[-1])


def _pieces(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of at most so much together, or of one."""
    total, at = np.cumsum(weights), 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def _first_of(n: int, groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first value of each of n groups, else -1."""
    out = np.full(n, -1)
    out[groups[::-1]] = values[::-1]
    return out


def _joined(texts, places: np.ndarray, off: np.ndarray, sep: str = " "):
    """The texts at each run of places in one; nulls are left out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if texts.null_count:
        some = np.asarray(texts.is_valid())[places]
        places, off = places[some], _starts(some)[off]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), texts.take(pa.array(places))), sep)


class Sentences:
    """The tokens of an Arrow array of sentences with the labels of their trees. Masks and labels have a value for each token."""

    def __init__(self, t, most: int = _WORDS):
        import pyarrow.compute as pc

        start, columns, (self.lo, self.hi, self.first, self.size, verb, self.up, self.nth, self.kids, self.degree) = trees_of(t)
        self.tok, self.head, self.text, self.lemma, self.pos_tag, self.dep = columns[:6]
        self.n, self.most, self.small = (n := len(self.tok)), most, {}
        self.row = np.repeat(np.arange(len(t)), np.diff(start))
        self.kid = _starts(self.degree)
        self.number = pc.fill_null(self.tok, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parent = np.repeat(np.arange(n), self.degree)
        has_lemma = np.append(np.asarray(self.lemma.is_valid()), False)
        self.verb = np.where(has_lemma[verb], verb, -1)  # the subtree's first verb, if it has a lemma
        self.has_lemma = has_lemma[:-1]

    def among(self, column, *values: str) -> np.ndarray:
        import pyarrow as pa
        import pyarrow.compute as pc

        return np.asarray(pc.is_in(column, pa.array(values, column.type)))

    def lowered(self, column, words) -> np.ndarray:
        """Is it one of the words in lower case? Arrow's lower case, which changes single characters, finds what may be; all of it where words are ASCII."""
        import pyarrow as pa
        import pyarrow.compute as pc

        maybe = np.arange(len(column))
        if all(map(str.isascii, words)):
            if id(column) not in self.small:
                self.small[id(column)] = pc.utf8_lower(column)
            maybe = np.flatnonzero(self.among(self.small[id(column)], *words))
        coded = column.take(pa.array(maybe)).dictionary_encode()
        some = np.array([x is not None and x.lower() in words for x in coded.dictionary.to_pylist()] + [False])
        out = np.zeros(len(column), bool)
        out[maybe] = some[pc.fill_null(coded.indices, len(some) - 1).to_numpy(zero_copy_only=False)]
        return out

    def children(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, k): the children k of x[i] in the mask, in order."""
        k = self.kids[_steps(self.kid[x], self.degree[x])]
        some = mask[k]
        return np.repeat(np.arange(len(x)), self.degree[x])[some], k[some]

    def first_child(self, mask: np.ndarray, last: bool = False) -> np.ndarray:
        """Of each token the first child in the mask, or the last."""
        some = np.flatnonzero(mask[self.kids])
        some = some[::-1] if last else some
        return _first_of(self.n, self.parent[some], self.kids[some])

    def subtrees(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the subtrees' tokens, in order, end to end, and where each begins."""
        size = self.size[x]
        group = np.repeat(np.arange(len(x)) * self.n, size)
        places = group + self.nth[_steps(self.first[x], size)]
        places.sort()
        return places - group, _starts(size)

    def words(self, x: np.ndarray):
        """The subtrees' texts."""
        return _joined(self.text, *self.subtrees(x))

    def of(self, column, places: np.ndarray):
        """The column at the places, null at -1."""
        import pyarrow as pa

        return column.take(pa.array(places, mask=places < 0))

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of noun chunks, end to end, where each begins, with the end of all, and the chunks' heads: maximal runs of CHUNK_TAGS without a gap, up to their last noun."""
        own = np.flatnonzero(self.among(self.pos_tag, *CHUNK_TAGS) & np.asarray(self.tok.is_valid()))
        begins = np.ones(len(own), bool)
        begins[1:] = (self.row[own][1:] != self.row[own][:-1]) | (self.number[own][1:] != self.number[own][:-1] + 1)
        run = np.cumsum(begins) - 1
        noun = np.flatnonzero(self.among(self.pos_tag, *NOMINAL)[own])
        last = np.full(int(begins.sum()), -1)
        last[run[noun]] = noun
        some = last >= 0
        first = np.flatnonzero(begins)[some]
        size = last[some] - first + 1
        return own[_steps(first, size)], _starts(size), own[last[some]]

    def relations(self, part, marker, function, spatial, condition) -> Iterator[tuple]:
        """(relation, tokens, sources, targets) of five kinds; sources and targets of phrases are tokens whose subtrees they are, those of functions the verbs."""
        up, verb = self.up, self.among(self.pos_tag, "VERB")
        nominal = self.among(self.pos_tag, *NOMINAL)
        subject, pobj = self.first_child(self.among(self.dep, *SUBJECTS)), self.among(self.dep, "pobj")
        lemma = lambda words: self.lowered(self.lemma, words)

        x = np.flatnonzero(verb & lemma(part))
        whole = np.where(subject[x] >= 0, subject[x], np.where((up[x] >= 0) & nominal[up[x]], up[x], -1))
        x, whole = x[whole >= 0], whole[whole >= 0]
        i, parts = self.children(x, self.among(self.dep, *OBJECTS))
        j, prep = self.children(x, self.among(self.dep, "prep"))
        k, below = self.children(prep, pobj)
        i = np.concatenate((i, j[k]))
        yield "part-of", x[i], whole[i], np.concatenate((parts, below))

        x = np.flatnonzero(self.lowered(self.text, marker) & self.among(self.dep, "amod", "acl") & (up >= 0))
        yield "function-of", x, up[x], self.verb[x]

        x = np.flatnonzero(verb & lemma(function) & (subject >= 0))
        clause = self.first_child(self.among(self.dep, "xcomp", "ccomp") & verb)[x]
        to = self.lowered(self.text, {"to"}) & (self.verb >= 0)
        found = np.full(len(x), -1)
        for s in _pieces(self.size[x], self.most):
            places, off = self.subtrees(x[s])
            at = np.flatnonzero(to[places])
            found[s] = _first_of(len(off) - 1, np.searchsorted(off, at, side="right") - 1, places[at])
        yield "function-of", x, subject[x], np.where((clause >= 0) & self.has_lemma[clause], clause, np.where(found >= 0, self.verb[found], -1))

        x = np.flatnonzero(self.among(self.pos_tag, "ADP") & lemma(spatial) & (up >= 0))
        argument = self.first_child(self.among(self.dep, *OBJECTS, *SUBJECTS))[up[x]]
        anchor = np.where(nominal[up[x]], up[x], np.where(verb[up[x]], argument, -1))
        yield "spatial", x, anchor, self.first_child(pobj)[x]

        x = np.flatnonzero(lemma(condition) & self.among(self.dep, "mark") & (up >= 0))
        yield "condition", x, self.first_child(self.among(self.dep, "nsubj", *OBJECTS))[up[x]], up[x]

    def phrases(self, x: np.ndarray):
        """Negation (the last), lemma and particles of verbs."""
        import pyarrow as pa

        neg = self.first_child(self.among(self.dep, "neg"), last=True)[x]
        i, prt = self.children(x, self.among(self.dep, "prt"))
        some = np.flatnonzero(neg >= 0)
        owner = np.concatenate((some, np.arange(len(x)), i))
        places = np.concatenate((neg[some], x + self.n, prt))
        order = np.argsort(owner, kind="stable")
        return _joined(pa.concat_arrays([self.text, self.lemma]), places[order], np.searchsorted(owner[order], np.arange(len(x) + 1)))

    def triples(self) -> Iterator[tuple]:
        """(tokens, subjects, verbs, objects) in pieces; null for none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        x = np.flatnonzero(self.among(self.pos_tag, "VERB") & np.asarray(self.dep.is_valid()) & ~self.among(self.dep, "aux"))
        subject = self.first_child(self.among(self.dep, *SUBJECTS, "csubj"))[x]
        i, direct = self.children(x, self.among(self.dep, "dobj", "obj", "iobj"))
        j, prep = self.children(x, self.among(self.dep, "prep"))
        below = self.first_child(self.among(self.dep, "pobj"))[prep]
        j, prep, below = j[below >= 0], prep[below >= 0], below[below >= 0]
        k, late = self.children(x, self.among(self.dep, "advmod", "obl") & self.among(self.pos_tag, "NOUN", "PROPN", "ADV"))
        none = lambda like: np.full(len(like), -1)
        owner, own = np.concatenate((i, j, k)), np.concatenate((direct, below, late))
        before = np.concatenate((none(direct), prep, none(late)))
        behind = np.concatenate((np.zeros(len(i) + len(j), int), np.ones(len(k), int)))
        child = self.number[np.concatenate((direct, prep, late))]
        sub = np.concatenate((none(direct), self.number[below], none(late)))
        order = np.lexsort((sub, child, behind, owner))
        keys = np.stack((owner, behind, child, sub))[:, order]
        owner, own, before = owner[order], own[order], before[order]
        same = np.concatenate(([False], (keys[:, 1:] == keys[:, :-1]).all(axis=0))) if len(order) else np.zeros(0, bool)
        keep = (subject >= 0) | (np.bincount(owner, minlength=len(x)) > 0) | np.asarray(pc.fill_null(pc.equal(self.head, self.tok), False))[x]

        weight = np.where(subject >= 0, self.size[subject], 0) + np.bincount(owner, self.size[own], len(x)).astype(np.int64)
        for s in _pieces(weight, self.most):
            a, b = np.searchsorted(owner, (s.start, s.stop))
            objects = pc.binary_join_element_wise(self.of(self.text, before[a:b]), self.words(own[a:b]), " ", null_handling="skip")
            if same[a:b].any():  # tokens repeated under one tok: by their texts
                rank = np.empty(b - a, np.int64)
                rank[pc.sort_indices(objects).to_numpy()] = np.arange(b - a)
                objects = objects.take(pa.array(np.lexsort((rank, np.cumsum(~same[a:b])))))
            off = np.searchsorted(owner[a:b], np.arange(s.start, s.stop + 1))
            objects = pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), objects), "; ")
            objects = pc.if_else(pa.array(np.diff(off) > 0), objects, None)
            own_subject = subject[s]
            some = np.flatnonzero(own_subject >= 0)
            subjects = self.words(own_subject[some]).take(pa.array(np.searchsorted(some, np.arange(len(own_subject))), mask=own_subject < 0))
            kept = pa.array(keep[s])
            yield x[s][keep[s]], subjects.filter(kept), self.phrases(x[s]).filter(kept), objects.filter(kept)


def svo_triples(tokens: DataFrame, most: int = _WORDS) -> DataFrame:
    """(doc_id, sent, tok, subject, verb, object) for each verb that is no auxiliary and has a subject or object or is the root; `_` fills a blank. Tokens, or sentence rows, parsed or not."""
    import pyarrow as pa

    rows = sentence_rows(tokens)
    fields = rows.schema
    schema = S.StructType([fields["doc_id"], fields["sent"], S.StructField("tok", fields["t"].dataType.elementType["tok"].dataType), *(S.StructField(x, S.StringType()) for x in ("subject", "verb", "object"))])

    def found(batches):
        import pyarrow.compute as pc

        for b in batches:
            s = Sentences(b.column(2), most)
            for x, subjects, verbs, objects in s.triples():
                at = pa.array(s.row[x])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), s.of(s.tok, x), pc.fill_null(subjects, "_"), verbs, pc.fill_null(objects, "_")], schema.names)

    return rows.mapInArrow(found, schema)


def concepts(tokens: DataFrame, part=lex.PART_VERBS, marker=lex.FUNCTION_MARKERS, function=lex.FUNCTION_VERBS, spatial=lex.SPATIAL_WORDS, condition=lex.CONDITION_WORDS, most: int = _WORDS) -> DataFrame:
    """(doc_id, sent, tok, src, dst, rel): the edges of all six relations, and the noun chunks, of which rel is CHUNK, tok the first token's, src the phrase and dst the head's lemma. One pass."""
    import pyarrow as pa

    rows = sentence_rows(tokens)
    fields = rows.schema
    schema = S.StructType([fields["doc_id"], fields["sent"], S.StructField("tok", fields["t"].dataType.elementType["tok"].dataType), *(S.StructField(x, S.StringType()) for x in ("src", "dst", "rel")), *(S.StructField(x, S.BooleanType()) for x in ("odd_src", "odd_dst"))])
    words = [set(w) for w in (part, marker, function, spatial, condition)]

    def found(batches):
        import pyarrow.compute as pc

        for b in batches:
            s = Sentences(b.column(2), most)

            def batch(rel, x, src, dst, b=b, s=s):
                at = pa.array(s.row[x])
                out = pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), s.of(s.tok, x), src, dst, pa.array([rel]).take(pa.array(np.zeros(len(x), int))), *(pc.match_substring_regex(c, _ODD) for c in (src, dst))], schema.names)
                return out.filter(dst.is_valid()) if rel != CHUNK and dst.null_count else out

            own, off, head = s.chunks()
            phrases = _joined(s.text, own, off)
            yield batch(CHUNK, own[off[:-1]], phrases, s.of(s.lemma, head))
            i, kid = s.children(head, s.among(s.dep, "amod", "nummod"))
            amod = s.among(s.dep, "amod")[kid]
            yield batch("property-of", kid, phrases.take(pa.array(i)), pc.if_else(pa.array(amod), s.of(s.lemma, kid), s.of(s.text, kid)))
            for rel, x, src, dst in s.relations(*words):
                some = (src >= 0) & (dst >= 0)
                x, src, dst = x[some], src[some], dst[some]
                phrase = rel != "function-of"
                for piece in _pieces(s.size[src] + (s.size[dst] if phrase else 0), most):
                    yield batch(rel, x[piece], s.words(src[piece]), s.words(dst[piece]) if phrase else s.of(s.lemma, dst[piece]))

    def phrase(c: str) -> Column:
        return F.when(F.col(f"odd_{c}"), T.normalize_np(F.col(c))).otherwise(F.btrim(c, F.lit(" ,;")))

    is_, dst = F.col("rel").isin, F.col("dst")
    target = F.when(is_("part-of", "spatial"), phrase("dst")).when(is_("condition"), F.btrim(dst, F.lit(" ,;"))).when(is_("property-of"), F.lower(dst)).otherwise(dst)
    return rows.mapInArrow(found, schema).select(*KEY, "tok", phrase("src").alias("src"), target.alias("dst"), "rel")


def concept_nodes(found: DataFrame) -> DataFrame:
    """(doc_id, label): each phrase of a chunk or an end of an edge of concepts() once; blanks go."""
    labels = F.when(F.col("rel") == CHUNK, F.array("src")).otherwise(F.array("src", "dst"))
    return found.select("doc_id", F.explode(labels).alias("label")).where("label <> ''").distinct()
