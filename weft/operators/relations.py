"""Relations and triples from sentence rows (tokens.parse): each sentence's array yields its own, without joins or shuffles.
Sentence rows that aren't parsed yet do too: then only the sentences are parsed that hold a word which the relation asks for.

Results have a row for each find; sentences without any have none. Fields of tokens that are null match no rule.
svo_triples() and all relations at once (finds.concepts) are found in vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as T
from .finds import svo_triples  # noqa: F401
from .tokens import KEY, NOMINAL, chunks_of, parse, subtree, subtree_places, subtree_text, tokens_at

SUBJECTS = ("nsubj", "nsubjpass")
OBJECTS = ("dobj", "obj")


def _kids(t: Column, x: Column, *deps: str) -> Column:
    """The children of token x with one of the dependencies, in order."""
    return F.filter(F.transform(x["kids"], lambda i: F.get(t, i)), lambda k: k["dep"].isin(*deps))


def _head(t: Column, x: Column) -> Column:
    return F.get(t, x["up"])


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _found(parsed: DataFrame, tokens: Callable[[Column], Column], rows: Callable[[Column, Column], Column], some: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, sent, ...): the structs that rows(t, x) gives for the tokens x that satisfy the condition, in one pass over the sentences.

    some: a condition that a token of each sentence with finds satisfies. Sentence rows without subtrees are parsed, but only those with such a token.
    """
    t = F.col("t")
    holds = lambda f: lambda x: F.coalesce(f(x), F.lit(False))
    if "kids" not in parsed.schema["t"].dataType.elementType.names:
        if some:  # not by where(), which would put a sentence's tokens together twice
            parsed = parsed.select(*KEY, F.explode(F.filter(F.array(t), lambda t: F.exists(t, holds(some)))).alias("t"))
        parsed = parse(parsed)
    return parsed.select(*KEY, F.inline(F.flatten(F.transform(F.filter(t, holds(tokens)), lambda x: rows(t, x)))))


def _edges(parsed: DataFrame, rel: str, tokens: Callable, ends: Callable) -> DataFrame:
    """(doc_id, sent, tok, src, dst, rel, weight); ends(t, x): source and an array of targets, null or empty for none."""

    def rows(t: Column, x: Column) -> Column:
        src, targets = ends(t, x)
        return F.transform(targets, lambda d: F.struct(x["tok"].alias("tok"), src.alias("src"), d.alias("dst")))

    out = _found(parsed, tokens, rows, tokens).where("src is not null and dst is not null")
    return out.select(*KEY, "tok", "src", "dst", F.lit(rel).alias("rel"), F.lit(lex.RELATION_WEIGHTS[rel]).alias("weight"))


def _phrases(edges: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        edges = edges.withColumn(c, T.normalize_np(F.col(c)))
    return edges


def rel_part_of(parsed: DataFrame, verbs=lex.PART_VERBS) -> DataFrame:
    """Whole: the verb's first subject, else the noun that it depends on; parts: its objects and those of its prepositions."""

    def ends(t: Column, x: Column) -> tuple[Column, Column]:
        head = _head(t, x)
        whole = subtree_text(t, F.coalesce(_first(_kids(t, x, *SUBJECTS)), F.when(head["pos_tag"].isin(*NOMINAL), head)))
        under = F.flatten(F.transform(_kids(t, x, "prep"), lambda p: F.transform(_kids(t, p, "pobj"), lambda o: subtree_text(t, o))))
        return whole, F.concat(F.transform(_kids(t, x, *OBJECTS), lambda k: subtree_text(t, k)), under)

    return _phrases(_edges(parsed, "part-of", lambda x: (x["pos_tag"] == "VERB") & F.lower(x["lemma"]).isin(*verbs), ends), "src", "dst")


def rel_function_marker(parsed: DataFrame, markers=lex.FUNCTION_MARKERS) -> DataFrame:
    """Owner: the marker's head; function: the first verb of the marker's subtree."""
    return _phrases(_edges(parsed, "function-of", lambda x: F.lower(x["text"]).isin(*markers) & x["dep"].isin("amod", "acl"), lambda t, x: (subtree_text(t, _head(t, x)), F.array(x["verb"]))), "src")


def rel_function_verb(parsed: DataFrame, verbs=lex.FUNCTION_VERBS) -> DataFrame:
    """Owner: the verb's first subject; function: its first clausal verb, else the first verb below the first "to" below it that has one."""

    def ends(t: Column, x: Column) -> tuple[Column, Column]:
        clause = _first(F.filter(_kids(t, x, "xcomp", "ccomp"), lambda k: k["pos_tag"] == "VERB"))["lemma"]
        to = _first(F.filter(subtree(t, x), lambda k: (F.lower(k["text"]) == "to") & k["verb"].isNotNull()))["verb"]
        return subtree_text(t, _first(_kids(t, x, *SUBJECTS))), F.array(F.coalesce(clause, to))

    return _phrases(_edges(parsed, "function-of", lambda x: (x["pos_tag"] == "VERB") & F.lower(x["lemma"]).isin(*verbs), ends), "src")


def rel_property(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of each noun chunk, the adjectives (lemma) and numbers (text) that depend on its head."""
    of = tokens.where("dep in ('amod', 'nummod') and head <> tok").select(*KEY, "tok", F.col("head").alias("head_tok"), F.lower(F.when(F.col("dep") == "amod", F.col("lemma")).otherwise(F.col("text"))).alias("dst"))
    key = F.struct(*KEY, "head_tok").alias("_key")  # in which nulls are equal
    out = chunks.select(*KEY, "chunk", key).join(of.select("tok", "dst", key), "_key").where("dst is not null")
    return out.select(*KEY, "tok", T.normalize_np(F.col("chunk")).alias("src"), "dst", F.lit("property-of").alias("rel"), F.lit(lex.RELATION_WEIGHTS["property-of"]).alias("weight"))


def chunk_properties(parsed: DataFrame) -> DataFrame:
    """rel_property() of parsed sentences with their own noun chunks, without a join."""

    def of(c: Column) -> Column:
        word = lambda k: F.lower(F.when(k["dep"] == "amod", k["lemma"]).otherwise(k["text"]))
        return F.transform(_kids(F.col("t"), c["head"], "amod", "nummod"), lambda k: F.struct(k["tok"].alias("tok"), c["chunk"].alias("src"), word(k).alias("dst")))

    out = parsed.select(*KEY, F.inline(F.flatten(F.transform(chunks_of(F.col("t")), of)))).where("dst is not null")
    return out.select(*KEY, "tok", T.normalize_np(F.col("src")).alias("src"), "dst", F.lit("property-of").alias("rel"), F.lit(lex.RELATION_WEIGHTS["property-of"]).alias("weight"))


def rel_spatial(parsed: DataFrame, words=lex.SPATIAL_WORDS) -> DataFrame:
    """Target: the preposition's first object; source: the noun that it depends on, or the first argument of the verb that it depends on."""

    def ends(t: Column, x: Column) -> tuple[Column, Column]:
        head = _head(t, x)
        anchor = F.when(head["pos_tag"].isin(*NOMINAL), head).when(head["pos_tag"] == "VERB", _first(_kids(t, head, *OBJECTS, *SUBJECTS)))
        return subtree_text(t, anchor), F.array(subtree_text(t, _first(_kids(t, x, "pobj"))))

    return _phrases(_edges(parsed, "spatial", lambda x: (x["pos_tag"] == "ADP") & F.lower(x["lemma"]).isin(*words), ends), "src", "dst")


def rel_condition(parsed: DataFrame, words=lex.CONDITION_WORDS) -> DataFrame:
    """Owner: the first argument of the mark's head; condition: the head's whole subtree."""

    def ends(t: Column, x: Column) -> tuple[Column, Column]:
        head = _head(t, x)
        return subtree_text(t, _first(_kids(t, head, "nsubj", *OBJECTS))), F.array(F.btrim(subtree_text(t, head), F.lit(" ,;")))

    return _phrases(_edges(parsed, "condition", lambda x: F.lower(x["lemma"]).isin(*words) & (x["dep"] == "mark"), ends), "src")


def with_rel_weight(edges: DataFrame) -> DataFrame:
    """Adds weight by rel, or replaces it; 1 for relations that are not listed and for null."""
    weights = F.create_map(*(F.lit(x) for pair in lex.RELATION_WEIGHTS.items() for x in pair))
    return edges.withColumn("weight", F.coalesce(F.try_element_at(weights, F.col("rel")), F.lit(1.0)))


def _phrase(t: Column, x: Column) -> Column:
    """Negation (the last), lemma and particles of a verb."""
    neg = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(_kids(t, x, "neg"), lambda k: k["text"])), -1)
    return F.array_join(F.concat(F.array_compact(F.array(neg, x["lemma"])), F.transform(_kids(t, x, "prt"), lambda k: k["text"])), " ")


def verb_phrase(parsed: DataFrame) -> DataFrame:
    """(doc_id, sent, tok, phrase): negation (the last), lemma and particles of each verb or auxiliary. Sentence rows without subtrees do."""
    return _found(parsed, lambda x: x["pos_tag"].isin("VERB", "AUX"), lambda t, x: F.array(F.struct(x["tok"].alias("tok"), _phrase(t, x).alias("phrase"))))


def copular_triples(parsed: DataFrame) -> DataFrame:
    """(doc_id, sent, tok, subject, verb, object) of sentences whose root has a cop child that is a verb or auxiliary; the complement is the root's acomp, attr and xcomp subtrees, else its own."""

    def row(t: Column, x: Column) -> Column:
        cop = _first(_kids(t, x, "cop"))
        words = T.let(_kids(t, x, "acomp", "attr", "xcomp"), lambda tops: F.transform(tokens_at(t, F.array_distinct(F.flatten(F.transform(tops, lambda c: subtree_places(t, c))))), lambda k: k["text"]))
        complement = T.let(words, lambda w: F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(subtree_text(t, x)))
        subject = F.coalesce(subtree_text(t, _first(_kids(t, x, *SUBJECTS, "csubj"))), F.lit("_"))
        verb = F.when(cop["pos_tag"].isin("VERB", "AUX"), _phrase(t, cop))
        return F.array(F.struct(x["tok"].alias("tok"), subject.alias("subject"), verb.alias("verb"), complement.alias("object")))

    cop = lambda x: (x["dep"] == "cop") & x["pos_tag"].isin("VERB", "AUX")
    return _found(parsed, lambda x: x["head"] == x["tok"], row, cop).where("verb is not null")


def distinct_triples(triples: DataFrame, columns=("subject", "surface_pred", "object")) -> DataFrame:
    """Each triple of a document once, with its first place."""
    return triples.groupBy("doc_id", *columns).agg(F.min("pos").alias("pos"))
