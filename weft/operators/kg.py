"""Triples and votes to a knowledge graph; everything is per document and first-seen order is a column.

A null in a part of a key or label counts as empty: such rows are skipped where parts must be filled. Repeated rows count
each. Ties go by the columns that the docstrings name. Empty inputs give empty results of the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .phrases import rewrite_phrases

KEY = ("doc_id", "sid", "subject", "object", "surface_pred")


def _filled(*names: str):
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & (F.col(n) != "")
    return out


def clean_triples(df: DataFrame) -> DataFrame:
    """Rows with all four parts (before stripping), stripped; a missing condition or modality is ''."""
    parts = ("sid", "subject", "surface_pred", "object")
    out = df.where(_filled(*parts))
    for n in parts:
        out = out.withColumn(n, T.strip(F.col(n)))
    for n in ("condition_text", "modality"):
        out = out.withColumn(n, T.strip(F.coalesce(F.col(n), F.lit(""))) if n in df.columns else F.lit(""))
    return out


def clean_relations(df: DataFrame) -> DataFrame:
    """(doc_id, name, definition, domain_hint, range_hint): the first row of each name that is not blank, defaults ''."""
    named = df.withColumn("name", T.strip(F.col("name"))).where("name <> ''")
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("pos"))).where("k = 1")
    return first.select("doc_id", "name", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("definition", "domain_hint", "range_hint")))


def entity_dictionary(mentions: DataFrame, prefix: str = "E") -> DataFrame:
    """(doc_id, label, first_pos, id): ids by first appearance of mentions(doc_id, pos, label)."""
    first = mentions.groupBy("doc_id", "label").agg(F.min("pos").alias("first_pos"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos", "label"))
    return first.withColumn("id", F.concat(F.lit(prefix), n))


def annotate_refs(splits: DataFrame, entities: DataFrame) -> DataFrame:
    """splits(doc_id, sid, text) with [Ref:EX] after each mention of its document's entities(doc_id, label, id).

    Mentions are whole words in any case, whatever punctuation stands beside them; leftmost first, of one place the longest
    label (see phrases). Labels that are equal but for case and white space are one, under the first of them. Tags are never
    searched. Null texts stay; a null doc_id is a document like others.
    """
    tagged = entities.select("doc_id", "label", F.concat(F.lit("[Ref:"), "id", F.lit("]")).alias("tag"))
    return rewrite_phrases(splits, tagged, "label", "tag", ("doc_id",), keep=True)


def build_kg(entities: DataFrame, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = entities.select("doc_id", "id", "label", F.coalesce("type", F.lit("Entity")).alias("type") if "type" in entities.columns else F.lit("Entity").alias("type"))
    return nodes, triples.select("doc_id", F.col("subject").alias("source"), F.col("object").alias("target"), F.col("surface_pred").alias("predicate"), F.col("sid").alias("evidence"))


def tally_votes(votes: DataFrame) -> DataFrame:
    """Count and first place of each predicate voted for each key; votes with an empty part are skipped. pos, v order the votes."""
    place = F.struct("pos", "v")
    return votes.where(_filled("sid", "subject", "object", "surface_pred", "canonical_pred")).groupBy(*KEY, "canonical_pred").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def majority_predicate(tally: DataFrame) -> DataFrame:
    """Per key: the predicate with most votes (ties: first seen), its share of all the key's votes, and the key's first place."""
    best = F.max_by("canonical_pred", F.struct("n", -F.col("first.pos"), -F.col("first.v")))
    return tally.groupBy(*KEY).agg(best.alias("predicate"), F.round(F.max("n") / F.sum("n"), 6).alias("confidence"), F.min("first.pos").alias("pos"), F.min("first").alias("first"))


def assign_node_ids(edges: DataFrame) -> DataFrame:
    """(doc_id, label, id): N1 ... in order of first use, subject before object, by (pos, sid, subject, object, surface_pred).

    Edges come together by document; grouping by label and numbering then need no other shuffle.
    """
    order = [F.col(c) for c in ("pos", "sid", "subject", "object", "surface_pred")]
    used = edges.select("doc_id", *order).repartition("doc_id").select("doc_id", *order, F.posexplode(F.array("subject", "object")).alias("side", "label"))
    first = used.groupBy("doc_id", "label").agg(F.min(F.struct(*order, "side")).alias("at"))
    return first.select("doc_id", "label", F.concat(F.lit("N"), F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).alias("id"))


def edges_with_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s, o = (nodes.select("doc_id", F.col("label").alias(a), F.col("id").alias(b)) for a, b in (("subject", "source"), ("object", "target")))
    return edges.join(s, ["doc_id", "subject"]).join(o, ["doc_id", "object"]).select("doc_id", "source", "target", "predicate", "surface_pred", F.col("sid").alias("evidence"), "confidence", "pos")


def filter_predicates(edges: DataFrame, names, colon_prefix: bool = False) -> DataFrame:
    """Predicates that are listed or start with custom_; with colon_prefix, custom: counts as custom_.

    names: a list, the same for all documents, or a table (doc_id, name), each document's own (clean_relations()).
    """
    if colon_prefix:
        edges = edges.withColumn("predicate", F.regexp_replace("predicate", "^custom:", "custom_"))
    if isinstance(names, DataFrame):
        listed = names.select("doc_id", F.col("name").alias("predicate")).distinct().withColumn("_listed", F.lit(True))
        return edges.join(listed, ["doc_id", "predicate"], "left").where("_listed or startswith(predicate, 'custom_')").select(*edges.columns)
    return edges.where(F.col("predicate").isin(*names) | F.col("predicate").startswith("custom_"))


def fallback_edges(triples: DataFrame, votes: DataFrame) -> DataFrame:
    """For documents without any vote row: an edge for each triple, simple labels, slugged predicate, confidence 0.4."""
    none = triples.join(votes.select("doc_id").distinct(), "doc_id", "left_anti")
    return none.select("doc_id", "pos", "sid", T.simple_label(F.col("subject")).alias("subject"), T.simple_label(F.col("object")).alias("object"), "surface_pred", T.predicate_slug(F.col("surface_pred")).alias("predicate"), F.lit(0.4).alias("confidence"))


def edge_evidence(edges: DataFrame, splits: DataFrame) -> DataFrame:
    return edges.join(splits.select("doc_id", F.col("sid").alias("evidence"), F.col("text").alias("evidence_text")), ["doc_id", "evidence"], "left")


def lineage(links: DataFrame) -> DataFrame:
    """(doc_id, id, parents, children): each link once, ids in order."""
    one = links.select("doc_id", "parent", "child").distinct()
    up = one.groupBy("doc_id", F.col("child").alias("id")).agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    down = one.groupBy("doc_id", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    empty = F.array().cast(up.schema["parents"].dataType)
    return up.join(down, ["doc_id", "id"], "full").select("doc_id", "id", F.coalesce("parents", empty).alias("parents"), F.coalesce("children", empty).alias("children"))


def voted_graph(triples: DataFrame, votes: DataFrame, names) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): votes tallied, majority taken, fallback for documents without votes, nodes numbered before the allow-list.

    The voted edges and the nodes are written once; nodes and edges both read them. names: the allow-list, names or a table with a column `name`.
    """
    voted = majority_predicate(tally_votes(votes)).drop("first")
    columns = ("doc_id", "pos", "sid", "subject", "object", "surface_pred", "predicate", "confidence")
    edges = cut_lineage(voted.select(*columns).unionByName(fallback_edges(triples, votes).select(*columns)), "voted")
    nodes = cut_lineage(assign_node_ids(edges), "nodes")
    return nodes, filter_predicates(edges_with_ids(edges, nodes), names)
