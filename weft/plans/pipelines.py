"""End-to-end plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import finds, graph, kg, relations, sentences
from ..session import cut_lineage, drop_written


def text_to_kg(docs: DataFrame, splits_of, triples_of, votes_of, relations_of) -> dict[str, DataFrame]:
    """Documents to input, splits, relation schema, nodes and edges.

    The functions give the outside answers as tables: splits_of(sentences), a document's splits (doc_id, sid, text, parent)
    or none, in which case each of its sentences is its own; triples_of(splits); relations_of(splits), the relations
    (doc_id, pos, name, ...) that its predicates may have; votes_of(triples). A document without triples has no nodes and
    no edges, but its splits. Splits and triples are written once, for all that reads them.
    """
    sents = sentences.split_sentences(docs)
    splits = cut_lineage(sentences.identity_splits(sents, splits_of(sents)), "splits")
    schema = kg.clean_relations(relations_of(splits))
    triples = cut_lineage(kg.clean_triples(triples_of(splits)), "triples")  # read for votes, for edges and for the fallback
    nodes, edges = kg.voted_graph(triples, votes_of(triples), schema)
    return {"input": docs, "splits": splits, "relation_schema": schema, "nodes": nodes, "edges": edges}


def concept_edges(toks: DataFrame, **words) -> DataFrame:
    """The relations of all six kinds: (doc_id, sent, tok, src, dst, rel, weight); words: other word lists for part, marker, function, spatial, condition."""
    return relations.with_rel_weight(finds.concepts(toks, **words).where(F.col("rel") != finds.CHUNK))


def concept_tree(toks: DataFrame, most: int = 1_000_000, **words) -> DataFrame:
    """(doc_id, src, dst, rel, weight, method): each document's tree of concepts below its most frequent chunk head.

    Best parents after the part-of boost give the tree (`best-parent`); what the root's first chunk reaches is kept. Documents whose
    root reaches nothing take the maximum spanning tree of their largest component instead (`forest`). Documents are worked on
    whole, many at once; those of more than `most` edges go through rounds, all of them at once.
    """
    found = cut_lineage(finds.concepts(toks, **words), "found")  # read for the chunks and for the relations
    chunks, edges = found.where(F.col("rel") == finds.CHUNK), relations.with_rel_weight(found.where(F.col("rel") != finds.CHUNK))
    place = (F.col("sent").cast("bigint") * 100000 + F.col("tok")).alias("pos")
    strong = graph.boost_part_of(graph.strongest_edges(edges.select("doc_id", "src", "dst", "rel", "weight", place)))
    of_head = chunks.groupBy("doc_id", F.col("dst").alias("head")).agg(F.count("*").alias("n"), F.min(F.struct("sent", F.col("tok").alias("start"), F.col("src").alias("label"))).alias("first"))
    start = of_head.groupBy("doc_id").agg(F.max_by(F.struct("head", "first.label"), F.struct("n", -F.col("first.sent"), -F.col("first.start"))).alias("x")).where("x.head is not null").select("doc_id", F.col("x.label").alias("id"))
    trees = cut_lineage(graph.document_trees(strong, start, most), "trees")
    drop_written(found)
    columns = ["doc_id", "src", "dst", "rel", "weight", "method"]
    large = trees.where("not whole")
    if large.isEmpty():
        return trees.where("whole").select(*columns)
    rounds = cut_lineage(_tree_by_rounds(large.where("dst is not null").select(*columns[:5]), large.where("dst is null").select("doc_id", F.col("src").alias("id"))), "concepts")
    return trees.where("whole").select(*columns).unionByName(rounds.select(*columns))


def _tree_by_rounds(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """graph.document_trees() by rounds over all documents at once: nodes are named by document."""
    strong, start = cut_lineage(graph.named(edges, "src", "dst"), "strong"), graph.named(starts, "id")
    tree = graph.best_parent_tree(strong)
    near = graph.reachable(tree, start)
    below = cut_lineage(graph.induced_subgraph(tree, near).withColumn("method", F.lit("best-parent")), "below")
    drop_written(near)
    doc = F.struct(F.col("src.doc_id").alias("doc_id"))  # one column in which nulls are equal
    rest = cut_lineage(strong.withColumn("doc", doc).join(below.select(doc.alias("doc")).distinct(), "doc", "left_anti").drop("doc"), "rest")
    parts = graph.document_components(graph.unnamed(rest.select("src", "dst"), "src", "dst"))
    largest = graph.named(graph.largest_component(parts).select("doc_id", "id"), "id")
    forest = graph.maximum_spanning_forest(graph.induced_subgraph(rest, largest))
    forest = forest.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(None).cast("string").alias("rel"), "weight", F.lit("forest").alias("method"))
    both = cut_lineage(graph.unnamed(below.select("src", "dst", "rel", "weight", "method").unionByName(forest), "src", "dst"), "concepts")
    for done in (strong, tree, below, rest, parts):
        drop_written(done)
    return both
