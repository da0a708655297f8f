"""Graph operators over edges(src, dst, rel, weight, pos). Loops write each round to the shared folder and drop what no later round reads.

Where edges have a doc_id, each document is a graph of its own; the iterative operators then take nodes made by named() and
give them back by unnamed(). Edges with a null end are left out; repeated edges count once but in degrees and weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds, cut_lineage, drop_written


def _by(df: DataFrame) -> list[str]:
    return ["doc_id"] if "doc_id" in df.columns else []


def _whole(edges: DataFrame) -> DataFrame:
    """The edges with both ends."""
    return edges.where("src is not null and dst is not null")


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Without doc_id, but with the document in the columns, as structs (doc_id, name), so that all documents' graphs are worked on at once.

    A null doc_id is a document like others; null names stay null.
    """
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.struct("doc_id", F.col(c).alias("name"))) for c in columns}).drop("doc_id")


def unnamed(df: DataFrame, *columns: str) -> DataFrame:
    """The document as doc_id and the plain names again."""
    return df.select(F.col(f"{columns[0]}.doc_id").alias("doc_id"), *(F.col(f"{c}.name").alias(c) if c in columns else F.col(c) for c in df.columns))


def simple_digraph(triples: DataFrame) -> DataFrame:
    """One edge for each ordered pair (of a document); the last relation by pos stands, of several at one place the greatest."""
    return _whole(triples).groupBy(*_by(triples), "src", "dst").agg(F.max(F.struct("pos", "rel"))["rel"].alias("rel"))


def strongest_edges(edges: DataFrame) -> DataFrame:
    """Without self-loops, the heaviest edge of each pair (of a document); ties go to the first by pos, then to the least relation."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "pos", "rel")).alias("e")
    return _whole(edges).where("src <> dst").groupBy(*_by(edges), "src", "dst").agg(best).select(*_by(edges), "src", "dst", "e.rel", (-F.col("e.w")).alias("weight"), "e.pos")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, in_degree, out_degree) of the nodes, by document if edges have a doc_id; a self-loop counts twice. One grouping."""
    edges, key = _whole(edges), [*_by(edges), "id"]
    end = lambda c, i, o: edges.select(*_by(edges), F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"), F.lit(False).alias("node"))
    own = nodes.select(*key, F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(True).alias("node"))
    by = own.union(end("src", 0, 1)).union(end("dst", 1, 0)).groupBy(*key).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.max("node").alias("node"))
    return by.where("node").select(*key, (F.col("in_degree") + F.col("out_degree")).alias("degree"), "in_degree", "out_degree")


def root_by_degree(deg: DataFrame) -> DataFrame:
    """The node of the highest (in-degree, degree), of each document if there is a doc_id; ties go to the first name. A grouped minimum, not a sort."""
    best = F.min(F.struct((-F.col("in_degree")).alias("i"), (-F.col("degree")).alias("d"), "id"))
    return deg.groupBy(*_by(deg)).agg(best.alias("b")).select(*_by(deg), "b.id").where("id is not null")


def boost_part_of(edges: DataFrame, boost: float = 5.0) -> DataFrame:
    return edges.withColumn("weight", F.when(F.col("rel") == "part-of", F.col("weight") + boost).otherwise(F.col("weight")))


def best_parent_tree(edges: DataFrame) -> DataFrame:
    """(src, dst, rel, weight): the heaviest edge into each node (ties: first source, then relation).

    Where chosen edges form a cycle, its lightest edge is dropped and its node takes its next best edge; exact on
    acyclic choices, simpler than contraction on cycles. Edges are ranked once; a round looks only at the trees that its
    new choices may have closed to cycles, and writes the choices that stand.
    """
    rank = F.row_number().over(Window.partitionBy("dst").orderBy(F.col("weight").desc(), "src", "rel"))
    ranked = cut_lineage(_whole(edges).where("src <> dst").select("src", "dst", "rel", "weight").distinct().withColumn("k", rank), "ranked")
    tree = cut_lineage(ranked.where("k = 1"), "tree")
    while True:
        cycle = _on_cycles(tree)
        lightest = cycle.withColumn("n", F.row_number().over(Window.partitionBy("cycle").orderBy("weight", "src", "dst"))).where("n = 1")
        lost = cut_lineage(lightest.select("dst", "k"), "lost")
        drop_written(cycle)
        if lost.isEmpty():
            drop_written(lost)
            drop_written(ranked)
            return _keep(tree.drop("k"), tree)
        fresh = ranked.join(lost.select("dst", (F.col("k") + 1).alias("k")), ["dst", "k"]).select(*tree.columns)
        tree = cut_lineage(tree.join(lost.select("dst"), "dst", "left_anti").select(*tree.columns).union(fresh), "tree", replaces=tree)
        drop_written(lost)


def _keep(df: DataFrame, written: DataFrame) -> DataFrame:
    """df, with the files that it reads, so that they can be dropped with it."""
    df._written_to = written._written_to
    return df


def _jumped(jump: DataFrame, n: int, *, low: bool) -> DataFrame:
    """jump(node, up[, low]) after n steps up at least, by pointer doubling; nodes from which the way up ends sooner fall away. Written."""
    steps = 1
    while steps < n and not jump.isEmpty():
        up = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), *([F.col("low").alias("low2")] if low else []))
        jump = cut_lineage(jump.join(up, "up").select("node", F.col("up2").alias("up"), *([F.least("low", "low2").alias("low")] if low else [])), "jump", replaces=jump)
        steps *= 2
    return jump


def _on_cycles(tree: DataFrame) -> DataFrame:
    """Edges of a table with one parent per node that lie on cycles, with a cycle's name (written). After as many steps up as there are nodes, each node left is below a cycle, and where it has come to is on it."""
    start = cut_lineage(tree.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.least("src", "dst").alias("low")), "jump")
    jump = _jumped(start, tree.count(), low=True)
    ring = tree.join(jump.select(F.col("up").alias("dst")).distinct(), "dst", "left_semi")
    out = cut_lineage(ring.join(jump.select(F.col("node").alias("dst"), F.col("low").alias("cycle")), "dst").select("src", "dst", "rel", "weight", "k", "cycle"), "cycles")
    drop_written(jump)
    return out


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the roots and all that can be reached from them.

    A node with one way in is reached as what stands before it is, so chains of such nodes are first shortened to their
    beginnings, by pointer doubling; what is left takes a round per step. Each round writes only what is new.
    """
    edges = cut_lineage(_whole(edges).select("src", "dst").where("src <> dst").distinct(), "edges")
    roots = roots.select("id").where("id is not null").distinct()
    single = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1").drop("n")
    jump = cut_lineage(single.join(roots.withColumnRenamed("id", "node"), "node", "left_anti"), "jump")
    n, steps = jump.count(), 1
    while steps < n:  # a way up that ends stays where it ends; those on cycles without a way in go on
        up = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        longer = jump.join(up, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
        jump = cut_lineage(longer, "jump", replaces=jump)
        steps *= 2
        if jump.where("moved").isEmpty():
            break
        jump = _keep(jump.drop("moved"), jump)
    short = jump.select(F.col("node").alias("src"), F.col("up").alias("first"))
    core = edges.join(jump.select(F.col("node").alias("dst")), "dst", "left_anti").join(short, "src", "left")
    core = cut_lineage(core.select(F.coalesce("first", "src").alias("src"), "dst").distinct(), "core", replaces=edges)
    seen = Rounds(roots, "seen")
    while not seen.last.isEmpty():
        onward = core.join(seen.last.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        seen.add(onward.join(seen.all, "id", "left_anti"))
    below = jump.join(seen.all.withColumnRenamed("id", "up"), "up", "left_semi").select(F.col("node").alias("id"))
    out = cut_lineage(seen.all.union(below), "reached")
    for done in (core, jump, seen.all):
        drop_written(done)
    return out


def induced_subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the component. Labels shrink to the least neighbour's and then to their label's label, until none changes."""
    edges = _whole(edges)
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "both")
    labels = cut_lineage(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        hooked = cut_lineage(hooked, "hooked")
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = cut_lineage(hooked.join(jump, "component").select("id", F.least("component", "next").alias("component"), "was"), "labels", replaces=labels)
        drop_written(hooked)
        labels = _keep(after.drop("was"), after)
        if after.where("component <> was").isEmpty():
            drop_written(both)
            return labels


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of 0 .. n - 1 that each is linked to by pairs (a, b): least labels are passed on and jumped over, in vectors."""
    label = np.arange(n)
    while True:
        near = label.copy()
        np.minimum.at(near, label[a], label[b])
        np.minimum.at(near, label[b], label[a])
        while (further := near[near] != near).any():
            near[further] = near[near[further]]
        if (near[a] == near[b]).all():
            return near
        label = near


def document_components(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """connected_components() of edges(doc_id, src, dst) with names as strings, each document a graph: (doc_id, id, component).

    Documents come to tasks whole, in order, and many are labelled at once in vectors. One with more than `most` nodes is
    handed on in stars of that many, and the stars of such documents go through the rounds. One shuffle for all others.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = _whole(edges).select("doc_id", "src", "dst")
    doc, name = ends.schema["doc_id"].dataType, ends.schema["src"].dataType.simpleString()
    labels_schema = f"doc_id {doc.simpleString()}, id {name}, component {name}, whole boolean"

    def stars(t):
        """(documents, ids, components) of a table's nodes, by document in the order in which these come, which is one run for each."""
        docs = t.column(0).combine_chunks()
        code = pc.fill_null(docs.dictionary_encode(null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        names = pa.concat_arrays([t.column(k).combine_chunks() for k in (1, 2)]).dictionary_encode()
        order = pc.sort_indices(names.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        nodes, at = np.unique(np.tile(code, 2) * len(order) + rank[names.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
        least = nodes[_least_labels(*np.split(at.ravel(), 2), len(nodes))]
        own = names.dictionary.take(pa.array(order))
        first = np.unique(code, return_index=True)[1]
        return docs.take(pa.array(first[nodes // len(order)])), own.take(pa.array(nodes % len(order))), own.take(pa.array(least % len(order)))

    def labelled(batches):
        held, rows, split = [], 0, []  # split: the document of which stars were handed on

        def out(last: bool):
            nonlocal held, rows, split
            docs, ids, tops = stars(pa.Table.from_batches(held))
            at = docs[len(docs) - 1]
            of = lambda d: pc.fill_null(pc.equal(docs, d), False) if d.is_valid else docs.is_null()
            open_ = of(at) if not last else pa.array(np.zeros(len(docs), bool))
            table = pa.table([docs, ids, tops, pc.invert(of(split[0])) if split else pa.array(np.ones(len(docs), bool))], names=["doc_id", "id", "component", "whole"])
            keep = table.filter(open_)
            done = table.filter(pc.invert(open_))
            if len(keep) > most:
                done, keep, split = pa.concat_tables([done, keep.set_column(3, "whole", pa.array(np.zeros(len(keep), bool)))]), keep.slice(0, 0), [at]
            elif split and not split[0].equals(at):
                split = []
            held = keep.select(["doc_id", "id", "component"]).rename_columns(["doc_id", "src", "dst"]).to_batches()
            rows = 0
            yield from done.to_batches()

        for b in batches:
            held.append(pa.RecordBatch.from_arrays(b.columns, ["doc_id", "src", "dst"]))
            rows += b.num_rows
            if rows >= min(most, 200_000):
                yield from out(False)
        if sum(b.num_rows for b in held):
            yield from out(True)

    labels = cut_lineage(ends.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(labelled, labels_schema), "labels")
    large = labels.where("not whole")
    own = _keep(labels.where("whole").select("doc_id", "id", "component"), labels)
    if large.isEmpty():
        return own
    rest = connected_components(named(large.select("doc_id", F.col("id").alias("src"), F.col("component").alias("dst")), "src", "dst"))
    return own.select("*").union(unnamed(rest, "id", "component"))


def _chosen(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (u, v) of n nodes, the first to be taken first, make a spanning forest."""
    chosen, at, first = np.zeros(len(u), bool), np.arange(len(u)), len(u)
    while len(at):
        best = np.full(n, -1)
        for end in (v, u):
            new = np.full(n, first)
            new[end[::-1]] = at[::-1]  # the first stands
            best = np.where(best < 0, new, np.minimum(best, new))
        new = np.unique(best[best < first])
        chosen[new] = True
        took = np.isin(at, new, assume_unique=True)
        label = _least_labels(u[took], v[took], n)
        u, v = label[u], label[v]
        open_ = u != v
        u, v, at = u[open_], v[open_], at[open_]
    return chosen


def _best_parents(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, largest: int) -> np.ndarray:
    """Of edges a -> b, in the order in which each b takes them, the one that each of n nodes has in best_parent_tree(), else -1. largest: nodes of a graph among them."""
    begin, end = np.searchsorted(b, np.arange(n)), np.searchsorted(b, np.arange(n), side="right")
    at, nodes, steps = begin.copy(), np.arange(n), largest.bit_length()
    while True:
        has = at < end
        up = np.where(has, a[np.minimum(at, len(a) - 1)], nodes)
        far = up
        for _ in range(steps):
            far = far[far]
        ring = np.zeros(n, bool)
        ring[far[has[far]]] = True
        x = np.flatnonzero(ring)
        if not len(x):
            return np.where(has, at, -1)
        low, jump = np.where(ring, np.minimum(nodes, up), nodes), np.where(ring, up, nodes)
        for _ in range(steps):
            low, jump = np.minimum(low, low[jump]), jump[jump]
        order = np.lexsort((x, up[x], weight[at[x]], low[x]))
        first = np.concatenate(([True], np.diff(low[x][order]) != 0))
        at[x[order][first]] += 1


def document_trees(edges: DataFrame, starts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Of edges(doc_id, src, dst, rel, weight), each document a graph in which a pair (src, dst) stands once, and starts(doc_id, id): (doc_id, src, dst, rel, weight, method, whole).

    What best_parent_tree() has below a document's start (method `best-parent`); where that is nothing, the maximum spanning forest of its
    largest component (`forest`, src < dst, without rel). Names are strings. Documents come to tasks whole, and many are worked on at once in
    vectors. The edges and starts (dst null) of one of which more than `most` rows wait at once are handed on as they are, not whole.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    doc = edges.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc}, src string, dst string, rel string, weight double, method string, whole boolean"
    names = ["doc_id", "src", "dst", "rel", "weight", "method", "whole"]

    def result(docs, src, dst, rel, weight, method, whole=True):
        n = len(docs)
        return pa.RecordBatch.from_arrays([docs, src, dst, rel, weight, pa.array([method] * n, pa.string()), pa.array([whole] * n, pa.bool_())], names)

    def codes(docs) -> np.ndarray:
        return pc.fill_null(docs.dictionary_encode(null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def grown(t):
        docs, src, dst, rel, weight = (t.column(k).combine_chunks() for k in range(5))
        is_edge = np.asarray(dst.is_valid())
        e, s = np.flatnonzero(is_edge), np.flatnonzero(~is_edge)
        if not len(e):
            return
        both = pa.concat_arrays([src, dst.take(pa.array(e))]).dictionary_encode()
        by_name = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        of = codes(docs)
        nodes, at = np.unique(np.concatenate((of, of[e])) * len(by_name) + rank[both.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
        n, of_node, own = len(nodes), nodes // len(by_name), both.dictionary.take(pa.array(by_name[nodes % len(by_name)]))
        a, b, w = at[e], at[len(docs) :], weight.to_numpy(zero_copy_only=False)[e]
        order = np.lexsort((a, -w, b))
        e, a, b, w = e[order], a[order], b[order], w[order]
        best = _best_parents(a, b, w, n, int(np.bincount(of_node).max()))
        tree = best[best >= 0]
        near, jump = np.zeros(n, bool), np.arange(n)
        near[at[s]] = True
        jump[b[tree]] = a[tree]
        while True:
            near, was, jump = near | near[jump], jump, jump[jump]
            if (jump == was).all():
                break
        tree = tree[near[a[tree]] & near[b[tree]]]
        at = pa.array(e[tree])
        yield result(*(c.take(at) for c in (docs, src, dst, rel, weight)), "best-parent")

        rest = np.flatnonzero(~np.isin(of_node[a], np.unique(of_node[a[tree]])))
        label = _least_labels(a[rest], b[rest], n)
        parts, size = np.unique(label[np.unique(np.concatenate((a[rest], b[rest])))], return_counts=True)
        order = np.lexsort((parts, -size, of_node[parts]))
        largest = np.zeros(n, bool)
        largest[parts[order][np.concatenate(([True], np.diff(of_node[parts][order]) != 0))[: len(parts)]]] = True
        rest = rest[largest[label[a[rest]]]]
        u, v = np.minimum(a[rest], b[rest]), np.maximum(a[rest], b[rest])
        order = np.lexsort((-w[rest], v, u))
        heaviest = np.concatenate(([True], (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)))[: len(rest)]
        order = order[heaviest]
        order = order[np.lexsort((v[order], u[order], -w[rest[order]]))]
        order = order[_chosen(u[order], v[order], n)]
        at = pa.array(e[rest[order]])
        yield result(docs.take(at), own.take(pa.array(u[order])), own.take(pa.array(v[order])), pa.nulls(len(order), pa.string()), weight.take(at), "forest")

    def trees(batches):
        held, rows, split = [], 0, None  # split: the document of which rows were handed on

        def as_is(t):
            for b in t.combine_chunks().to_batches():
                yield result(*b.columns, None, False)

        def out(last: bool):
            nonlocal held, rows, split
            t = pa.Table.from_batches(held).combine_chunks()
            docs = t.column(0).combine_chunks()
            of, held, rows = codes(docs), [], 0
            if split is not None:  # documents come in runs
                n = int(np.searchsorted(of != of[0], True)) if docs[0].equals(split) else 0
                yield from as_is(t.slice(0, n))
                t, docs, of = t.slice(n), docs.slice(n), of[n:]
                if not len(of):
                    return
                split = None
            n = len(of) if last else int(np.searchsorted(of == of[-1], True))
            if n:
                yield from grown(t.slice(0, n))
            if len(of) - n > most:
                split = docs[n]
                yield from as_is(t.slice(n))
            elif n < len(of):
                held, rows = t.slice(n).combine_chunks().to_batches(), 0

        for b in batches:
            held.append(pa.RecordBatch.from_arrays(b.columns, names[:5]))
            rows += b.num_rows
            if rows >= min(most, 200_000):
                yield from out(False)
        if held:
            yield from out(True)

    none = lambda kind: F.lit(None).cast(kind)
    both = edges.select("doc_id", "src", "dst", F.col("rel").cast("string").alias("rel"), F.col("weight").cast("double").alias("weight")).union(starts.where("id is not null").select("doc_id", "id", none("string"), none("string"), none("double")))
    return both.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(trees, schema)


def largest_component(components: DataFrame) -> DataFrame:
    """The ids of the component with most nodes, of each document if there is a doc_id; ties go to the least name."""
    by = _by(components)
    size = components.groupBy(*by, "component").agg(F.count("*").alias("n"))
    best = size.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select(*by, "b.component")
    key = F.struct(*by, "component").alias("_key")  # in which nulls are equal
    return components.withColumn("_key", key).join(best.select(key), "_key", "left_semi").select(*by, "id", "component")


def _forests(pairs: DataFrame, most: int = 2_000_000) -> DataFrame:
    """pairs(u, v, weight), each of which stands once, without those that close a cycle with heavier ones among the up to `most` that a task meets together: no forest of all has them."""
    import pyarrow as pa
    import pyarrow.compute

    def kept(table):
        names = pa.concat_arrays([table.column(k).combine_chunks() for k in (0, 1)]).dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        first = np.empty(len(names.dictionary), np.int64)
        first[pa.compute.sort_indices(names.dictionary).to_numpy()] = np.arange(len(first))
        u, v = np.split(first[codes].astype(np.int64), 2)
        weight = -np.where(w := np.asarray(table.column(2).is_null()), np.inf, table.column(2).to_numpy())  # a null is the first in Spark's order, NaN the last
        order = np.lexsort((v, u, weight, ~w))
        chosen = _chosen(u[order], v[order], len(first))
        return table.take(pa.array(np.sort(order[chosen])))

    def forests(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                yield from kept(pa.Table.from_batches(held)).to_batches()
                held, rows = [], 0
        if rows:
            yield from kept(pa.Table.from_batches(held)).to_batches()

    return pairs.mapInArrow(forests, pairs.schema)


def maximum_spanning_forest(edges: DataFrame, single: bool = False) -> DataFrame:
    """(u, v, weight), u < v: Boruvka rounds; the order (weight desc, u, v) makes the forest unique. Each round writes only the edges that it chooses and those still open.

    single: each pair stands once, whichever way round. Names that are strings and weights that are doubles first lose in each
    task what its own edges rule out.
    """
    pairs = _whole(edges).where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight")
    if not single:
        pairs = pairs.groupBy("u", "v").agg(F.max("weight").alias("weight"))
    if [f.dataType.simpleString() for f in pairs.schema] == ["string", "string", "double"]:
        pairs = _forests(pairs)
    open_edges = cut_lineage(pairs.select("u", "v", "weight", F.col("u").alias("cu"), F.col("v").alias("cv")), "open")
    forest = Rounds(open_edges.select("u", "v", "weight").limit(0), "forest")
    while not open_edges.isEmpty():
        was = open_edges
        order = F.struct((-F.col("weight")).alias("w"), "u", "v")
        ends = open_edges.select(F.col("cu").alias("c"), order.alias("o")).union(open_edges.select("cv", order))
        forest.add(ends.groupBy("c").agg(F.min("o").alias("o")).select("o.u", "o.v", (-F.col("o.w")).alias("weight")).distinct())
        merged = connected_components(open_edges.join(forest.last.select("u", "v"), ["u", "v"]).select(F.col("cu").alias("src"), F.col("cv").alias("dst")))
        for end in ("cu", "cv"):
            open_edges = open_edges.join(merged.select(F.col("id").alias(end), F.col("component").alias(f"n{end}")), end, "left").withColumn(end, F.coalesce(f"n{end}", end)).drop(f"n{end}")
        open_edges = cut_lineage(open_edges.where("cu <> cv").select("u", "v", "weight", "cu", "cv"), "open", replaces=was)
        drop_written(merged)
    drop_written(open_edges)
    return forest.all


def tree_rows(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth, rel, path): a tree depth first when sorted by (root, path); children by weight, heaviest first, then by name. A round per level writes the level."""
    kids = _whole(tree).select(F.col("src").alias("id"), F.col("dst").alias("kid"), F.col("rel").alias("kid_rel"), F.col("weight").cast("double").alias("weight"))
    name = tree.schema["dst"].dataType.simpleString()
    first = roots.where("id is not null").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("rel"), F.array().cast(f"array<struct<w: double, name: {name}>>").alias("path"))
    rows = Rounds(first, "rows")
    while not rows.last.isEmpty():
        place = F.concat("path", F.array(F.struct((-F.col("weight")).alias("w"), F.col("kid").alias("name"))))
        fresh = ~F.exists("path", lambda p: p["name"] == F.col("kid")) & (F.col("kid") != F.col("root"))
        rows.add(rows.last.join(kids, "id").where(fresh).select("root", F.col("kid").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("kid_rel").alias("rel"), place.alias("path")))
    return rows.all


def attributed_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, coverage, feat, importance) with weighted_out, the sum of the weights of their edges."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("weighted_out"))
    return nodes.join(out, "id", "left").withColumn("weighted_out", F.coalesce("weighted_out", F.lit(0.0)))
