"""Token tables: (doc_id, sent, tok, head, text, lemma, pos_tag, dep); a sentence's root is its own head.

What looks at a sentence's tree works on sentence rows: parse() gathers a sentence's tokens in one row, by the only shuffle
(rows that have them already, with a column t, are not shuffled), and labels each with its head, its children and the interval of
its subtree, in batches; arrays and lambdas do the rest. Tokens with a null doc_id or sent make sentences like any others; of tokens repeated
under one tok each stands. Heads that are no token of the sentence count as none. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

KEY = ["doc_id", "sent"]
NOMINAL = ("NOUN", "PROPN")
CHUNK_TAGS = ("DET", "ADJ", "NUM", *NOMINAL)


def tokens_from_text(sents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A row per word of sents(doc_id, pos, s): lower-case lemma, part of speech from lexicon(lemma, pos_tag), else NOUN."""
    rows = sents.select("doc_id", F.col("pos").alias("sent"), F.posexplode(T.words(F.col("s"))).alias("tok", "text")).withColumn("lemma", F.lower("text"))
    return rows.join(lexicon.select("lemma", "pos_tag"), "lemma", "left").select("doc_id", "sent", "tok", "text", "lemma", F.coalesce("pos_tag", F.lit("NOUN")).alias("pos_tag"))


def at(t: Column, tok: Column) -> Column:
    """The token of a sentence t by its number: where tokens are numbered without gaps it stands at its place."""
    guess = F.get(t, tok - F.get(t, F.lit(0))["tok"])
    return F.when(guess["tok"] == tok, guess).otherwise(F.get(F.filter(t, lambda x: x["tok"] == tok), F.lit(0)))


def sentence_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, t): a row per sentence, t its tokens in order as structs (tok, head, text, lemma, pos_tag, dep). Rows that are so already stay."""
    if "t" in tokens.columns:
        return tokens.select(*KEY, "t")
    return tokens.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tok", "head", "text", "lemma", "pos_tag", "dep"))).alias("t"))


def _trees(start: np.ndarray, tok: np.ndarray, head: np.ndarray, verb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Labels of the trees of many sentences, end to end: (lo, hi, first, size, verb) of each token's subtree, in places, then
    (up, nth, kids, degree): the place of its head (-1 for none), that of the token that the walk meets at its place, the places
    of all tokens' children, end to end, and how many each has.

    start: where each sentence begins, and the end; tok and head: numbers, in order in a sentence, head -1 for none that can be a token's;
    verb: is it one? Levels are gone through from the deepest up, so time and memory go with the tokens and the levels.
    """
    n, sent = len(tok), np.repeat(np.arange(len(start) - 1), np.diff(start))
    wide = int(tok.max(initial=0)) + 2
    key = sent * wide + tok
    asked = sent * wide + np.where((head >= 0) & (head < wide), head, wide - 1)
    found = np.minimum(np.searchsorted(key, asked), max(n - 1, 0))
    here = np.arange(n)
    heads = np.where(key[found] == asked, found, -1) if n else found
    up = np.where(heads != here, heads, -1)
    child = np.flatnonzero((heads >= 0) & (tok != head) & (tok > 0))
    child = child[np.argsort(asked[child], kind="stable")]
    begin, degree = np.searchsorted(asked[child], key), np.searchsorted(asked[child], key, side="right")
    degree -= begin
    kids = child[np.repeat(begin - np.cumsum(degree) + degree, degree) + np.arange(int(degree.sum()))]

    far = np.where(up < 0, here, up)
    for _ in range(int(np.diff(start).max(initial=1)).bit_length()):
        far = far[far]
    same: dict[int, int] = {}  # tokens on a cycle of heads, with its first one: they share a subtree
    for x in np.unique(far[up[far] >= 0]).tolist():
        ring = [x]
        while x not in same and (y := int(up[ring[-1]])) != x:
            ring.append(y)
        same |= dict.fromkeys(ring, min(ring)) if x not in same else {}
    for x, low in same.items():
        up[x] = -1 if x == low else low

    jump, depth = np.where(up < 0, here, up), (up >= 0).astype(np.int64)
    while (more := depth[jump]).any():
        depth, jump = depth + more, jump[jump]
    lo, hi, size, first_verb = here.copy(), here.copy(), np.ones(n, np.int64), np.where(verb, here, n)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[: int(depth.max(initial=0))]:
        at = up[level]
        np.minimum.at(lo, at, lo[level])
        np.maximum.at(hi, at, hi[level])
        np.minimum.at(first_verb, at, first_verb[level])
        np.add.at(size, at, size[level])

    # a token's place in the walk through its tree: behind its head and that head's earlier children
    order = np.lexsort((here, up))
    total = np.concatenate(([0], np.cumsum(size[order])))[:-1]
    group = up[order]
    begins = np.concatenate(([True], group[1:] != group[:-1])) if n else np.empty(0, bool)
    walk = np.zeros(n, np.int64)
    walk[order] = total - np.repeat(total[begins], np.diff(np.concatenate((np.flatnonzero(begins), [n])))) + (group >= 0)
    jump, behind = np.where(up < 0, here, up), np.where(up < 0, 0, walk)
    while (more := behind[jump]).any():
        behind, jump = behind + more, jump[jump]
    walk = behind + np.where(up[jump] < 0, walk[jump], 0)
    nth = np.empty(n, np.int64)
    nth[walk] = here
    for x, low in same.items():
        lo[x], hi[x], size[x], first_verb[x], walk[x] = lo[low], hi[low], size[low], first_verb[low], walk[low]
    return lo, hi, walk, size, first_verb, heads, nth, kids, degree


def trees_of(t) -> tuple[np.ndarray, list, tuple[np.ndarray, ...]]:
    """Of an Arrow array of sentences: where each begins in the tokens end to end, and the end; the tokens' columns; _trees() of them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    start = np.concatenate(([0], np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False)))).astype(np.int64)
    columns = t.flatten().flatten()
    tok, head = (pc.fill_null(c.cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in columns[:2])
    no_tok, no_head = (np.asarray(c.is_null()) for c in columns[:2])
    least = int(tok.min(where=~no_tok, initial=0)) - 1
    tok, head = np.where(no_tok, 0, tok - least), np.where(no_head | (head <= least), -1, head - least)  # numbers from 1; nulls come first
    return start, columns, _trees(start, tok, head, np.asarray(pc.fill_null(pc.equal(columns[4], "VERB"), False)))


def parse(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, t): a row per sentence; t has its tokens in order, with the extents of their subtrees.

    Structs (tok, head, text, lemma, pos_tag, dep, left, right, lo, hi, first, size, up, nth, kids, verb): the least and the
    greatest token number and place of the subtree, its interval [first, first + size) in a walk through the trees, the place of
    the head (null for none), that of the token which the walk meets nth, where this one stands, those of the children in order,
    and the lemma of the subtree's first verb. One shuffle, by sentence, or none if tokens are sentence_rows(); the size goes with
    the tokens, however deep a tree is. Words of subtrees: subtree(). Tokens on a cycle of heads have one subtree, the cycle's.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = sentence_rows(tokens)
    fields = rows.schema["t"].dataType.elementType.fields
    number = fields[0].dataType
    more = [*(S.StructField(x, number) for x in ("left", "right")), *(S.StructField(x, S.IntegerType()) for x in ("lo", "hi", "first", "size", "up", "nth")), S.StructField("kids", S.ArrayType(S.IntegerType())), S.StructField("verb", S.StringType())]
    schema = S.StructType([rows.schema["doc_id"], rows.schema["sent"], S.StructField("t", S.ArrayType(S.StructType([*fields, *more])))])

    def labelled(batches):
        for b in batches:
            start, columns, (lo, hi, walk, size, verb, up, nth, kids, degree) = trees_of(b.column(2))
            begin = np.repeat(start[:-1], np.diff(start))
            verbs = columns[3].take(pa.array(verb, mask=verb == len(verb)))
            places = [pa.array(x - begin, pa.int32()) for x in (lo, hi, walk)]
            near = [pa.array(up - begin, pa.int32(), mask=up < 0), pa.array(nth - begin, pa.int32())]
            below = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(degree))), pa.int32()), pa.array(kids - np.repeat(begin, degree), pa.int32()))
            new = [columns[0].take(pa.array(lo)), columns[0].take(pa.array(hi)), *places, pa.array(size, pa.int32()), *near, below, verbs]
            structs = pa.StructArray.from_arrays([*columns, *new], names=[f.name for f in (*fields, *more)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(start, pa.int32()), structs)], ["doc_id", "sent", "t"])

    return rows.mapInArrow(labelled, schema)


def inside(k: Column, x: Column) -> Column:
    """Is token k in the subtree of x?"""
    return (k["first"] >= x["first"]) & (k["first"] < x["first"] + x["size"])


def subtree_places(t: Column, x: Column) -> Column:
    """The places of the tokens of x's subtree, in the order of the walk."""
    return F.transform(F.slice(t, x["first"] + 1, x["size"]), lambda k: k["nth"])


def tokens_at(t: Column, places: Column) -> Column:
    """The tokens at these places, in order."""
    return F.transform(F.array_sort(places), lambda i: F.get(t, i))


def subtree(t: Column, x: Column) -> Column:
    """The tokens of x's subtree, in order: a slice of the sentence unless other words stand between, else met by the walk. Null for a null x."""
    return T.let(x, lambda x: F.when(x["hi"] - x["lo"] + 1 == x["size"], F.slice(t, x["lo"] + 1, x["size"])).when(x.isNotNull(), tokens_at(t, subtree_places(t, x))))


def subtree_text(t: Column, x: Column) -> Column:
    return F.array_join(F.transform(subtree(t, x), lambda k: k["text"]), " ")


def subtree_extents(parsed: DataFrame) -> DataFrame:
    """(doc_id, sent, tok, left, right, size): extent of each token's subtree; parsed: parse(). As large as the tokens."""
    return parsed.select(*KEY, F.inline("t")).select(*KEY, "tok", "left", "right", "size")


def subtree_spans(parsed: DataFrame) -> DataFrame:
    """(doc_id, sent, tok, left, right, text): extent and text of each token's subtree; parsed: parse(). As large as all subtrees together."""
    spans = F.transform("t", lambda x: F.struct(x["tok"].alias("tok"), x["left"].alias("left"), x["right"].alias("right"), subtree_text(F.col("t"), x).alias("text")))
    return parsed.select(*KEY, F.inline(spans))


def chunks_of(t: Column) -> Column:
    """The noun chunks of a sentence t, in order, as structs (start, head_tok, chunk, head_lemma, head), head the token: maximal runs of CHUNK_TAGS without a gap in tok, up to their last noun."""

    def upto_noun(run: Column) -> Column:
        last = F.array_max(F.transform(run, lambda x, i: F.when(x["pos_tag"].isin(*NOMINAL), i + 1)))
        return T.let(last, lambda n: F.when(n.isNotNull(), F.slice(run, F.lit(1), n)))

    def runs(own: Column) -> Column:
        begins = F.array_compact(F.transform(own, lambda x, i: F.when((i == 0) | (x["tok"] != F.get(own, i - 1)["tok"] + 1), i)))
        return T.let(begins, lambda at: F.transform(at, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i)))

    own = F.filter(t, lambda x: x["pos_tag"].isin(*CHUNK_TAGS) & x["tok"].isNotNull())
    found = F.array_compact(F.transform(T.let(own, runs), lambda run: upto_noun(run)))

    def chunk(words: Column) -> Column:
        head = F.element_at(words, -1)
        return F.struct(F.get(words, F.lit(0))["tok"].alias("start"), head["tok"].alias("head_tok"), F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("chunk"), head["lemma"].alias("head_lemma"), head.alias("head"))

    return F.transform(found, chunk)


def noun_chunks(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, start, head_tok, chunk, head_lemma): maximal runs of DET, ADJ, NUM, NOUN, PROPN, up to their last noun. One shuffle, none for sentence rows."""
    rows = tokens
    if "t" not in tokens.columns:
        rows = tokens.where(F.col("pos_tag").isin(*CHUNK_TAGS)).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tok", "text", "lemma", "pos_tag"))).alias("t"))
    return rows.select(*KEY, F.inline(chunks_of(F.col("t")))).select(*KEY, "head_tok", "start", "chunk", "head_lemma")


def ordered_text(text: str = "text", order: str = "tok", sep: str = " "):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def verb_lemmas(tokens: DataFrame) -> DataFrame:
    return tokens.where("pos_tag = 'VERB'").select(*KEY, "tok", "lemma")


def gazetteer_entities(tokens: DataFrame, gazetteer: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, sent, tok, entity, label): n-grams of up to three words that gazetteer(entity, label) lists."""
    order = Window.partitionBy(*KEY).orderBy("tok")
    ahead = [F.col("lemma")] + [F.lead("lemma", k).over(order) for k in range(1, most)]
    grams = tokens.select(*KEY, "tok", *(x.alias(f"w{k}") for k, x in enumerate(ahead)))
    spans = F.array(*(F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *(F.col(f"w{j}") for j in range(k + 1)))) for k in range(most)))
    return grams.select(*KEY, "tok", F.explode(F.array_compact(spans)).alias("entity")).join(gazetteer, "entity").select(*KEY, "tok", "entity", "label")


def word_nodes(tokens: DataFrame) -> DataFrame:
    """(lemma, freq, pos): pos maps each part of speech to its count."""
    by = tokens.groupBy("lemma", "pos_tag").agg(F.count("*").alias("n"))
    return by.groupBy("lemma").agg(F.sum("n").alias("freq"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos_tag", "n")))).alias("pos"))


def word_edges(tokens: DataFrame, window: int = 1) -> DataFrame:
    """(a, b, w_coocc, w_dep, weight), a < b: lemmas up to `window` places apart in a sentence, and linked by head.

    Pairs are made inside sentence rows, so beside the shuffle by sentence (none if tokens are sentence_rows()) only counts are shuffled.
    """
    rows = sentence_rows(tokens)

    def ahead(k: int) -> Column:
        return F.transform("t", lambda x, i: F.struct(x["lemma"].alias("a"), F.get(F.col("t"), i + k)["lemma"].alias("b"), F.lit(1).alias("c"), F.lit(0).alias("d")))

    deps = F.transform(F.filter("t", lambda x: x["head"] != x["tok"]), lambda x: F.struct(x["lemma"].alias("a"), at(F.col("t"), x["head"])["lemma"].alias("b"), F.lit(0).alias("c"), F.lit(1).alias("d")))
    pairs = rows.select(F.inline(F.concat(*map(ahead, range(1, window + 1)), deps))).where("a <> b")
    by = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return by.agg(F.sum("c").alias("w_coocc"), F.sum("d").alias("w_dep")).withColumn("weight", F.col("w_coocc") + F.col("w_dep"))  # each pair is of one kind


def root_by_frequency(chunks: DataFrame) -> DataFrame:
    """(doc_id, root): the most common chunk head of a document; ties go to the first seen."""
    by = chunks.groupBy("doc_id", "head_lemma").agg(F.count("*").alias("n"), F.min(F.struct("sent", "start")).alias("first"))
    return by.groupBy("doc_id").agg(F.max_by("head_lemma", F.struct("n", -F.col("first.sent"), -F.col("first.start"))).alias("root"))


def token_graph(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes s{sent}_t{tok} per token and edges head -> child of kind dep."""
    name = lambda t: F.concat(F.lit("s"), "sent", F.lit("_t"), t)
    nodes = tokens.select("doc_id", name("tok").alias("id"), "text", "lemma", "pos_tag", "dep", (F.col("head") == F.col("tok")).alias("is_root"), F.col("sent").alias("sent_id"))
    edges = tokens.where("head <> tok").select("doc_id", name("head").alias("source"), name("tok").alias("target"), F.lit("dep").alias("kind"))
    return nodes, edges
