"""Mixing sources to target weights by pivotal dependent rounding.

A document is copied target / source size times on average: a whole part, and a fraction that must be rounded. Fractions
are paired; mass in words moves at random from one document of a pair to the other until one fraction is 0 or 1, which
keeps the pair's words and each document's expectation. A block of documents of one source, from long to short, leaves
one open fraction at most. The open ones of the blocks meet in larger blocks, in a reduction tree, until one is left per
source: of that one document the fraction of its words is taken, from its start, so that a source meets its target.
"""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, running, slices, write_shared
from .repeats import row_id

BLOCK_ROWS = 2_000
FAN_IN = 1_000
MOST_COPIES = 3
EQUAL_ROWS = 1_000  # equal rows that are numbered in one place, and a ten-thousandth of all rows more
SEED = 8
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def word_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, source, size): words of each text, null 0; counted over whole batches at once. rid: row_id() of the text."""
    import pyarrow as pa

    def rows(batches):
        for b in slices(batches):
            texts = [t or b"" for t in b.column(3).to_pylist()]
            data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
            space = _SPACE[data]
            ends = np.zeros(len(data) + 1, np.int64)
            np.cumsum(space[1:] & ~space[:-1], out=ends[2 : len(data) + 1])
            edge = np.cumsum([len(t) + 1 for t in texts])
            sizes = np.diff(ends[np.concatenate(([0], edge))]) if texts else edge
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64())], ["doc_id", "rid", "source", "size"])

    columns = (F.col(id_col).cast("bigint").alias("doc_id"), row_id(F.col(text_col)).alias("rid"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text"))
    return docs.select(*columns).mapInArrow(rows, "doc_id bigint, rid bigint, source string, size bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, nth, entries) of sizes(source, size, n): one row per source, n rows of a size counting each.

    In order of source_size / weight, sources are full (target = most * source_size) while the words that are left, shared
    out by weight among the sources that are left, would exceed what they hold. Sources without words get 0. Sources may
    be many: ranks and running sums come from range partitions, of which one row each is put together.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("entries"))
    by = running(by, [F.col("source").asc_nulls_last()], {}).withColumnRenamed("place", "nth")
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    by = write_shared(running(by, [(F.col("source_size") / F.col("w")).asc(), F.col("nth").asc()], {"before": F.col("source_size"), "w_before": F.col("w")}), "sources")
    total, w = by.agg(F.sum("source_size"), F.sum("w")).first()
    share = (F.lit(total or 0) - most * F.col("before")) / (F.lit(w or 0.0) - F.col("w_before"))
    is_open = share * F.col("w") <= most * F.col("source_size")
    first = by.select("place", share.alias("share"), is_open.alias("open")).where("open").agg(F.min(F.struct("place", "share")).alias("f")).select("f.*").first()
    place, level = (first["place"], first["share"]) if first and first["place"] is not None else (2**62, 0.0)
    target = F.when(F.col("place") < place, (most * F.col("source_size")).cast("double")).otherwise(F.lit(float(level)) * F.col("w"))
    return by.select("source", "source_size", target.alias("target"), "nth", "entries")


def settle(size: list[int], x: list[float], key: str) -> list[float]:
    """Round the fractions x (documents from long to short) pairwise; at most one stays open. Draws depend on the key alone."""
    rnd = random.Random(zlib.crc32(key.encode()) + SEED)
    carry = -1
    for i in range(len(x)):
        if not 0 < x[i] < 1:
            continue
        if carry < 0:
            carry = i
            continue
        a, b = size[carry], size[i]
        up = min((1 - x[carry]) * a, x[i] * b)  # words that can move to the first
        down = min(x[carry] * a, (1 - x[i]) * b)
        move = up if rnd.random() * (up + down) < down else -down
        x[carry] += move / a
        x[i] -= move / b
        for k in (carry, i):
            if x[k] < 1e-9 or x[k] > 1 - 1e-9:
                x[k] = float(round(x[k]))
        carry = next((k for k in (carry, i) if 0 < x[k] < 1), -1)
    return x


def _round(df: DataFrame) -> DataFrame:
    """settle() each block; a block's rows come to one task, in bounded number. Arrow keeps ids as they are, nulls too."""

    def block(keys, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("rid", "ascending")], null_placement="at_end"))
        x = settle(table["size"].to_pylist(), table["x"].to_pylist(), "|".join(str(k.as_py()) for k in keys))
        return table.set_column(table.schema.get_field_index("x"), "x", pa.array(x, pa.float64()))

    return df.groupBy("nth", "level", "block").applyInArrow(block, df.schema)


def _rows(entries: DataFrame, chunk: int = 1_000) -> DataFrame:
    """n rows for each entry, numbered by i. An entry of very many rows is made in parts, by many tasks."""
    parts = F.floor((F.col("n") - 1) / chunk).cast("int")
    few = entries.where(F.col("n") <= chunk).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    many = entries.where(F.col("n") > chunk).withColumn("c", F.explode(F.sequence(F.lit(0), parts))).repartition("doc_id", "rid", "c")
    begin = F.col("c").cast("bigint") * chunk
    return few.unionByName(many.withColumn("i", F.explode(F.sequence(begin, F.least(begin + chunk, F.col("n")) - 1))).drop("c"))


def entries(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, rid, source, size, n, source_size, target, whole, up, x): one row for each distinct row of docs, which stands n times.

    Each of the n is copied `whole` times, the first `up` of them once more, and the next to the share x: 1 or 0, but for
    the one open row of a source.
    """
    sizes = write_shared(word_counts(docs, id_col, source_col, text_col).groupBy("source", "doc_id", "rid", "size").agg(F.count("*").alias("n")), "sizes")
    goals = write_shared(targets(sizes, weights), "goals")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    blocks = F.ceil(F.col("entries") / BLOCK_ROWS).cast("bigint")
    rows = sizes.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("doc_id", "rid", "d.source", "size", "n", "source_size", "target", "nth", F.pmod(F.xxhash64("doc_id", "rid"), blocks).alias("block"), rate.alias("rate"))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-9))
    rows = rows.withColumn("x", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).otherwise(0.0) * F.col("n")).drop("rate")
    rows = rows.withColumn("up", F.floor(F.col("x") + 1e-9)).withColumn("x", F.greatest(F.col("x") - F.col("up"), F.lit(0.0))).withColumn("level", F.lit(0))
    is_open = (F.col("x") > 0) & (F.col("x") < 1)
    rows = write_shared(rows, "fractions")
    results, done = [rows.where(~is_open)], write_shared(_round(rows.where(is_open)), "round")
    most = goals.agg(F.max(blocks)).first()[0] or 1
    for level in range(1, 1 + math.ceil(math.log(most, FAN_IN)) if most > 1 else 1):
        results.append(done.where(~is_open))
        left = done.where(is_open).withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("level", F.lit(level))
        done = write_shared(_round(left), "round")
    out = done
    for df in results:
        out = out.unionByName(df)
    return out.drop("nth", "block", "level")


def _taken(df: DataFrame) -> DataFrame:
    """Adds copies, part and taken to entries of which i numbers the equal rows from 0."""
    has_words, own = F.col("size") > 0, (F.col("x") > 0) & (F.col("x") < 1) & (F.col("i") == F.col("up"))
    df = df.withColumn("copies", F.when(has_words, F.col("whole") + F.when(F.col("i") < F.col("up") + F.floor("x"), 1).otherwise(0)).otherwise(0).cast("bigint"))
    df = df.withColumn("part", F.when(has_words & own, F.round(F.col("x") * F.col("size"))).otherwise(0).cast("bigint"))
    return df.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part, taken) of every row: `copies` whole copies and the first `part` words.

    A null source is a source, the last; null and wordless texts have size 0 and are never copied; a null id is no
    matter. Equal rows (id, source, text) are alike: their fractions add up, so that all but one of them are whole, and
    only that one is rounded; each counts for itself. No rows: no rows. Other columns are not looked at. Reruns draw
    alike, for draws depend on ids, sources and texts only.
    """
    rows = _taken(_rows(entries(docs, id_col, source_col, text_col, weights)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "part", "taken")


def _numbered(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with found(*key, n, ...), one per key and n the number of its rows, and numbered by i from 0 within each key.

    Rows of a key meet in one place only while they are few. Keys that more than EQUAL_ROWS and a ten-thousandth of all
    rows share, so fewer than 10,000, are broadcast; their rows are written in pieces of EQUAL_ROWS at most, and a piece
    is numbered from the sum of those before it.
    """
    total, most = found.agg(F.sum("n"), F.max("n")).first()
    bound = EQUAL_ROWS + (total or 0) // 10_000
    inside = lambda *by: F.row_number().over(Window.partitionBy(*key, *by).orderBy("_rid")) - 1
    if (most or 0) <= bound:
        return rows.join(found, key).withColumn("i", inside())
    hot = F.broadcast(found.where(F.col("n") > bound))
    few = rows.join(hot.select(*key), key, "left_anti").join(found.where(F.col("n") <= bound), key).withColumn("i", inside())
    many = rows.join(hot.select(*key), key, "left_semi").withColumn("_piece", F.floor(F.monotonically_increasing_id() / EQUAL_ROWS))
    many = write_shared(many, "equal_rows")  # so that pieces stay as they are
    pieces = running(many.groupBy(*key, "_piece").agg(F.count("*").alias("_in")), [F.col(c) for c in (*key, "_piece")], {"_from": F.col("_in")}).drop("place", "_in")
    pieces = write_shared(pieces, "pieces")
    begin = F.broadcast(pieces.groupBy(*key).agg(F.min("_from").alias("_begin")))
    many = many.join(pieces, [*key, "_piece"]).withColumn("i", inside("_piece")).join(begin, key).withColumn("i", F.col("i") + F.col("_from") - F.col("_begin"))
    return few.unionByName(many.drop("_piece", "_from", "_begin").join(hot, key))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with what the mix takes of each row: size, source_size, target, copies, part, taken and part_text, the first `part` words (null if none).

    Every row stays; columns of docs with one of these names are replaced. Equal rows are dealt out in pieces (see _numbered).
    """
    named = lambda df, doc_id, rid: df.withColumns({"_no_id": doc_id.isNull(), "_id": F.coalesce(doc_id.cast("bigint"), F.lit(0).cast("bigint")), "_rid": rid, "_source": F.struct(F.col("source"))})
    key = ["_no_id", "_id", "_rid", "_source"]
    new = ["size", "source_size", "target", "copies", "part", "taken", "part_text"]
    kept = [c for c in docs.columns if c not in new]
    inner = {c: f"_own_{c}" for c in kept if c in ("n", "i", "whole", "up", "x")}
    found = named(entries(docs), F.col("doc_id"), F.col("rid")).select(*key, "n", "size", "source_size", "target", "whole", "up", "x")
    rows = _taken(_numbered(named(docs.select(*kept), F.col("doc_id"), row_id(F.col("text"))).withColumnsRenamed(inner), found, key))
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    rows = rows.withColumn("part_text", F.when(F.col("part") > 0, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")))
    return rows.select(*(F.col(inner.get(c, c)).alias(c) for c in kept), *new)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "part")
