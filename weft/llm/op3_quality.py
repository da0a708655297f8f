"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned embeddings; learned filters of five bytes slide over the whole text. Their responses (ReLU) are
max-pooled over overlapping chunks that cover the text, and the mean and the maximum of the chunks' values are combined
into one probability. It is fitted on whole texts of a bounded sample of labelled rows and applied to every byte of every
text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, read_table, slices

THRESHOLD = 0.3
SAMPLE_ROWS = 4000  # labelled rows learned from, at most: those of the least hash of the id
SAMPLE_BYTES = 64 << 20  # bytes of their texts, at most: in that order, a row is taken if its whole text still fits
BLOCK, CHUNK_BLOCKS, CHUNK_STEP = 64, 8, 7  # chunks of 512 bytes, one every 448
EMBED, WIDTH, FILTERS = 4, 5, 16
_PIECE_BLOCKS = 1 << 11
_PIECE_CHUNKS = 256


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, row of each chunk, label of each row): all chunks of the whole texts of at most most_rows rows and most_bytes bytes.

    Rows are those of docs that have a label 0 or 1 (the least, if an id has several), in order of the hash of their id.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(known), "doc_id")  # most_rows rows
    rows = rows.select("doc_id", "y", F.xxhash64("text").alias("rid"), "text", F.octet_length("text").alias("size")).dropDuplicates(["doc_id", "rid"])
    taken, left = [], most_bytes
    for r in rows.select("doc_id", "rid", "size").orderBy(F.xxhash64("doc_id"), "doc_id", "rid").limit(most_rows).collect():
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["doc_id"], r["rid"]))
    picked = docs.sparkSession.createDataFrame(taken, "doc_id bigint, rid bigint")
    got = sorted(rows.join(F.broadcast(picked), ["doc_id", "rid"]).select("doc_id", "rid", "y", "text").collect(), key=lambda r: (r["doc_id"], r["rid"]))
    size, step = BLOCK * CHUNK_BLOCKS, BLOCK * CHUNK_STEP
    counts = np.array([max(1, -(-(len(r["text"]) - (size - step)) // step)) for r in got], np.int64)
    chunks = np.zeros((counts.sum(), size), np.uint8)
    i = 0
    for r, n in zip(got, counts.tolist(), strict=True):
        whole = np.zeros((n - 1) * step + size, np.uint8)
        whole[: len(r["text"])] = np.frombuffer(bytes(r["text"]), np.uint8)
        chunks[i : i + n] = np.lib.stride_tricks.sliding_window_view(whole, size)[::step]
        i += n
    return chunks, np.repeat(np.arange(len(got)), counts), np.array([r["y"] for r in got], np.float32)


def start(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def _responses(model: dict, codes: np.ndarray) -> np.ndarray:
    """Filter responses at every place where WIDTH bytes begin; codes: (..., bytes)."""
    e = model["embed"][codes]
    n = codes.shape[-1] - WIDTH + 1
    return np.concatenate([e[..., j : j + n, :] for j in range(WIDTH)], axis=-1) @ model["filters"]


def _peaks(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest response of each filter in each chunk, where it is), a few chunks at a time, so that memory is bounded."""
    most, where = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for at in range(0, len(x), _PIECE_CHUNKS):
        z = _responses(model, x[at : at + _PIECE_CHUNKS])
        where[at : at + _PIECE_CHUNKS] = best = z.argmax(axis=1)
        most[at : at + _PIECE_CHUNKS] = np.take_along_axis(z, best[:, None, :], 1)[:, 0, :]
    return most, where


def gradients(model: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over rows of `sizes` chunks each, which stand in x one after another, by each weight."""
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(y)), sizes)
    peaks, where = _peaks(model, x)
    pooled = np.maximum(peaks + model["bias"], 0)
    mean, most = np.add.reduceat(pooled, begin) / sizes[:, None], np.maximum.reduceat(pooled, begin)
    features = np.concatenate([mean, most], axis=1)
    p = 1 / (1 + np.exp(-(features @ model["out"] + model["out_bias"])))
    error = ((p - y) / len(y)).astype(np.float32)
    back = error[:, None] * model["out"]
    d_pooled = back[own, :FILTERS] / sizes[own, None] + back[own, FILTERS:] * (pooled == most[own])
    d_pooled = d_pooled * (pooled > 0)
    grads = {"out": features.T @ error, "out_bias": error.sum(keepdims=True), "bias": d_pooled.sum(axis=0), "filters": np.zeros_like(model["filters"]), "embed": np.zeros_like(model["embed"])}
    for j in range(WIDTH):
        codes = np.take_along_axis(x, where + j, 1)
        part = slice(j * EMBED, (j + 1) * EMBED)
        grads["filters"][part] = np.einsum("cfe,cf->ef", model["embed"][codes], d_pooled)
        np.add.at(grads["embed"], codes, d_pooled[:, :, None] * model["filters"][part].T[None])
    return grads


def fit(chunks: np.ndarray, row: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 48, rate: float = 0.01, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights that minimise the logistic loss (Adam, at least `steps` batches and four rounds). With no rows, or labels of one kind only, the bias alone is set."""
    model = start(seed)
    if len(y):
        share = float(np.clip(y.mean(), 0.01, 0.99))
        model["out_bias"][0] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        model["out"][:] = 0
        return model
    rng, first = np.random.default_rng(seed), np.searchsorted(row, np.arange(len(y) + 1))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for _ in range(max(4, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            take = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            sizes = first[docs + 1] - first[docs]
            grads = gradients(model, chunks[take], sizes, y[docs])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def probabilities(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 of each text, from all its bytes; an empty text is one block of zeros. Memory is bounded: long texts are worked through in pieces."""
    tail = WIDTH - 1
    blocks = [-(-(len(t) + tail) // BLOCK) for t in texts]
    most = np.zeros((sum(blocks) + 1, FILTERS), np.float32)

    def respond(data: bytes, n: int) -> np.ndarray:  # n blocks and the first bytes of the next
        codes = np.frombuffer(data.ljust(n * BLOCK + tail, b"\0"), np.uint8)
        return np.maximum(_responses(model, codes).reshape(n, BLOCK, FILTERS).max(axis=1) + model["bias"], 0)

    at, held, waiting = 0, [], 0
    for text, n in zip(texts, blocks, strict=True):
        text = b"\0" * tail + text  # so that no filter sees two texts
        if n > 256:
            if waiting:
                most[at : at + waiting] = respond(b"".join(held), waiting)
                at, held, waiting = at + waiting, [], 0
            for s in range(0, n, _PIECE_BLOCKS):
                k = min(_PIECE_BLOCKS, n - s)
                most[at : at + k] = respond(text[s * BLOCK : (s + k) * BLOCK + tail], k)
                at += k
            continue
        held.append(text.ljust(n * BLOCK, b"\0"))
        waiting += n
        if waiting >= 1024:
            most[at : at + waiting] = respond(b"".join(held), waiting)
            at, held, waiting = at + waiting, [], 0
    if waiting:
        most[at : at + waiting] = respond(b"".join(held), waiting)
    blocks = np.array(blocks, np.int64)
    begin = np.cumsum(blocks) - blocks
    chunks = np.maximum(1, -(-(blocks - (CHUNK_BLOCKS - CHUNK_STEP)) // CHUNK_STEP))
    own = np.repeat(np.arange(len(texts)), chunks)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    s = begin[own] + nth * CHUNK_STEP
    e = np.minimum(s + CHUNK_BLOCKS, begin[own] + blocks[own])
    pooled = np.maximum.reduceat(most, np.stack([s, e], 1).ravel())[::2]
    first = np.cumsum(chunks) - chunks
    features = np.concatenate([np.add.reduceat(pooled, first) / chunks[:, None], np.maximum.reduceat(pooled, first)], axis=1)
    return 1 / (1 + np.exp(-(features @ model["out"] + model["out_bias"]).astype(np.float64)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its text alone. Null counts as empty. Repeated rows come back as often as they came; other columns are not looked at."""
    import pyarrow as pa

    def rows(batches):
        for b in slices(batches, 256):
            texts = [t or b"" for t in b.column(1).to_pylist()]
            p = probabilities(model, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(rows, "doc_id bigint, score double")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fitted on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    learned = id_bucket(F.col("doc_id"), 5) > 0
    return fit(*sample(docs.where(learned), labels.where(learned)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    import pyarrow as pa

    model = train(docs, labels)
    at = docs.columns.index("text")

    def rows(batches):
        for b in slices(batches, 256):
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            p = probabilities(model, texts)
            yield b.filter(pa.array(p >= THRESHOLD))

    return docs.mapInArrow(rows, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
