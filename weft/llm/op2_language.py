"""Language identification with hyperdimensional profiles.

Every letter, whatever its script, has a random vector of +1 and -1 of its own, drawn from its code point. An n-gram's vector binds its letters' vectors, each permuted (rotated) by
its place, by elementwise product; a text's vector bundles (adds up) the vectors of its n-grams. A language's prototype
is the sum of the unit vectors of its training texts. A text is given the language whose prototype has the highest cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, read_table, slices, write_shared

DIMENSIONS = 1024
UNKNOWN = "und"
MOST_LANGUAGES = 10_000  # of which prototypes come to the driver
_PIECE = 1 << 20
_GRAMS = 1 << 13
_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """Symbol of each code point: itself for letters (str.isalpha), 0 for all else; made once in a worker."""
    global _letters
    if _letters is None:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _letters = np.where(letters, np.arange(0x110000), 0)
    return _letters


def letter_vector(symbol: int) -> np.ndarray:
    """The symbol's vector of +1 and -1. Some thousands are remembered."""
    v = _vectors.get(symbol)
    if v is None:
        if len(_vectors) >= 20_000:
            _vectors.clear()
        _vectors[symbol] = v = np.random.default_rng((2, symbol)).choice(np.array([-1, 1], np.int8), DIMENSIONS)
    return v


def _gram_vectors(v: np.ndarray, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    return (np.roll(v, 2, axis=1)[first] * np.roll(v, 1, axis=1)[second] * v[third]).astype(np.float32)


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(vector of each text, does it have a letter). Works through the texts in pieces of bounded size."""
    table = _symbols()
    bundled, letters = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        symbols = np.concatenate([c for _, c in held])
        who = np.repeat(np.arange(len(held)), [len(c) - 2 for _, c in held])
        inside = np.ones(len(symbols), bool)  # starts of grams
        ends = np.cumsum([len(c) for _, c in held])
        inside[ends - 1] = inside[ends - 2] = False
        alphabet = np.flatnonzero(np.bincount(symbols))
        place = np.zeros(alphabet[-1] + 1, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        symbols, a = place[symbols], len(alphabet)
        start = np.flatnonzero(inside)
        codes = (symbols[start] * a + symbols[start + 1]) * a + symbols[start + 2]
        if a**3 <= 1 << 22:
            present = np.flatnonzero(np.bincount(codes))
            rank = np.zeros(a**3, np.int64)
            rank[present] = np.arange(len(present))
            nth = rank[codes]
        else:
            present, nth = np.unique(codes, return_inverse=True)
        v = np.stack([letter_vector(c) for c in alphabet.tolist()])
        rows = np.array([i for i, _ in held])
        for at in range(0, len(present), _GRAMS):  # as many grams' vectors at a time
            some = present[at : at + _GRAMS]
            mine = (nth >= at) & (nth < at + len(some)) if len(present) > _GRAMS else slice(None)
            counts = np.bincount(who[mine] * len(some) + nth[mine] - at, minlength=len(held) * len(some))
            sums = counts.reshape(len(held), -1).astype(np.float32) @ _gram_vectors(v, some // (a * a), some // a % a, some % a)
            np.add.at(bundled, rows, sums)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.zeros(len(points) + 2, np.int64)
        symbols[1:-1] = table[points]
        letters[i] = symbols.any()
        if not letters[i]:
            continue
        symbols = symbols[(symbols > 0) | np.concatenate(([True], symbols[:-1] > 0))]
        for at in range(0, len(symbols) - 2, _PIECE):
            held.append((i, symbols[at : at + _PIECE + 2]))
            size += len(held[-1][1])
            if size >= _PIECE:
                flush()
                size = 0
    if held:
        flush()
    return bundled, letters


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Unit prototype of each language. Rows with a null language or a text without letters teach nothing.

    Each task sums its texts' vectors by language; the sums meet in a grouped sum. What comes to the driver is
    DIMENSIONS numbers for each language, however many rows there are; more than MOST_LANGUAGES languages are an error.
    """
    import pyarrow as pa

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            langs = np.array(b.column(0).to_pylist(), object)
            vectors, letters = text_vectors(b.column(1).to_pylist())
            vectors = _units(vectors)
            for lang in set(langs[letters]):
                total[lang] = total.get(lang, 0) + vectors[letters & (langs == lang)].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    summed = rows.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    summed = write_shared(summed, "prototypes")
    if summed.where("i = 0").count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = round(r["x"], 6)
    return {lang: _units(out[lang]) for lang in sorted(out)}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the cosine, 0 at least.

    Null, empty and letterless texts: `und`, 0. Without any prototype every text is `und`, 0. Ties go to the first
    language in code point order. Repeated rows come back as often as they came; other columns are not looked at.
    """
    import pyarrow as pa

    names = [*profiles, UNKNOWN]
    matrix = np.array(list(profiles.values()), np.float32).reshape(-1, DIMENSIONS)

    def rows(batches):
        for b in slices(batches):
            vectors, letters = text_vectors(b.column(1).to_pylist())
            best, score = np.full(len(vectors), len(matrix)), np.zeros(len(vectors))
            if len(matrix):
                cosines = _units(vectors) @ matrix.T
                best = np.where(letters, cosines.argmax(axis=1), len(matrix))
                score = np.where(letters, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id bigint, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    profiles = prototypes(docs.where(~held_out & F.col("doc_id").isNotNull()))
    out = predict(docs, profiles)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
