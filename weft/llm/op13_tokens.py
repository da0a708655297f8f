"""Token ids in ORC files, in the order of the document ids: stripes of run-length encoded integers with row indexes and Bloom filters.

Rows are range-partitioned and sorted by doc_id, encoded in that order and written, a file for each partition. A row holds
the file's number and the ids before it in the file, so where a document starts in the whole is its file's start plus
that, and the files' totals (one row for each) are all that is put together. ORC's writer lays the ids out as run-length
encoded stripes, keeps least and greatest values of each stripe and of each few thousand rows, and a Bloom filter of the document
ids; readers split files at stripes and pass over those that can't hold what is asked for.

No piece that the vocabulary's encoder merges reaches over white space or from one kind of characters into another, so pieces are
merged one by one and remembered: the ids are those of the whole text (tests compare both). Texts of ASCII and Latin-1 letters
are cut into pieces here; words of others go through the whole encoder.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import read_table, slices

END = 1
MOST_VOCABULARY_MB = 64
MOST_WORDS, MOST_PIECES = 100_000, 1_000_000
CHUNK = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
_LETTERS = "A-Z\u00c0-\u00d6\u00d8-\u00dea-z\u00df-\u00f6\u00f8-\u00ff"
#: Characters of the texts that are cut here: printable ASCII, white space, and Latin-1's letters, which are their own composed forms.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
_LOWER = bytes(ord(chr(c).lower()) if c < 0xD7 or 0xD7 < c < 0xDF else c for c in range(256))
#: How the vocabulary's encoder cuts such texts in lower case (fixed value).
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9{_LETTERS}]+".encode("latin-1"))
ORC = {"orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "orc.rows.between.memory.checks": "200", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
_encoders: dict[int, Words] = {}


class Pieces(dict):
    """Ids of a piece (Latin-1, lower case) by the encoder's merges, as bytes (unsigned, 32 bits, little-endian); remembered, and cleared at MOST_PIECES, so memory stays bounded."""

    def __init__(self, encoder):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.merge = encoder.model.tokenize
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}  # how the merges spell bytes

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MOST_PIECES:
            self.clear()
        text = piece.decode("latin-1")
        self[piece] = out = array("I", [t.id for t in self.merge(text if text.isascii() else text.translate(self.spelled))]).tobytes()
        return out


class Words(dict):
    """Ids of a word (UTF-8) by the whole encoder, as Pieces has them; cleared at MOST_WORDS."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder = Tokenizer.from_str(vocabulary)
        self.pieces = Pieces(self.encoder)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = out = array("I", self.encoder.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        return out

    def of(self, text: bytes | None) -> bytes:
        """Ids of a text; long ones go by parts that end before white space."""
        text, out, at = text or b"", [], 0
        while at < len(text):
            end = _SPACE.search(text, at + CHUNK)
            end = end.start() if end else len(text)
            out.append(self._part(text[at:end]))
            at = end
        return b"".join(out)

    def _part(self, text: bytes) -> bytes:
        try:
            plain = text if text.isascii() else text.decode().encode("latin-1")
        except UnicodeError:
            plain = None
        if plain is None or plain.translate(None, _PLAIN) or b"<|" in plain:  # the encoder's own tokens are written so
            return b"".join(map(self.__getitem__, text.split()))
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(plain.translate(_LOWER))))


def _encoder(vocabulary: str) -> Words:
    """Built once in a worker."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Words(vocabulary)
    return _encoders[key]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, **options: str) -> None:
    """Write (doc_id, file, before, n_tokens, ids) as ORC under `path`, a row for each row of docs in ascending order of doc_id.

    ids: of the whole text, and `end`; null and empty texts have `end` alone. Rows of a null id come first, rows of one id in
    the order of their texts' hashes; repeated rows stay. Other columns are not looked at. The vocabulary file is read where the driver
    runs and broadcast; it must be under MOST_VOCABULARY_MB. options: of Spark's ORC writer, before those of ORC.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read(MOST_VOCABULARY_MB << 20)
        if f.read(1):
            raise ValueError(f"the vocabulary is larger than {MOST_VOCABULARY_MB} MB")
    shared = spark.sparkContext.broadcast(data)
    text = F.col(text_col).cast("binary")
    # a hot id is dealt out by text, and its equal rows by the part of the table that they stand in
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("p"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("p").asc()]

    def encoded(batches):
        from pyspark import TaskContext

        file, before, words = TaskContext.get().partitionId(), 0, _encoder(shared.value)
        closing = np.array([end], "<u4").tobytes()
        for b in slices(batches):
            ids = [words.of(t) + closing for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) // 4 for x in ids])
            sizes = np.concatenate(([0], ends)).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(ids), file, np.int32)), pa.array(before + sizes[:-1].astype(np.int64)), pa.array(np.diff(sizes).astype(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), flat)],
                ["doc_id", "file", "before", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    out = ordered.mapInArrow(encoded, "doc_id bigint, file int, before bigint, n_tokens bigint, ids array<int>")
    out.write.options(**(ORC | options)).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that write_token_files() wrote; start: ids of all documents before it.

    A condition on doc_id is pushed down to the stripes' statistics, row indexes and Bloom filters. Files are read by stripes.
    """
    files = spark.read.orc(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    return files.join(F.broadcast(starts), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")  # a row for each file


def with_crc32(tokens: DataFrame) -> DataFrame:
    """tokens(doc_id, start, n_tokens, ids) with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    import pyarrow as pa

    def rows(batches):
        for b in slices(batches):
            ids = b.column(3)
            flat, cuts = ids.flatten().to_numpy().astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy())))) * 4
            sums = [zlib.crc32(flat[s:e]) for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc32(read_token_files(spark, path))
