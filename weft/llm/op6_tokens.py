"""Token counts by section: each document is encoded once, whole, and its tokens are attributed by their offsets.

A byte-level vocabulary's tokens lay end to end over the text's UTF-8 bytes, which gives every token's span. Spans are
interval-joined with the sections' spans, both in order. A token that crosses a boundary goes, by the rule chosen, to the
section of its first character ("start", the default) or to that holding most of its bytes, the first of several
("largest"). So the sections' counts add up to the document's.

The encoder looks ahead at white space and runs out of stack on runs of some hundred thousand spaces. Such runs are cut out
where a token ends anyway and encoded alone, by the same merges: the tokens are those of the whole text.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's encoder cuts text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the encoder's pattern has it (fixed value).
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 50_000
MOST_VOCABULARY_MB = 64
RESULT = "doc_id bigint, section int, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint"
_encoders: dict[int, tuple] = {}


def _by_parts(plain, run):
    """Encoder of whole texts: `run` has the long runs of white space, `plain` what lies between.

    All of a run but its last character is one piece for the encoder (the whole run at the end of a text); the last one
    goes with what follows. No other piece crosses the cuts.
    """

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return plain(text)
        out, at = [], 0
        for m in _SPACES.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            if end - m.start() >= LONG_RUN:
                out += plain(text[at : m.start()])
                out += run(text[m.start() : end])
                at = end
        return out + plain(text[at:])

    return encode


def _encoder(data: bytes) -> tuple:
    """(encode, bytes of each token); built once in a worker."""
    key = hash(data)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        plain, run = (tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, r"\s+"))
        _encoders[key] = _by_parts(plain, run), lengths
    return _encoders[key]


def line_sections(text: bytes) -> np.ndarray:
    """Byte ends of the sections: lines, each with its line feed. An empty text is one empty section."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens of it that cross its end or start elsewhere) from byte spans; sections: their ends in order."""
    own = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, ends - 1, side="right")
    crosses = last > own
    if rule == "largest":
        for t in np.flatnonzero(crosses):
            edges = np.concatenate(([starts[t]], sections[own[t] : last[t]], [ends[t]]))
            own[t] += int(np.argmax(np.diff(edges)))
    elif rule != "start":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(own, minlength=len(sections)), np.bincount(own[crosses], minlength=len(sections))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections=line_sections) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing): a row for each section of each row of docs.

    Null and empty texts have one section, 0, without tokens. Strings that look like special tokens are text. Repeated rows
    and rows with a null id are counted like others; other columns are not looked at. The vocabulary file is read where the
    driver runs and broadcast; it must be under MOST_VOCABULARY_MB.
    """
    import pyarrow as pa

    with open(vocabulary, "rb") as f:
        data = f.read(MOST_VOCABULARY_MB << 20)
        if f.read(1):
            raise ValueError(f"the vocabulary is larger than {MOST_VOCABULARY_MB} MB")
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def rows(batches):
        encode, lengths = _encoder(shared.value)
        for b in slices(batches):
            out = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                raw = text.encode()
                ends = np.cumsum(lengths[np.array(encode(text), np.int64)])
                cuts = sections(raw)
                n, crossing = attribute(np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends, cuts, rule)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                edges = chars[np.concatenate(([0], cuts))]
                for x, v in zip(out, ([doc_id] * len(cuts), range(len(cuts)), edges[:-1].tolist(), edges[1:].tolist(), n.tolist(), crossing.tolist()), strict=True):
                    x.extend(v)
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
