"""Contexts that roll through a document's sentences as they arrive: state by document, with the results of the batch operators.

A document's rows must arrive in the order of pos, those of one pos in one micro-batch. Its state holds what its later rows
need: the values of its paths, or its latest pair. Where an executor is lost, Spark reads the state back from the checkpoint.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ONE, _OTHER = re.compile(r"\bone end of the (\w+)", re.I), re.compile(r"\bthe other end\b", re.I)


def stream_context_asof(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, path, value) as references.context_asof() gives them, of a stream rows(doc_id, pos, path, value): updates, and sentences as rows without a path.

    Of several updates at one place the greatest value stands; a null value is one. Rows with a null doc_id or pos match nothing.
    """

    def step(key, batches, state: GroupState):
        values = dict(zip(*state.get, strict=True)) if state.exists else {}
        found = pd.concat(list(batches)).sort_values("pos", kind="stable")
        out = []
        for pos, at in found.groupby("pos", sort=True):
            asked, given = at[at["path"].isna()], at[at["path"].notna()]
            out += [(key[0], pos, path, value) for _ in range(len(asked)) for path, value in values.items()]
            for path, own in given.groupby("path"):
                known = [x for x in own["value"] if isinstance(x, str)]
                values[path] = max(known, key=str.encode) if known else None
        state.update((list(values), list(values.values())))
        yield pd.DataFrame(out, columns=["doc_id", "pos", "path", "value"])

    own = rows.where("doc_id is not null and pos is not null").selectExpr("doc_id", "cast(pos as bigint) as pos", "path", "cast(value as string) as value")
    keyed = own.groupBy("doc_id")
    return keyed.applyInPandasWithState(step, "doc_id bigint, pos bigint, path string, value string", "paths array<string>, vals array<string>", "append", GroupStateTimeout.NoTimeout)


def stream_paired_ends(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, text) as references.resolve_paired_ends() gives them, of a stream rows(doc_id, pos, text)."""

    def step(key, batches, state: GroupState):
        latest = state.get[0] if state.exists else None
        found = pd.concat(list(batches)).sort_values("pos", kind="stable")
        texts = []
        for text in found["text"]:
            if isinstance(text, str):
                named = _ONE.search(text)
                latest = named[1] if named else latest
                text = _ONE.sub(lambda m: f"[{m[1]}.EndA]", text)
                text = _OTHER.sub(lambda _, x=latest: f"[{x}.EndB]", text) if latest is not None else text
            texts.append(text)
        state.update((latest,))
        yield found.assign(text=texts)[["doc_id", "pos", "text"]]

    own = rows.where("doc_id is not null").selectExpr("doc_id", "cast(pos as bigint) as pos", "text")
    return own.groupBy("doc_id").applyInPandasWithState(step, "doc_id bigint, pos bigint, text string", "latest string", "append", GroupStateTimeout.NoTimeout)
