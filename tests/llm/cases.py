"""Documents for the edge cases that every operator must define, and for repeats of each kind."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in ("fp", "size", "h", "sha", "anchor", "route")]
)


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def texts() -> list[tuple]:
    base, line = prose(1, 300), prose(2, 30)
    passage = prose(3, 75)
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", None), (4, base.replace(base.split()[150], "changed", 1), "en", "b"),
        (5, None, None, None), (6, "", "en", "a"), (7, "   \n\t ", "en", "a"), (8, "word", "en", "a"), (9, "... 123 !!", "fr", "b"),
        (10, prose(4, 40) + "\n" + passage + "\n" + prose(5, 40), "de", "b"), (11, passage + " " + prose(6, 60), "de", "b"), (12, prose(7, 20) + " " + passage, None, "c"),
        (13, "a" * 400, "en", "c"), (14, "b" + "a" * 250 + "c", "en", "c"), (15, "na " * 200, "en", "c"), (16, prose(8, 6000), "en", "c"),
        (17, prose(9, 49), "en", "d"), (18, prose(9, 49), "en", "d"), (19, prose(10, 50), "en", "d"), (20, prose(10, 50), "en", "d"), (21, "ünïcödé 文字 " * 30, "de", "d"), (None, base, "en", "a"),
        (2, base, "en", "a"),
    ]
    out += [(100 + i, prose(100 + i, 20) + "\n" + line + "\n" + prose(200 + i, 20), "en", "hot") for i in range(30)]
    out += [(200 + i, " ".join([*passage.split()[: 70 + i % 3], f"x{i}"]), "en", "hot") for i in range(10)]
    return out


def docs(spark, rows=None):
    """With extra columns named as the operators' own inner columns."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, *["x"] * 6) for i, t, lang, s in rows], SCHEMA)
