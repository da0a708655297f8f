"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself. It fails as navigation (bars or angle quotes between its words, or links in place of most
of them), by punctuation (symbols or exclamation marks on most words, or many words without any sentence mark) or as
boilerplate (a copyright sign, or licence, cookie and sign-up phrases). Failing lines are removed; a document that loses
more than half of its words is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = ("©", "licensed under", "all rights reserved", "copyright (c)", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our", "click here")
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LOST = 50  # per cent of the words
LONG_LINE = 40  # words that a line may have without any sentence mark


def _words(text: Column) -> Column:
    """Words of a text; an empty array for null or blank."""
    stripped = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(stripped) > 0, F.split(stripped, SPACE)).otherwise(F.array().cast("array<string>"))


def _count(text: Column, characters: str) -> Column:
    """How many of these characters stand in the text; texts without any, which are most, are only searched."""
    some = reduce(lambda found, c: found | c, (F.contains(text, F.lit(c)) for c in characters))
    return F.when(some, F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(0)


def _n_words(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(SPACES))
    return F.when(F.length(stripped) > 0, F.size(F.split(stripped, SPACE))).otherwise(0)


def _left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def line_fails(line: Column, n_words: Column) -> Column:
    """Does a line with words fail a rule? Each count is worked out once."""
    links = (F.length(line) - F.length(F.replace(line, F.lit("://"), F.lit("")))) / 3
    counts = F.struct(_count(line, "|»›").alias("bars"), _count(line, SYMBOLS + "!").alias("marks"), links.alias("links"), F.lower(line).alias("low"))

    def fails(c: Column) -> Column:
        navigation = (c["bars"] * 4 > n_words) & (c["bars"] >= 2) | (c["links"] * 2 > n_words)
        punctuation = (c["marks"] * 2 > n_words) & (c["marks"] >= 3) | (n_words > LONG_LINE) & (_count(line, ".!?;:,") == 0)
        boilerplate = F.lit(False)
        for phrase in BOILERPLATE:
            boilerplate = boilerplate | F.contains(c["low"], F.lit(phrase))
        return navigation | punctuation | boilerplate

    return _bound(counts, fails)


def _bound(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column, n_words: Column, hash_bits: int = 64) -> Column:
    """Words in three-word windows that stand twice or more in the text, first included.

    Windows are sorted as one number each, a hash of `hash_bits` above the window's place (less the bits that places need),
    so repeats are neighbours; neighbours with equal hashes are compared word by word. A text in which such neighbours
    differ is sorted by the words themselves. Places are sorted again and each adds the words that the one before hasn't added.
    """
    bits = F.greatest(F.ceil(F.log2(n_words + 1)).cast("int"), F.lit(64 - hash_bits))
    places = F.sequence(F.lit(0), n_words - 3)
    word = lambda i, k: F.get(words, i + k)

    def key(i: Column) -> Column:
        return _left(_right(F.xxhash64(word(i, 0), word(i, 1), word(i, 2)), bits), bits).bitwiseOR(i.cast("bigint"))

    def by_hash(s: Column) -> Column:
        place = lambda x: x.bitwiseAND(_left(F.lit(1).cast("bigint"), bits) - 1).cast("int")
        same = lambda i, j: F.coalesce(_right(F.get(s, i), bits) == _right(F.get(s, j), bits), F.lit(False))

        def differ(i: Column, j: Column) -> Column:
            p, q = place(F.get(s, i)), place(F.get(s, j))
            return (word(p, 0) != word(q, 0)) | (word(p, 1) != word(q, 1)) | (word(p, 2) != word(q, 2))

        def repeat(x: Column, i: Column) -> Column:  # -1: equal hashes of different words
            before, after = same(i, i - 1), same(i, i + 1)
            clash = before & differ(i, i - 1) | after & differ(i, i + 1)
            return F.when(before | after, F.when(clash, F.lit(-1)).otherwise(place(x)))

        return F.array_sort(F.array_compact(F.transform(s, repeat)))

    def by_words(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            x, y = F.get(s, i), F.get(s, j)
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        return F.array_sort(F.array_compact(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))))

    def spread(p: Column) -> Column:
        def add(x: Column, i: Column) -> Column:
            return F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))

        return F.aggregate(F.transform(p, add), F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = F.transform(places, lambda i: F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("i")))
    found = _bound(_bound(F.sort_array(F.transform(places, key)), by_hash), lambda p: F.when(F.get(p, F.lit(0)) == -1, _bound(F.array_sort(windows), by_words)).otherwise(p))
    return F.when(n_words >= 4, _bound(found, spread)).otherwise(0).cast("bigint")


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, n_lost_words, clean_text.

    Null, empty and blank texts have zeros, no lines, and fail by their length. n_lines counts lines with a word. Repeated
    rows and rows with a null id are judged like others; other columns are not looked at. No rows: no rows. hash_bits only
    decides how often repeated_words() has to compare by words.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", _words(F.col("text")).alias("w"), F.split("text", "\n").alias("l"))
    line = F.transform("l", lambda x: F.struct(x.alias("t"), _n_words(x).alias("n")))
    df = df.select("doc_id", "text", "w", F.size("w").alias("n"), line.alias("l"))
    judged = F.transform("l", lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n"), ((x["n"] > 0) & line_fails(x["t"], x["n"])).alias("bad")))
    df = df.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        F.transform(F.filter("l", lambda x: x["n"] > 0), lambda x: x["t"]).alias("full"),
        repeated_words(F.col("w"), F.col("n"), hash_bits).alias("n_repeat_words"),
        judged.alias("l"),
    )
    bad = F.filter("l", lambda x: x["bad"])
    df = df.select("*", F.aggregate(bad, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_lost_words"), F.size(bad).cast("bigint").alias("n_failed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * F.col("n_lost_words") <= MAX_LOST * F.col("n_words"))).alias("kept"),
        F.size("full").cast("bigint").alias("n_lines"),
        "n_failed_lines",
        "n_lost_words",
        F.array_join(F.transform(F.filter("l", lambda x: ~x["bad"]), lambda x: x["t"]), "\n").alias("clean_text"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return rules(read_table(spark, sf_dir, "documents")).drop("clean_text")


_like = " or ".join(f"contains(lower(x.t), '{p}')" for p in BOILERPLATE)
_marks = r"'[#*$%&|<>!]'"
#: DuckDB over the same tables.
ORACLE_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
      list_filter(list_transform(string_split(t, chr(10)), lambda x: {{'t': x, 'n': len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))}}), lambda x: x.n > 0) as l from d),
tri as (select row_id, i, count(*) over (partition by row_id, a, b, c) as k from
        (select row_id, i, w[i] as a, w[i+1] as b, w[i+2] as c from (select doc_id as row_id, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) > 2))),
rep as (select row_id, count(distinct j) as n from (select row_id, unnest([i, i+1, i+2]) as j from tri where k > 1) group by 1),
bad as (select *, list_filter(l, lambda x:
          (len(regexp_replace(x.t, '[^|»›]', '', 'g')) * 4 > x.n and len(regexp_replace(x.t, '[^|»›]', '', 'g')) >= 2)
          or (length(x.t) - length(replace(x.t, '://', ''))) / 3 * 2 > x.n
          or (len(regexp_extract_all(x.t, {_marks})) * 2 > x.n and len(regexp_extract_all(x.t, {_marks})) >= 3)
          or (x.n > {LONG_LINE} and not regexp_matches(x.t, '[.!?;:,]')) or {_like}) as bad from w),
o as (select doc_id, cast(len(w) as bigint) as n_words, cast(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
      cast(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(len(l) - len(list_distinct(list_transform(l, lambda x: x.t))) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
      cast(len(l) as bigint) as n_lines, cast(len(bad) as bigint) as n_failed_lines, cast(coalesce(list_sum(list_transform(bad, lambda x: x.n)), 0) as bigint) as n_lost_words
      from bad left join rep on rep.row_id = doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_lost_words <= {MAX_LOST} * n_words as kept from o
"""
