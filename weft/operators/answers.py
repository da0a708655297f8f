"""Requests to and answers from an outside model, as tables: requests are built, answers are parsed and chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T


def build_requests(splits: DataFrame, template: str, cap: int = 160) -> DataFrame:
    """(doc_id, n, request): the template and a JSON list of a document's first `cap` splits(doc_id, pos, sid, text)."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sid"))
    kept = splits.withColumn("k", place).where(F.col("k") <= cap)
    items = F.transform(F.array_sort(F.collect_list(F.struct("k", "sid", "text"))), lambda x: F.struct(x["sid"].alias("sid"), x["text"].alias("text")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.concat(F.lit(template), F.to_json(items)).alias("request"))


def batch_rows(df: DataFrame, size: int = 40) -> DataFrame:
    """Consecutive batches of a document's rows by pos."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1) / size))


def parse_json_answer(raw: Column) -> Column:
    """Variant: the whole text as JSON, else from its first { to its last }, else null. Never fails."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def answer_sentences(answer: Column) -> Column:
    """The strings of $.sentences; anything else gives an empty array."""
    items = F.try_variant_get(answer, "$.sentences", "array<variant>")
    strings = F.transform(F.filter(items, lambda x: F.call_function("schema_of_variant", x) == "STRING"), lambda x: x.cast("string"))
    return F.coalesce(strings, F.array().cast("array<string>"))


def answer_pair(raw: Column, text: Column) -> Column:
    """The two-field form, sentence1 and sentence2: their strings, empty ones left out. An answer that is no JSON object gives the text, stripped; null stays null."""
    answer = F.try_parse_json(raw)
    both = F.array(*(F.try_variant_get(answer, f"$.sentence{k}", "string") for k in (1, 2)))
    is_object = F.call_function("schema_of_variant", answer).startswith("OBJECT")
    return F.when(is_object, F.filter(both, lambda x: x.isNotNull() & (x != ""))).otherwise(F.array(T.strip(text)))


def _made(responses: DataFrame, most: int) -> DataFrame:
    """The attempts below `most`, with the strings that each returned and whether they are one sentence that is not blank."""
    said = responses.where(F.col("attempt") < most).withColumn("said", answer_sentences(parse_json_answer(F.col("raw"))))
    return said.withColumn("valid", F.coalesce((F.size("said") == 1) & (T.strip(F.get("said", F.lit(0))) != ""), F.lit(False)))


def first_valid_attempt(requests: DataFrame, responses: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, request_id, answer): the sentence, stripped, of the first attempt below `most` that returned exactly one string, which isn't blank; else ''."""
    good = _made(responses, most).where("valid")
    best = good.groupBy("doc_id", "request_id").agg(F.min_by(T.strip(F.get("said", F.lit(0))), "attempt").alias("answer"))
    return requests.select("doc_id", "request_id").join(best, ["doc_id", "request_id"], "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def retry_rows(responses: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, request_id, attempt, returned_count): the attempts that had to be repeated, so those below `most` before the first valid one, with the number of strings each returned."""
    earlier = Window.partitionBy("doc_id", "request_id").orderBy("attempt").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    done = _made(responses, most).withColumn("done", F.max("valid").over(earlier))
    return done.where(~F.col("done")).select("doc_id", "request_id", "attempt", F.size("said").alias("returned_count"))


def words_preserved(original: Column, parts: Column) -> Column:
    """Do the parts (an array) hold the original's words, in order?"""
    return T.words(original) == T.words(F.array_join(parts, " "))


def cleaning_audit(df: DataFrame, totals: Observation | None = None) -> DataFrame:
    """df(doc_id, pos, original, cleaned): a row for each sentence with lengths and whether it changed.

    totals gets the run's sums when the rows are first written or collected: n_sentences, n_changed, chars_before,
    chars_after. They come with the rows, without a pass of their own; a null text counts as unchanged and without characters.
    """
    out = df.select("doc_id", "pos", "original", "cleaned", (F.col("original") != F.col("cleaned")).alias("changed"), F.length("original").alias("chars_before"), F.length("cleaned").alias("chars_after"))
    if totals is None:
        return out
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return out.observe(totals, F.count(F.lit(1)).alias("n_sentences"), F.count_if("changed").alias("n_changed"), total("chars_before").alias("chars_before"), total("chars_after").alias("chars_after"))
