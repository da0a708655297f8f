"""Cleaning and rewriting of text: functions from columns to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex


def let(value: Column, then) -> Column:
    """then(value), the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_linebreaks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s*\n\s*", " ")


def normalize_np(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"(?iU)\bsaid\s+", "the "), r"(?U)\s+", " "), F.lit(" ,;"))


def simple_label(c: Column) -> Column:
    words = F.regexp_replace(c, rf"(?iU)\b({'|'.join(lex.LABEL_STOP_WORDS)})\b", "")
    return F.lower(clean_whitespace(words))


def predicate_slug(c: Column) -> Column:
    return F.concat(F.lit("custom_"), F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), F.lit("_")))


def fix_punct_spacing(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+([,.;:])", "$1")


def fix_period_comma(c: Column) -> Column:
    """The weaker form: one space before a period or comma."""
    return F.replace(F.replace(c, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))


def ensure_final_period(c: Column) -> Column:
    """Stripped, with a final period; null for a blank text."""
    s = strip(c)
    return F.when(s != "", F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))


def sentence_summary(sid: Column, c: Column, n_tokens: Column) -> Column:
    return F.format_string("Sentence[%d]: '%s' (tokens=%d)", sid, F.substring(strip(c), 1, 60), n_tokens)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def fits_constraints(c: Column, max_len: int = 130, max_words: int = 30, min_words: int = 6) -> Column:
    n = F.size(words(c))
    return (strip(c) == "") | ((F.length(c) <= max_len) & (n <= max_words) & (n >= min_words))


def strip_said(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)\bsaid\s+(?=\w)", "")


def scrub_boilerplate(c: Column) -> Column:
    """Phrases go in order, then white space is cleaned. Texts in which none stands (one pattern tells) skip the chain: removal starts with a phrase."""
    chain = reduce(lambda t, pattern: F.regexp_replace(t, f"(?iU){pattern}", ""), lex.BOILERPLATE, strip_said(c))
    some = F.rlike(c, F.lit(f"(?iU){'|'.join(lex.BOILERPLATE)}"))
    return strip(fix_punct_spacing(clean_whitespace(F.when(some, chain).otherwise(c))))


def choose_cleaned(original: Column, external: Column) -> Column:
    """The external text, else the scrubbed one, else the original; blank originals pass."""
    def full(x: Column) -> Column:  # scrubbed once: an array of one is filtered
        kept = F.filter(F.array(clean_whitespace(x)), lambda y: y != "")
        return F.get(kept, F.lit(0))

    return F.when(strip(original) == "", original).otherwise(F.coalesce(full(external), full(scrub_boilerplate(original)), original))


def standardise_figures(c: Column) -> Column:
    return F.regexp_replace(c, r"\bFIG\.?\s*(\d+)", "<FIG_$1>")


def remove_connectors(c: Column) -> Column:
    return clean_whitespace(F.regexp_replace(c, rf"(?iU)\b({'|'.join(lex.CONNECTORS)})\b,?\s*", ""))


def normalize_units(c: Column) -> Column:
    return F.regexp_replace(c, rf"(\d)({'|'.join(lex.UNITS)})\b", "$1 $2")


def remove_words(c: Column, banned) -> Column:
    """The white-space tokens of c but for the banned ones (any case), joined by single spaces."""
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(*banned)), " ")


def normalize_synonyms(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Longest phrase first, whole words, any case."""
    pairs = sorted((synonyms or lex.SYNONYMS).items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return reduce(lambda t, kv: F.regexp_replace(t, rf"(?iU)\b{kv[0]}\b", kv[1]), pairs, c)


def standardize_prepositions(c: Column) -> Column:
    return reduce(lambda t, kv: F.regexp_replace(t, rf"(?iU)\b{kv[0]}\b", kv[1]), lex.PREPOSITIONS.items(), c)


def tag_modality(c: Column) -> Column:
    def has(pattern: str) -> Column:
        return F.rlike(c, F.lit(rf"(?iU)\b({pattern})\b"))

    return F.when(has("may|can"), "capability").when(has("must|required"), "requirement").when(has("optional"), "optional").otherwise("")


def extract_condition(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\b(?:when|if|so that)\b.*", 0)
