"""Registered queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as T
from ..operators import answers, finds, graph, kg, references, relations, sentences, tokens
from ..session import cut_lineage, shared_folder
from ..sources.documents import read_kg, write_kg
from ..sources.graph_xml import read_graph_xml
from ..streaming.context import stream_context_asof
from . import pipelines
from .views import CANONICAL, DEP, WORDS, Views, with_views

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _add(name: str, run: Callable[[Views], DataFrame], sql: str | None = None, *views: str) -> None:
    _QUERIES[name] = (run, with_views(sql, *views) if sql else None)


def _claims(f) -> Callable[[Views], DataFrame]:
    return lambda v: v.claims.select("doc_id", "pos", f(F.col("text")).alias("out"))


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_B, _E = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"
_CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_SAID = r"regexp_replace({0}, '" + _B + r"said\s+([\pL\pN_])', '\1\2', 'gi')"


def _scrub_sql(x: str) -> str:
    x = _SAID.format(x)
    for p in lex.BOILERPLATE:
        x = f"regexp_replace({x}, '\\bsaid(\\s+[\\pL\\pN_])', '\\1', 'gi')" if "said" in p else f"regexp_replace({x}, '{p}', '', 'gi')"
    x = _CLEAN.format(x)
    return f"trim(regexp_replace({x}, '\\s+([,.;:])', '\\1', 'g'))"


# Sources and sinks
_add("s1_documents", lambda v: v.documents, "select * from documents")
_add("s4_token_graph_nodes", lambda v: tokens.token_graph(v.toks)[0], "select doc_id, concat('s', sent, '_t', tok) id, text, lemma, pos_tag, dep, head = tok as is_root, sent as sent_id from toks", "toks")
_add("s4_token_graph_edges", lambda v: tokens.token_graph(v.toks)[1], "select doc_id, concat('s', sent, '_t', head) source, concat('s', sent, '_t', tok) target, 'dep' as kind from toks where head <> tok", "toks")

# Cleaning
_add("t1_clean_whitespace", lambda v: v.documents.select("doc_id", T.clean_whitespace(F.col("text")).alias("out")), f"select doc_id, {_CLEAN.format('text')} as out from documents")
_add("t2_fold_linebreaks", lambda v: v.documents.select("doc_id", T.fold_linebreaks(F.col("text")).alias("out")), r"select doc_id, regexp_replace(text, '\s*\n\s*', ' ', 'g') as out from documents")
_add("t3_normalize_np", _claims(T.normalize_np), rf"select doc_id, pos, trim(regexp_replace(regexp_replace(text, '{_B}said\s+', '\1the ', 'gi'), '\s+', ' ', 'g'), ' ,;') as out from claims", "claims")
_add("t4_simple_label", lambda v: v.triples.select("doc_id", "pos", T.simple_label(F.col("object")).alias("out")), rf"select doc_id, pos, lower(trim(regexp_replace(regexp_replace(object, '{_B}(for|of|the|a|an|said){_E}', '\1\3', 'gi'), '\s+', ' ', 'g'))) as out from triples", "triples")
_add("t5_predicate_slug", lambda v: v.triples.select("doc_id", "pos", T.predicate_slug(F.col("surface_pred")).alias("out")), "select doc_id, pos, concat('custom_', trim(regexp_replace(lower(surface_pred), '[^a-z0-9]+', '_', 'g'), '_')) as out from triples", "triples")
_add("t6_punct_spacing", _claims(T.fix_punct_spacing), r"select doc_id, pos, regexp_replace(text, '\s+([,.;:])', '\1', 'g') as out from claims", "claims")
_add("t6_period_comma", _claims(T.fix_period_comma), "select doc_id, pos, replace(replace(text, ' .', '.'), ' ,', ',') as out from claims", "claims")
_add("t7_final_period", _claims(T.ensure_final_period), f"select doc_id, pos, case when {_STRIP.format('text')} <> '' then case when {_STRIP.format('text')} like '%.' then {_STRIP.format('text')} else {_STRIP.format('text')} || '.' end end as out from claims", "claims")
_add("t8_sentence_summary", lambda v: v.sents.select("doc_id", "pos", T.sentence_summary(F.col("pos"), F.col("s"), F.size(T.words(F.col("s")))).alias("out")), f"select doc_id, pos, concat('Sentence[', pos, ']: ''', substring(trim(s), 1, 60), ''' (tokens=', len({_WORDS.format('s')}), ')') as out from sents", "sents")
_add("t9_length_report", lambda v: sentences.length_report(v.sents, "s").select("doc_id", "pos", "chars", "short"), "select doc_id, pos, length(s) as chars, length(s) < 10 as short from sents", "sents")

# Sentences and clauses


def _punct_sql(rel: str, key: str = "doc_id, pos") -> str:
    return rf"""(select {key}, text, case when len(l) > 1 and trim(l[1]) = '' then list_concat([l[1] || substring(text, length(l[1]) + 1, 1) || l[2]], l[3:]) else l end as l
 from (select *, string_split(regexp_replace(text, '[;:](\s*[A-Za-z0-9<(])', chr(2) || '\1', 'g'), chr(2)) as l from {rel}))"""


_MARKED = f"list_bool_or(list_transform(w, lambda x: lower(x) in ({_list(lex.CLAUSE_MARKERS)})))"
_CUT = f"string_split(replace(array_to_string(list_transform(w, lambda x, i: case when i > 1 and lower(x) in ({_list(lex.CLAUSE_MARKERS)}) then chr(1) || x else x end), ' '), ' ' || chr(1), chr(1)), chr(1))"


def _clauses_sql(rel: str, key: str = "doc_id, pos") -> str:
    return f"""(select {key}, cast(generate_subscripts(c, 1) - 1 as int) as part, unnest(c) as clause from (
 select {key}, list_filter(list_transform(flatten(list(m order by pc)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as c from (
 select {key}, pc, case when {_MARKED} then {_CUT} else [piece] end as m
 from (select *, {_WORDS.format('piece')} as w from (select {key}, generate_subscripts(l, 1) as pc, unnest(l) as piece from {_punct_sql(rel, key)}))) group by all))"""


_PUNCT, _CLAUSES = _punct_sql("claims"), _clauses_sql("claims")
_add("c1_split_sentences", lambda v: v.sents, "select * from sents", "sents")
_add("c2_sentence_ids", lambda v: sentences.number_sentences(v.sents).select("doc_id", "pos", "sid"), "select doc_id, pos, concat('s', pos + 1) as sid from sents", "sents")
_add("c2_split_ids", lambda v: sentences.number_splits(sentences.split_clauses(v.claims)).select("doc_id", "sid", "clause"), f"select doc_id, concat('s', pos + 1, '.', part + 1) as sid, clause from {_CLAUSES}", "claims")
_add("c3_split_on_punct", lambda v: sentences.split_clauses(v.claims, parts=sentences.punct_parts).select("doc_id", "pos", "part", "clause"), f"select doc_id, pos, cast(generate_subscripts(l, 1) - 1 as int) as part, unnest(l) as clause from {_PUNCT}", "claims")
_add("c4_split_on_markers", lambda v: sentences.split_clauses(v.claims, parts=sentences.marker_parts).select("doc_id", "pos", "part", "clause"),
     f"""select doc_id, pos, cast(generate_subscripts(m, 1) - 1 as int) as part, unnest(m) as clause from (select doc_id, pos, case when list_bool_or(list_transform(w, lambda x: lower(x) in ({_list(lex.CLAUSE_MARKERS)}))) then
 string_split(replace(array_to_string(list_transform(w, lambda x, i: case when i > 1 and lower(x) in ({_list(lex.CLAUSE_MARKERS)}) then chr(1) || x else x end), ' '), ' ' || chr(1), chr(1)), chr(1)) else [text] end as m
 from (select *, {_WORDS.format('text')} as w from claims))""", "claims")  # fmt: skip
_add("c5_split_on_conj", lambda v: sentences.split_on_conj(v.toks), "select doc_id, sent, part, string_agg(text, ' ' order by tok) as clause from (select *, sum(case when dep = 'conj' and head = 0 and tok > 0 then 1 else 0 end) over (partition by doc_id, sent order by tok) as part from toks) group by 1, 2, 3", "toks")
_add("c6_split_clauses", lambda v: sentences.split_clauses(v.claims).select("doc_id", "pos", "part", "clause"), f"select * from {_CLAUSES}", "claims")
_SOLID = r"length(regexp_replace({0}, '\s+', '', 'g'))"
_BEFORE = "rows between unbounded preceding and 1 preceding"
_add("c6_split_clauses_conj", lambda v: sentences.split_clauses(v.claim_rows, tokens="t").select("doc_id", "pos", "part", "clause"),
     rf""", pc as (select doc_id, pos, generate_subscripts(l, 1) as k, unnest(l) as piece from {_PUNCT}),
 pa as (select *, coalesce(sum({_SOLID.format('piece')}) over (partition by doc_id, pos order by k {_BEFORE}), 0) + k - 1 as a from pc),
 mk as (select doc_id, pos, k, a, generate_subscripts(m, 1) as j, unnest(m) as c from (select *, case when {_MARKED} then {_CUT} else [piece] end as m from (select *, {_WORDS.format('piece')} as w from pa))),
 cl as (select doc_id, pos, k, j, {_STRIP.format('c')} as clause, {_SOLID.format('c')} as n, a + coalesce(sum({_SOLID.format('c')}) over (partition by doc_id, pos, k order by j {_BEFORE}), 0) as s from mk),
 tk as (select doc_id, sent as pos, tok, head, dep, coalesce(sum(length(text)) over (partition by doc_id, sent order by tok {_BEFORE}), 0) as o from clause_toks),
 own as (select cl.*, tok, head, dep, o, min(tok) over w as lo, max(tok) over w as hi from cl join tk on tk.doc_id = cl.doc_id and tk.pos = cl.pos and o >= s and o < s + n window w as (partition by cl.doc_id, cl.pos, k, j)),
 rt as (select doc_id, pos, k, j, min(tok) filter (where head = tok or head < lo or head > hi) as root from own group by all),
 ct as (select doc_id, pos, k, j, list((o - s)::bigint order by o) as cuts from own join rt using (doc_id, pos, k, j) where dep = 'conj' and head = root and tok > lo group by all),
 sp as (select doc_id, pos, k, j, clause, cuts, list_filter(range(1, length(clause) + 1), lambda i: trim(substring(clause, i, 1)) <> '') as x from cl left join ct using (doc_id, pos, k, j)),
 bd as (select *, list_concat(list_concat([0], list_transform(coalesce(cuts, []), lambda q: x[q + 1] - 1)), [length(clause)]) as b from sp),
 pt as (select doc_id, pos, k, j, generate_subscripts(l, 1) as i, unnest(l) as clause from (select *, list_transform(range(1, len(b)), lambda i: trim(substring(clause, b[i] + 1, b[i + 1] - b[i]))) as l from bd))
 select doc_id, pos, cast(row_number() over (partition by doc_id, pos order by k, j, i) - 1 as int) as part, clause from pt where clause <> ''""", "clause_toks")  # fmt: skip
_add("c7_finalize_short_docs", lambda v: sentences.finalize_short_docs(sentences.split_clauses(v.claims)).select("doc_id", "pos", "part", "clause"), f"select doc_id, pos, part, case when max(length(clause)) over (partition by doc_id) <= 80 and clause not like '%.' then clause || '.' else clause end as clause from {_CLAUSES}", "claims")
_FITS = f"({_STRIP.format('{0}')} = '' or (length({{0}}) <= 80 and len({_WORDS.format('{0}')}) between 6 and 30))"
_add("c8_fits_constraints", _claims(lambda c: T.fits_constraints(c, max_len=80)), f"select doc_id, pos, {_FITS.format('text')} as out from claims", "claims")
_LONG = "case when pos % 3 = 0 then concat(text, '. It stops when the tank of the pump is full! ', text) else text end"
_path = lambda: F.array_join(F.col("path").cast("array<string>"), ".").alias("path")
_refined = lambda v: sentences.refine_splits(v.claims.selectExpr("doc_id", "pos", f"{_LONG} as text"), max_len=80)


def _refine_sql() -> str:
    """Tables a0 .. a4 (accepted in each round) and b0 .. b4 (not), unrolled."""
    key, rel = "doc_id, pos, path", f"(select doc_id, pos, '' as path, {_LONG} as text from claims)"
    ends = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(^|[^\pL\pN_])([A-Z])\.', '\1\2' || chr(1), 'g'), '(^|[^\pL\pN_])([A-Z])!', '\1\2' || chr(3), 'g'), '(^|[^\pL\pN_])([A-Z])\?', '\1\2' || chr(4), 'g')"
    ended = rf"list_filter(list_transform(string_split(regexp_replace({ends}, '[.!?](\s|$)', chr(2) || '\1', 'g'), chr(2)), lambda x: trim(translate(x, chr(1) || chr(3) || chr(4), '.!?'))), lambda x: x <> '')"
    out = []
    for k in range(5):
        out += [f"p{k} as materialized (select * from {rel} q)", f"a{k} as (select * from p{k} where {_FITS.format('text')})", f"b{k} as (select * from p{k} where not {_FITS.format('text')})"]
        cut = _clauses_sql(f"b{k}", key) if k < 3 else f"(select {key}, cast(generate_subscripts(c, 1) - 1 as int) as part, unnest(c) as clause from (select {key}, {ended} as c from b{k}))"
        rel = f"(select doc_id, pos, concat(path, case when path = '' then '' else '.' end, part) as path, clause as text from {cut})"
    return ", " + ", ".join(out)


_add("c9_refine_splits", lambda v: _refined(v)[0].select("doc_id", "pos", "round", _path(), "text"), f"{_refine_sql()} {' union all '.join(f'select doc_id, pos, {k} as round, path, text from a{k}' for k in range(5))}", "claims")
_add("c9_dropped", lambda v: _refined(v)[1].select("doc_id", "pos", _path(), "text"), f"{_refine_sql()} select doc_id, pos, path, text from b4", "claims")
_SPANS = "(select doc_id, sent, tok as start, tok + 3 + length(text) % 5 as e, case tok % 3 when 0 then 'S' when 1 then 'SBAR' else 'NP' end as k from toks where tok % 4 = 0)"
_TOP = f"(select distinct a.doc_id, a.sent, a.start, a.e from {_SPANS} a where k <> 'NP' and not exists (select 1 from {_SPANS} b where b.k <> 'NP' and b.doc_id = a.doc_id and b.sent = a.sent and b.start <= a.start and a.e <= b.e and (a.start <> b.start or a.e <> b.e)))"
_add("c10_top_level_spans", lambda v: sentences.top_level_spans(v.spans_of_clauses).select("doc_id", "sent", "start", "end").distinct(), f'select doc_id, sent, start, e as "end" from {_TOP}', "toks")
_FINITE = "pos_tag = 'VERB' and length(text) % 2 = 0"
_add("c11_finite_spans", lambda v: sentences.finite_spans(sentences.top_level_spans(v.spans_of_clauses), v.toks.selectExpr("*", "length(text) % 2 = 0 as finite")).select("doc_id", "sent", "start", "end").distinct(), f'select doc_id, sent, start, e as "end" from {_TOP} t where e - start > 2 and exists (select 1 from toks k where k.doc_id = t.doc_id and k.sent = t.sent and k.tok >= t.start and k.tok < t.e and {_FINITE})', "toks")
_add("c12_fallback", lambda v: sentences.fallback_full_sentence(v.sents.select("doc_id", F.col("pos").alias("sent"), F.size(T.words(F.col("s"))).alias("n_words")), v.toks.where("pos_tag = 'VERB' and length(text) % 2 = 0").select("doc_id", "sent")),
     f"select doc_id, sent from (select doc_id, min(pos) as sent from sents where len({_WORDS.format('s')}) > 2 group by 1) left join (select doc_id, min(sent) as f from toks where {_FINITE} group by 1) using (doc_id) where f is null or sent < f", "toks")
#: Repeats that differ by white space at their ends, and blanks.
_SPACED = "case pos % 5 when 0 then concat(' ', text, ' ') when 1 then translate(text, 'adehint', 'ADEHINT') when 2 then '  ' else text end"
_FIXED = _STRIP.format(f"replace(replace({_SPACED}, ' .', '.'), ' ,', ',')")
_add("c13_dedupe_ci", lambda v: sentences.dedupe_ci(v.claims.withColumn("text", F.expr(_SPACED))), f"select doc_id, pos, text from (select doc_id, pos, t as text, row_number() over (partition by doc_id, lower(t) order by pos) as n from (select doc_id, pos, {_FIXED} as t from claims) where t <> '') where n = 1", "claims")


def _items(v: Views, answered: DataFrame | None = None) -> DataFrame:
    cut = sentences.number_splits(sentences.split_clauses(v.claims))
    if answered is not None:
        cut = cut.join(answered, "doc_id", "left_semi")
    items = F.transform(F.array_sort(F.collect_list(F.struct("part", "sid", F.col("clause").alias("simple")))), lambda x: F.struct(x["sid"].alias("sid"), x["simple"].alias("simple")))
    return cut.groupBy("doc_id", "pos", "text").agg(items.alias("splits")).select("doc_id", F.concat(F.lit("s"), F.col("pos") + 1).alias("id"), F.col("text").alias("original"), "splits")


_SPLITS = f"(select doc_id, concat('s', pos + 1, '.', part + 1) as sid, clause as text, concat('s', pos + 1) as parent from {_CLAUSES})"
#: Documents that a splitter has answered: those with a sentence of two clauses. The others fall back to their sentences.
_ANSWERED = f"(select doc_id from {_CLAUSES} where part > 0)"
_add("c14_flatten_splits", lambda v: sentences.flatten_splits(_items(v)), f"select * from {_SPLITS}", "claims")
_add("c15_identity_splits", lambda v: sentences.identity_splits(v.sents, sentences.flatten_splits(_items(v, sentences.split_clauses(v.claims).where("part > 0").select("doc_id")))), f"select * from {_SPLITS} where doc_id in {_ANSWERED} union all select doc_id, concat('s', pos + 1, '.1'), s, concat('s', pos + 1) from sents where doc_id not in {_ANSWERED}", "claims")

# Boilerplate and standard forms
_add("b1_scrub_boilerplate", _claims(T.scrub_boilerplate), f"select doc_id, pos, {_scrub_sql('text')} as out from claims", "claims")
_EXT = "case when pos % 3 = 0 then concat(' ', s, '  x') when pos % 3 = 1 then '  ' end"
_add("b2_choose_cleaned", lambda v: v.claims.join(v.sents, ["doc_id", "pos"]).select("doc_id", "pos", T.choose_cleaned(F.col("text"), F.expr(_EXT)).alias("out")), f"select doc_id, pos, case when {_STRIP.format('text')} = '' then text else coalesce(nullif({_CLEAN.format(_EXT)}, ''), nullif({_scrub_sql('text')}, ''), text) end as out from claims join sents using (doc_id, pos)", "claims")
_add("b3_cleaning_audit", lambda v: answers.cleaning_audit(v.claims.select("doc_id", "pos", F.col("text").alias("original"), T.scrub_boilerplate(F.col("text")).alias("cleaned"))), f"select doc_id, pos, text as original, c as cleaned, text <> c as changed, length(text) as chars_before, length(c) as chars_after from (select *, {_scrub_sql('text')} as c from claims)", "claims")


def _audit_totals(v: Views) -> DataFrame:
    """The run's totals, observed while the audit rows are written."""
    seen = Observation()
    cut_lineage(answers.cleaning_audit(v.claims.select("doc_id", "pos", F.col("text").alias("original"), T.scrub_boilerplate(F.col("text")).alias("cleaned")), seen), "audit")
    return v.spark.createDataFrame([seen.get], "n_sentences bigint, n_changed bigint, chars_before bigint, chars_after bigint")


_add("b3_totals", _audit_totals, f"select count(*) as n_sentences, count(*) filter (where text <> c) as n_changed, sum(length(text))::bigint as chars_before, sum(length(c))::bigint as chars_after from (select text, {_scrub_sql('text')} as c from claims)", "claims")
_add("b4_strip_said", _claims(T.strip_said), f"select doc_id, pos, {_SAID.format('text')} as out from claims", "claims")
_add("b5_figures", _claims(T.standardise_figures), r"select doc_id, pos, regexp_replace(text, '\bFIG\.?\s*(\d+)', '<FIG_\1>', 'g') as out from claims", "claims")
_add("b6_enumerations", lambda v: sentences.isolate_enumerations(v.claims).select("doc_id", "pos", "part", "item"), rf"select doc_id, pos, cast(generate_subscripts(l, 1) - 1 as int) as part, unnest(l) as item from (select doc_id, pos, list_filter(list_transform(string_split(regexp_replace(text, '(\([ivx]+\))', chr(2) || '\1', 'g'), chr(2)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') as l from claims)", "claims")
_add("b7_connectors", _claims(T.remove_connectors), rf"select doc_id, pos, trim(regexp_replace(regexp_replace(text, '{_B}({'|'.join(lex.CONNECTORS)})\b,?\s*', '\1', 'gi'), '\s+', ' ', 'g')) as out from claims", "claims")
_add("b8_units", _claims(T.normalize_units), rf"select doc_id, pos, regexp_replace(text, '(\d)({'|'.join(lex.UNITS)})\b', '\1 \2', 'g') as out from claims", "claims")


def _removed(words) -> str:
    return f"select doc_id, pos, array_to_string(list_filter({_WORDS.format('text')}, lambda x: lower(x) not in ({_list(words)})), ' ') as out from claims"


_DROPPED = [w for w, keep in lex.QUANTITATIVE.items() if not keep]
_add("b9_subjective", _claims(lambda c: T.remove_words(c, lex.SUBJECTIVE)), _removed(lex.SUBJECTIVE), "claims")
_add("b10_quantitative", _claims(lambda c: T.remove_words(c, _DROPPED)), _removed(_DROPPED), "claims")
_add("b11_synonyms", _claims(T.normalize_synonyms), r"select doc_id, pos, regexp_replace(regexp_replace(text, '\bcontrol unit\b', '<CONTROL_UNIT>', 'gi'), '\bcontroller\b', '<CONTROL_UNIT>', 'gi') as out from claims", "claims")
_add("b12_prepositions", _claims(T.standardize_prepositions), r"select doc_id, pos, regexp_replace(text, '\bon top of\b', 'above', 'gi') as out from claims", "claims")

# References
_ALIASES = {"the tank": "<TANK>", "pump": "<PUMP>", "the valve": "<VALVE>"}
_add("r1_aliases", lambda v: references.apply_aliases(v.claims, _ALIASES), r"select doc_id, pos, regexp_replace(regexp_replace(regexp_replace(text, '\bthe valve\b', '<VALVE>', 'gi'), '\bthe tank\b', '<TANK>', 'gi'), '\bpump\b', '<PUMP>', 'gi') as text from claims", "claims")
_PIECE = r"'[\pL\pN_]+|\s+|[^\pL\pN_\s]'"


def _mentions_sql(texts: str, phrases: str, by: str = "") -> str:
    """(doc_id, pos, p, out): pieces of texts(doc_id, pos, text) and the leftmost-longest mentions in them of phrases(by, phrase, value), as (at, e, value), e the piece after."""
    on, key = (f"k.{by} = u.{by} and ", f"{by}, ") if by else ("", "")
    return f"""(with k as materialized (select {key}lower(phrase) as key, len(regexp_extract_all(phrase, {_PIECE})) as n, lower(regexp_extract_all(phrase, {_PIECE})[1]) as head, min(value) as value from {phrases} where trim(phrase) <> '' group by all),
 w as materialized (select doc_id, pos, regexp_extract_all(text, {_PIECE}) as p from {texts}),
 h as (select distinct {key}head, n from k),
 g as (select u.doc_id, u.pos, i, k.n, lower(array_to_string(p[i : i + n - 1], '')) as key from (select *, generate_subscripts(p, 1) as i from w) u join h k on {on}k.head = lower(p[i])),
 m as (select u.doc_id, u.pos, i, max(k.n) as n, arg_max(value, k.n) as value from g u join k on {on}k.key = u.key and k.n = u.n group by 1, 2, 3),
 l as (select doc_id, pos, list({{'s': i, 'e': i + n, 'out': [{{'at': i, 'e': i + n, 'value': value}}]}} order by i) as l from m group by 1, 2)
 select doc_id, pos, p, list_reduce(l, lambda a, x: case when x.s >= a.e then {{'s': x.s, 'e': x.e, 'out': list_concat(a.out, x.out)}} else a end).out as out from w left join l using (doc_id, pos))"""


#: Phrases of one and of two words, of the whole table.
_PHRASES = "select object as label, pos, doc_id from triples where length(object) > 3 union all select concat(subject, ' ', surface_pred), pos, doc_id from triples where pos % 3 = 0"


def _phrases(triples: DataFrame) -> DataFrame:
    both = F.array(F.when(F.length("object") > 3, F.col("object")), F.when(F.col("pos") % 3 == 0, F.concat("subject", F.lit(" "), "surface_pred")))
    return triples.select(F.explode(F.array_compact(both)).alias("label"), "pos", "doc_id")


_add("r1_alias_table", lambda v: references.apply_aliases(v.claims, _phrases(v.triples_of(v.sents)).select(F.col("label").alias("alias"), F.concat(F.lit("<"), F.replace("label", F.lit(" "), F.lit("_")), F.lit(">")).alias("entity")).distinct()),
     "select doc_id, pos, case when out is null then array_to_string(p, '') else array_to_string(list_transform(p, lambda x, i: case when list_bool_or(list_transform(out, lambda o: o.at = i)) then list_filter(out, lambda o: o.at = i)[1].value when list_bool_or(list_transform(out, lambda o: o.at < i and i < o.e)) then '' else x end), '') end as text from "
     + _mentions_sql("claims", f"(select label as phrase, concat('<', replace(label, ' ', '_'), '>') as value from ({_PHRASES}))"), "claims", "triples")
_UPDATES = "select conv_id as doc_id, turn as pos, concat('p.', role, case when turn % 2 = 0 then '.a' else '' end) as path, text as value from conversations"


def _updates(v: Views) -> DataFrame:
    return v.table("conversations").selectExpr("conv_id as doc_id", "turn as pos", "concat('p.', role, case when turn % 2 = 0 then '.a' else '' end) as path", "text as value")


_add("r2_context_asof", lambda v: references.context_asof(_updates(v), v.table("conversations").selectExpr("conv_id as doc_id", "turn as pos")), f"select c.conv_id as doc_id, c.turn as pos, path, arg_max(value, u.pos) as value from conversations c join ({_UPDATES}) u on u.doc_id = c.conv_id and u.pos < c.turn group by 1, 2, 3")
_add("r3_merge_context", lambda v: references.merge_context(_updates(v)), f"""with l as (select doc_id, path, arg_max(value, pos) as value, max(pos) as pos from ({_UPDATES}) group by 1, 2)
 select doc_id, path, value from l where not exists (select 1 from l h where h.doc_id = l.doc_id and h.path <> l.path and ((starts_with(l.path, h.path || '.') and h.pos >= l.pos) or (starts_with(h.path, l.path || '.') and l.pos < h.pos)))""")  # fmt: skip


for _name in ("r2_context_asof", "r3_merge_context"):  # the same, under the names of their first versions on whole texts
    _QUERIES[f"{_name}_whole"] = _QUERIES[_name]


def _streamed_context(v: Views) -> DataFrame:
    """The same from a stream of conversations: each turn asks and then tells."""
    at = f"{shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    turns = v.spark.readStream.schema(v.table("conversations").schema).parquet(f"{v.dir}/conversations*.parquet")  # a stream takes folders and patterns
    rows = turns.selectExpr("conv_id as doc_id", "turn as pos", "explode(array(named_struct('path', cast(null as string), 'value', cast(null as string)), named_struct('path', concat('p.', role, case when turn % 2 = 0 then '.a' else '' end), 'value', text))) as x").select("doc_id", "pos", "x.*")
    found = stream_context_asof(rows)
    found.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(found.schema).parquet(f"{at}/rows").withColumn("pos", F.col("pos").cast(v.table("conversations").schema["turn"].dataType))


_add("r2_stream_context", _streamed_context, _QUERIES["r2_context_asof"][1])
_ATTEMPT = "case when (doc_id + pos + attempt) % 3 = 0 then ' ' else concat('std ', attempt, ' ', s) end"
_add("r4_choose_standardised", lambda v: references.choose_standardised(v.sents.withColumnRenamed("s", "text"), v.sents.selectExpr("*", "explode(array(0, 1, 2)) as attempt").selectExpr("doc_id", "pos", "attempt", f"{_ATTEMPT} as answer")).select("doc_id", "pos", "standard"),
     f"select doc_id, pos, coalesce(arg_min(a, attempt) filter (where trim(a) <> '' and attempt < 2), any_value(s)) as standard from (select *, {_ATTEMPT} as a from sents, (select unnest([0, 1, 2]) as attempt)) group by 1, 2", "sents")
_add("r5_paired_ends", lambda v: references.resolve_paired_ends(v.claims).select("doc_id", "pos", "text"), r"""select doc_id, pos, case when x is null then t else regexp_replace(t, '\bthe other end\b', '[' || x || '.EndB]', 'gi') end as text from (
 select *, regexp_replace(text, '\bone end of the (\w+)', '[\1.EndA]', 'gi') as t, last_value(nullif(regexp_extract(text, '(?i)\bone end of the (\w+)', 1), '') ignore nulls) over (partition by doc_id order by pos) as x from claims)""", "claims")  # fmt: skip

# Tokens
_LEX = [("the", "DET"), ("and", "CCONJ"), ("of", "ADP"), ("in", "ADP"), ("la", "DET"), ("die", "DET")]
_GAZ = [("of the", "PHRASE"), ("the", "ARTICLE"), ("in the", "PHRASE"), ("is", "COPULA"), ("de la", "PHRASE")]
_values = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
_table = lambda v, rows, *names: v.spark.sql(f"select * from values {_values(rows)} as t({', '.join(names)})")  # noqa: E731  (of known size, so it is broadcast)
_add("k1_tokens_from_text", lambda v: tokens.tokens_from_text(v.sents, _table(v, _LEX, "lemma", "pos_tag")), f"select doc_id, sent, tok, text, lemma, coalesce(x.p, 'NOUN') as pos_tag from (select doc_id, sent, tok, text, lemma from toks) left join (values {_values(_LEX)}) x(lemma, p) using (lemma)", "toks")
_add("k2_subtree_spans", lambda v: v.spans, "select doc_id, sent, tok, l as \"left\", r as \"right\", text from spans", "spans")
_add("k3_noun_chunks", lambda v: v.chunks, "select doc_id, sent, head_tok, start, chunk, head_lemma from chunks", "chunks")
_add("k4_verb_lemmas", lambda v: tokens.verb_lemmas(v.toks), "select doc_id, sent, tok, lemma from toks where pos_tag = 'VERB'", "toks")
_add("k5_gazetteer", lambda v: tokens.gazetteer_entities(v.sentence_toks, _table(v, _GAZ, "entity", "label")), f"select doc_id, sent, tok, entity, label from (select doc_id, sent, tok, unnest([lemma, lemma || ' ' || n1, lemma || ' ' || n1 || ' ' || n2]) as entity from (select *, lead(lemma) over w as n1, lead(lemma, 2) over w as n2 from toks window w as (partition by doc_id, sent order by tok))) join (values {_values(_GAZ)}) g(entity, label) using (entity)", "toks")
_add("k6_word_nodes", lambda v: tokens.word_nodes(v.toks).select("lemma", "freq", F.explode("pos").alias("pos_tag", "n")), "select lemma, sum(n) over (partition by lemma) as freq, pos_tag, n from (select lemma, pos_tag, count(*) as n from toks group by 1, 2)", "toks")
_add("k7_word_edges", lambda v: tokens.word_edges(v.token_rows()), "select * from wedges", "wedges")
_add("k8_root_by_frequency", lambda v: tokens.root_by_frequency(v.chunks), "select doc_id, arg_max(head_lemma, row(n, -s, -t)) as root from (select doc_id, head_lemma, count(*) as n, min(sent * 1000000 + start) // 1000000 as s, min(sent * 1000000 + start) % 1000000 as t from (select doc_id, head_lemma, sent, start from chunks) group by 1, 2) group by 1", "chunks")

# Relations
_W = _list(WORDS)
_HEADS = "join toks h on h.doc_id = v.doc_id and h.sent = v.sent and h.tok = v.head"
_XCOLS = "doc_id", "sent", "tok", "src", "dst", "rel", "weight"


def _kid(of: str, *deps: str) -> str:
    return f"(select doc_id, sent, head as {of}, min(tok) as k from toks where head <> tok and dep in ({_list(deps)}) group by 1, 2, 3)"


_VERB_BELOW = "(select doc_id, sent, anc as tok, arg_min(lemma, tok) as verb from (select p.doc_id, p.sent, p.anc, p.tok, t.lemma from pairs p join toks t on t.doc_id = p.doc_id and t.sent = p.sent and t.tok = p.tok where t.pos_tag = 'VERB') group by 1, 2, 3)"
_add("x1_part_of", lambda v: relations.rel_part_of(v.token_rows(), WORDS).select(*_XCOLS), f"""select v.doc_id, v.sent, v.tok, a.np as src, b.np as dst, 'part-of' as rel, 3.0::double as weight from (
 select t.*, coalesce(s.k, case when h.pos_tag = 'NOUN' then t.head end) as whole from toks t join toks h on h.doc_id = t.doc_id and h.sent = t.sent and h.tok = t.head
 left join {_kid('tok', 'nsubj', 'nsubjpass')} s on s.doc_id = t.doc_id and s.sent = t.sent and s.tok = t.tok where t.pos_tag = 'VERB' and t.lemma in ({_W})) v
 join np a on a.doc_id = v.doc_id and a.sent = v.sent and a.tok = v.whole
 join (select doc_id, sent, head as tok, tok as part from toks where dep in ('dobj', 'obj') and head <> tok union all
   select p.doc_id, p.sent, p.head, o.tok from toks p join toks o on o.doc_id = p.doc_id and o.sent = p.sent and o.head = p.tok and o.dep = 'pobj' and o.head <> o.tok where p.dep = 'prep' and p.head <> p.tok) x
   on x.doc_id = v.doc_id and x.sent = v.sent and x.tok = v.tok
 join np b on b.doc_id = v.doc_id and b.sent = v.sent and b.tok = x.part""", "np")  # fmt: skip
_add("x2_function_marker", lambda v: relations.rel_function_marker(v.token_rows(), WORDS).select(*_XCOLS), f"select v.doc_id, v.sent, v.tok, a.np as src, x.verb as dst, 'function-of' as rel, 2.0::double as weight from toks v join np a on a.doc_id = v.doc_id and a.sent = v.sent and a.tok = v.head join {_VERB_BELOW} x on x.doc_id = v.doc_id and x.sent = v.sent and x.tok = v.tok where lower(v.text) in ({_W}) and v.dep in ('amod', 'acl')", "np")
_add("x3_function_verb", lambda v: relations.rel_function_verb(v.token_rows(), WORDS).select(*_XCOLS), f"""select v.doc_id, v.sent, v.tok, a.np as src, x.verb as dst, 'function-of' as rel, 2.0::double as weight from toks v
 join {_kid('tok', 'nsubj', 'nsubjpass')} s on s.doc_id = v.doc_id and s.sent = v.sent and s.tok = v.tok join np a on a.doc_id = v.doc_id and a.sent = v.sent and a.tok = s.k
 join (select doc_id, sent, anc as tok, arg_min(verb, t) as verb from (select p.doc_id, p.sent, p.anc, p.tok as t, b.verb from pairs p join toks t on t.doc_id = p.doc_id and t.sent = p.sent and t.tok = p.tok and lower(t.text) = 'to' join {_VERB_BELOW} b on b.doc_id = p.doc_id and b.sent = p.sent and b.tok = p.tok) group by 1, 2, 3) x
   on x.doc_id = v.doc_id and x.sent = v.sent and x.tok = v.tok where v.pos_tag = 'VERB' and v.lemma in ({_W})""", "np")  # fmt: skip
_add("x4_property", lambda v: relations.chunk_properties(v.parsed).select(*_XCOLS), r"select c.doc_id, c.sent, t.tok, trim(regexp_replace(regexp_replace(chunk, '(^|[^\pL\pN_])said\s+', '\1the ', 'gi'), '\s+', ' ', 'g'), ' ,;') as src, t.lemma as dst, 'property-of' as rel, 1.0::double as weight from chunks c join toks t on t.doc_id = c.doc_id and t.sent = c.sent and t.head = c.head_tok and t.tok <> t.head and t.dep = 'amod'", "chunks")
_add("x5_spatial", lambda v: relations.rel_spatial(v.token_rows(), WORDS).select(*_XCOLS), f"""select v.doc_id, v.sent, v.tok, a.np as src, b.np as dst, 'spatial' as rel, 1.0::double as weight from toks v {_HEADS}
 join {_kid('tok', 'pobj')} o on o.doc_id = v.doc_id and o.sent = v.sent and o.tok = v.tok join np b on b.doc_id = v.doc_id and b.sent = v.sent and b.tok = o.k
 left join {_kid('tok', 'dobj', 'obj', 'nsubj', 'nsubjpass')} g on g.doc_id = v.doc_id and g.sent = v.sent and g.tok = v.head
 join np a on a.doc_id = v.doc_id and a.sent = v.sent and a.tok = case h.pos_tag when 'NOUN' then v.head when 'VERB' then g.k end where v.pos_tag = 'ADP' and v.lemma in ({_W})""", "np")  # fmt: skip
_marked_rows = lambda v: v.token_rows(dep=_MARKS.replace("else dep", f"else {DEP}"))
_MARKS = "case when tok % 7 = 0 and tok > 0 then 'mark' else dep end"
_add("x6_condition", lambda v: relations.rel_condition(_marked_rows(v), WORDS).select(*_XCOLS), f"""select v.doc_id, v.sent, v.tok, a.np as src, trim(b.text, ' ,;') as dst, 'condition' as rel, 1.0::double as weight from toks v
 join {_kid('tok', 'nsubj', 'dobj', 'obj')} g on g.doc_id = v.doc_id and g.sent = v.sent and g.tok = v.head join np a on a.doc_id = v.doc_id and a.sent = v.sent and a.tok = g.k
 join np b on b.doc_id = v.doc_id and b.sent = v.sent and b.tok = v.head where v.dep = 'det' and v.lemma in ({_W})""", "np")  # fmt: skip
_ALL_WORDS = dict.fromkeys(("part", "marker", "function", "spatial", "condition"), WORDS)


def _concept_labels(v: Views) -> DataFrame:
    return finds.concept_nodes(finds.concepts(_marked_rows(v), **_ALL_WORDS))


def _plain(name: str) -> str:
    """A registered query's SQL without the views, which the one that holds it brings."""
    sql = _QUERIES[name][1]
    return sql[sql.index("select v.doc_id") if "select v.doc_id" in sql else sql.index("select c.doc_id, c.sent") :]


_ENDS = " union all ".join(f"select doc_id, unnest([src, dst]) as label from ({_plain(x)})" for x in ("x1_part_of", "x2_function_marker", "x3_function_verb", "x4_property", "x5_spatial", "x6_condition"))
_add("x7_concept_nodes", lambda v: _concept_labels(v), r"""select distinct doc_id, label from (select doc_id, trim(regexp_replace(regexp_replace(chunk, '(^|[^\pL\pN_])said\s+', '\1the ', 'gi'), '\s+', ' ', 'g'), ' ,;') as label from chunks
 union all """ + _ENDS + ") where label <> ''", "chunks", "np")  # fmt: skip
_REL = "case pos % 5 when 0 then 'part-of' when 1 then 'function-of' when 2 then 'spatial' when 3 then 'condition' else 'other' end"
_add("x8_rel_weight", lambda v: relations.with_rel_weight(v.triples.selectExpr("doc_id", "pos", f"{_REL} as rel")), f"select doc_id, pos, rel, case rel when 'part-of' then 3.0 when 'function-of' then 2.0 else 1.0 end::double as weight from (select doc_id, pos, {_REL} as rel from triples)", "triples")
_add("x9_svo_triples", lambda v: relations.svo_triples(v.token_rows()), f"""with s as (select * from {_kid('tok', 'nsubj', 'nsubjpass', 'csubj')}),
 o as (select doc_id, sent, head as tok, tok as child, -1 as sub, text as word, null as prep from toks where dep = 'dobj' and head <> tok union all
  select p.doc_id, p.sent, p.head, p.tok, o.tok, null, p.text from toks p join toks o on o.doc_id = p.doc_id and o.sent = p.sent and o.head = p.tok and o.head <> o.tok and o.dep = 'pobj' where p.dep = 'prep' and p.head <> p.tok),
 g as (select o.doc_id, o.sent, o.tok, string_agg(case when sub < 0 then n.text else prep || ' ' || n.text end, '; ' order by child, sub) as object from o join spans n on n.doc_id = o.doc_id and n.sent = o.sent and n.tok = case when sub < 0 then child else sub end group by 1, 2, 3)
 select v.doc_id, v.sent, v.tok, coalesce(n.text, '_') as subject, v.lemma as verb, coalesce(g.object, '_') as object from toks v left join s on s.doc_id = v.doc_id and s.sent = v.sent and s.tok = v.tok
 left join spans n on n.doc_id = v.doc_id and n.sent = v.sent and n.tok = s.k left join g on g.doc_id = v.doc_id and g.sent = v.sent and g.tok = v.tok where v.pos_tag = 'VERB' and (n.text is not null or g.object is not null or v.head = v.tok)""".replace("with s as", ", s as", 1), "spans")  # fmt: skip
_NEG = "case when tok % 8 in (3, 4) then 'neg' when tok % 8 in (1, 6) then 'prt' else dep end"
_add("x10_verb_phrase", lambda v: relations.verb_phrase(v.token_rows(dep=_NEG.replace("else dep", f"else {DEP}"))), """select v.doc_id, v.sent, v.tok, concat_ws(' ', n.neg, v.lemma, n.prt) as phrase from toks v left join
 (select doc_id, sent, head as tok, arg_max(text, tok) filter (where tok % 8 in (3, 4)) as neg, string_agg(text, ' ' order by tok) filter (where tok % 8 in (1, 6)) as prt from toks where head <> tok group by 1, 2, 3) n using (doc_id, sent, tok) where v.pos_tag = 'VERB'""", "toks")  # fmt: skip
_add("x11_copular", lambda v: relations.copular_triples(v.copula_rows), """select r.doc_id, r.sent, 0 as tok, coalesce(s.text, '_') as subject, c.lemma as verb, coalesce(m.text, o.text) as object from copula r join copula c on c.doc_id = r.doc_id and c.sent = r.sent and c.tok = 2 and c.dep = 'cop'
 left join copula_spans s on s.doc_id = r.doc_id and s.sent = r.sent and s.tok = 1 join copula_spans o on o.doc_id = r.doc_id and o.sent = r.sent and o.tok = 0
 left join copula_spans m on m.doc_id = r.doc_id and m.sent = r.sent and m.tok = 3 and r.sent % 2 = 0 where r.tok = 0""", "copula_spans")  # fmt: skip
_add("x12_distinct_triples", lambda v: relations.distinct_triples(v.triples), "select doc_id, subject, surface_pred, object, min(pos) as pos from triples group by 1, 2, 3, 4", "triples")
_add("x13_modality", _claims(T.tag_modality), r"select doc_id, pos, case when regexp_matches(text, '(?i)\b(may|can)\b') then 'capability' when regexp_matches(text, '(?i)\b(must|required)\b') then 'requirement' when regexp_matches(text, '(?i)\boptional\b') then 'optional' else '' end as out from claims", "claims")
_add("x14_condition_text", _claims(T.extract_condition), r"select doc_id, pos, regexp_extract(text, '(?i)\b(?:when|if|so that)\b.*', 0) as out from claims", "claims")

# Answers
_add("l1_requests", lambda v: answers.build_requests(v.claims.selectExpr("doc_id", "pos", "concat('s', pos + 1) as sid", "text"), "Extract: ", 120), "select doc_id, count(*) as n, concat('Extract: ', to_json(list(struct_pack(sid := sid, text := text) order by pos))::varchar) as request from (select doc_id, pos, concat('s', pos + 1) as sid, text, row_number() over (partition by doc_id order by pos) as k from claims) where k <= 120 group by 1", "claims")
_add("l2_batches", lambda v: answers.batch_rows(v.triples).select("doc_id", "pos", "batch"), "select doc_id, pos, (row_number() over (partition by doc_id order by pos) - 1) // 40 as batch from triples", "triples")


def _raw(v: Views) -> DataFrame:
    """Answers of several forms with whole sentences in them."""
    quoted = F.to_json(F.col("s").cast("variant"))
    raw = F.when(F.col("pos") % 5 == 0, F.to_json(F.struct(F.array("s").alias("sentences")))).when(F.col("pos") % 5 == 1, F.concat(F.lit('sure: {"sentences": ['), quoted, F.lit(", 1]} bye")))
    raw = raw.when(F.col("pos") % 5 == 2, '{"sentences": "a"}').when(F.col("pos") % 5 == 3, F.concat(F.lit("no json: "), F.col("s"))).otherwise('{"sentences": ["x", "y"]}')
    return v.sents.select("doc_id", "pos", raw.alias("raw"))


_add("l3_parse_json", lambda v: _raw(v).select("doc_id", "pos", F.to_json(answers.parse_json_answer(F.col("raw"))).alias("out")), """select doc_id, pos, case pos % 5 when 0 then concat('{"sentences":[', to_json(s)::varchar, ']}') when 1 then concat('{"sentences":[', to_json(s)::varchar, ',1]}') when 2 then '{"sentences":"a"}' when 4 then '{"sentences":["x","y"]}' end as out from sents""", "sents")
_add("l4_answer_sentences", lambda v: _raw(v).select("doc_id", "pos", F.array_join(answers.answer_sentences(answers.parse_json_answer(F.col("raw"))), "|").alias("out")), "select doc_id, pos, case when pos % 5 in (0, 1) then s when pos % 5 = 4 then 'x|y' else '' end as out from sents", "sents")
_PAIR = "case pos % 4 when 0 then to_json(named_struct('sentence1', s, 'sentence2', '')) when 1 then to_json(named_struct('sentence2', s, 'sentence1', ' ')) when 2 then '{\"sentence1\": null}' else concat('[', pos, ']') end"
_add("l4_answer_pair", lambda v: v.sents.select("doc_id", "pos", F.array_join(answers.answer_pair(F.expr(_PAIR), F.concat(F.lit(" "), "s")), "|").alias("out")), "select doc_id, pos, case pos % 4 when 0 then s when 1 then concat(' |', s) when 2 then '' else trim(s) end as out from sents", "sents")


def _attempts(v: Views) -> DataFrame:
    """Three attempts for a request; some return a blank beside their sentence, or white space around it."""
    raw = F.when(F.col("pos") % 7 == 0, '{"sentences": ["a", ""]}').when(F.col("pos") % 7 == 1, '{"sentences": ["  b "]}').when(F.col("pos") % 7 == 2, '{"sentences": [" "]}').otherwise(F.col("raw"))
    return _raw(v).withColumn("raw", raw).selectExpr("doc_id", "cast(floor(pos / 3) as string) as request_id", "pos % 3 as attempt", "raw")


_ANSWERS = "(select doc_id, cast(pos // 3 as varchar) as request_id, pos % 3 as attempt, case when pos % 7 = 0 then ['a', ''] when pos % 7 = 1 then ['  b '] when pos % 7 = 2 then [' '] when pos % 5 in (0, 1) then [s] when pos % 5 = 4 then ['x', 'y'] else [] end as l from sents)"
_VALID = "len(l) = 1 and trim(l[1]) <> ''"
_add("l5_first_valid", lambda v: answers.first_valid_attempt(_attempts(v).select("doc_id", "request_id").distinct(), _attempts(v)), f"select doc_id, request_id, coalesce(arg_min(trim(l[1]), attempt) filter (where {_VALID}), '') as answer from {_ANSWERS} group by 1, 2", "sents")
_add("b3_retries", lambda v: answers.retry_rows(_attempts(v)), f"select doc_id, request_id, attempt, cast(len(l) as int) as returned_count from {_ANSWERS} a where not exists (select 1 from {_ANSWERS} b where b.doc_id = a.doc_id and b.request_id = a.request_id and b.attempt <= a.attempt and len(b.l) = 1 and trim(b.l[1]) <> '')", "sents")
_add("l6_words_preserved", lambda v: v.sents.selectExpr("doc_id", "pos", "s", "case when pos % 4 = 0 then substring(s, 3) else s end as t").select("doc_id", "pos", answers.words_preserved(F.col("s"), F.split("t", ", ")).alias("out")), f"select doc_id, pos, {_WORDS.format('s')} = {_WORDS.format('replace(t, chr(44) || chr(32), chr(32))')} as out from (select *, case when pos % 4 = 0 then substring(s, 3) else s end as t from sents)", "sents")

# Graph building
_DIRTY = "case when pos % 9 = 0 then '' when pos % 9 = 1 then concat(' ', subject, ' ') else subject end"
_add("g1_clean_triples", lambda v: kg.clean_triples(v.triples.withColumn("subject", F.expr(_DIRTY)).withColumn("modality", F.expr("case when pos % 2 = 0 then ' optional ' end"))), f"select doc_id, pos, trim(sid) as sid, trim({_DIRTY}) as subject, trim(surface_pred) as surface_pred, trim(object) as object, '' as condition_text, case when pos % 2 = 0 then 'optional' else '' end as modality from triples where {_DIRTY} <> '' and surface_pred <> '' and object <> ''", "triples")
_add("g2_clean_relations", lambda v: kg.clean_relations(v.triples.selectExpr("doc_id", "pos", "concat(' ', surface_pred) as name", "case when pos % 2 = 0 then object end as definition", "subject as domain_hint", "cast(null as string) as range_hint")), "select doc_id, surface_pred as name, coalesce(arg_min(case when pos % 2 = 0 then object else '' end, pos), '') as definition, arg_min(subject, pos) as domain_hint, '' as range_hint from triples where trim(surface_pred) <> '' group by 1, 2", "triples")
_ENT = "(select doc_id, label, first_pos, concat('E', row_number() over (partition by doc_id order by first_pos, label)) as id from (select doc_id, object as label, min(pos) as first_pos from triples group by 1, 2))"
_mentions = lambda v: v.triples.select("doc_id", "pos", F.col("object").alias("label"))
_add("g3_entity_dictionary", lambda v: kg.entity_dictionary(_mentions(v)), f"select * from {_ENT}", "triples")
_add("g4_annotate_refs", lambda v: kg.annotate_refs(v.sents.select("doc_id", F.concat(F.lit("s"), F.col("pos") + 1).alias("sid"), F.col("s").alias("text")), kg.entity_dictionary(_phrases(v.triples))),
     "select doc_id, concat('s', pos + 1) as sid, case when out is null then array_to_string(p, '') else array_to_string(list_transform(p, lambda x, i: x || coalesce('[Ref:' || list_filter(out, lambda o: o.e = i + 1)[1].value || ']', '')), '') end as text from "
     + _mentions_sql("(select doc_id, pos, s as text from sents)", f"(select doc_id, label as phrase, concat('E', row_number() over (partition by doc_id order by first_pos, label)) as value from (select doc_id, label, min(pos) as first_pos from ({_PHRASES}) group by 1, 2))", "doc_id"), "triples")
_add("g5_kg_nodes", lambda v: pipelines.kg.build_kg(kg.entity_dictionary(_mentions(v)), v.triples)[0], f"select doc_id, id, label, 'Entity' as type from {_ENT}", "triples")
_add("g5_kg_edges", lambda v: pipelines.kg.build_kg(kg.entity_dictionary(_mentions(v)), v.triples)[1], "select doc_id, subject as source, object as target, surface_pred as predicate, sid as evidence from triples", "triples")
_KEY = "doc_id, sid, subject, object, surface_pred"
_TALLY = f"(select {_KEY}, canonical_pred, count(*) as n, min(pos * 10 + v) as first from votes where subject <> '' and object <> '' and surface_pred <> '' and canonical_pred <> '' group by all)"
_MAJOR = f"(select {_KEY}, arg_max(canonical_pred, row(n, -first)) as predicate, round(max(n) / sum(n), 6) as confidence, min(first) // 10 as pos from {_TALLY} group by all)"
_SLUG = "concat('custom_', trim(regexp_replace(lower(surface_pred), '[^a-z0-9]+', '_', 'g'), '_'))"
_LABEL = rf"lower(trim(regexp_replace(regexp_replace({{0}}, '{_B}(for|of|the|a|an|said){_E}', '\1\3', 'gi'), '\s+', ' ', 'g')))"
_FALL = f"(select doc_id, pos, sid, {_LABEL.format('subject')} as subject, {_LABEL.format('object')} as object, surface_pred, {_SLUG} as predicate, 0.4::double as confidence from triples where doc_id not in (select doc_id from votes))"
_ALL = f"(select doc_id, cast(pos as int) as pos, sid, subject, object, surface_pred, predicate, confidence from {_MAJOR} union all select * from {_FALL})"
_NODES = f"(select doc_id, label, concat('N', row_number() over (partition by doc_id order by o)) as id from (select doc_id, label, min(o) as o from (select doc_id, subject as label, row(pos, sid, subject, object, surface_pred, 0) as o from {_ALL} union all select doc_id, object, row(pos, sid, subject, object, surface_pred, 1) from {_ALL}) group by 1, 2))"
_EDGES = f"(select e.doc_id, s.id as source, o.id as target, predicate, surface_pred, sid as evidence, confidence, pos from {_ALL} e join {_NODES} s on s.doc_id = e.doc_id and s.label = e.subject join {_NODES} o on o.doc_id = e.doc_id and o.label = e.object where predicate = 'part_of' or starts_with(predicate, 'custom_'))"
_major = lambda v: kg.majority_predicate(kg.tally_votes(v.votes))
_add("g6_tally_votes", lambda v: kg.tally_votes(v.votes).select(*kg.KEY, "canonical_pred", "n"), f"select {_KEY}, canonical_pred, n from {_TALLY}", "votes")
_add("g7_majority", lambda v: _major(v).select(*kg.KEY, "predicate"), f"select {_KEY}, predicate from {_MAJOR}", "votes")
_add("g8_confidence", lambda v: _major(v).select(*kg.KEY, "confidence"), f"select {_KEY}, confidence from {_MAJOR}", "votes")
_voted = lambda v: kg.voted_graph(v.triples, v.votes, ("part_of",))
_add("g9_node_ids", lambda v: _voted(v)[0], f"select * from {_NODES}", "votes")
_add("g10_g11_edges", lambda v: _voted(v)[1], f"select * from {_EDGES}", "votes")
_add("g12_fallback", lambda v: kg.fallback_edges(v.triples, v.votes), f"select * from {_FALL}", "votes")


def _bare_documents(v: Views) -> DataFrame:
    """Each document with the number of its nodes and edges, where every third document's triples lose their subjects."""
    triples = kg.clean_triples(v.triples.withColumn("subject", F.expr("case when doc_id % 3 = 0 then '' else subject end")))
    nodes, edges = kg.voted_graph(triples, v.votes.join(triples.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi"), ("part_of",))
    counts = [df.groupBy("doc_id").agg(F.count("*").alias(name)) for df, name in ((nodes, "n_nodes"), (edges, "n_edges"))]
    zero = F.lit(0).cast("bigint")
    return v.triples.select("doc_id").distinct().join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left").select("doc_id", F.coalesce("n_nodes", zero).alias("n_nodes"), F.coalesce("n_edges", zero).alias("n_edges"))


_add("g13_empty", _bare_documents, f"select doc_id, case when doc_id % 3 = 0 then 0 else coalesce(n_nodes, 0) end as n_nodes, case when doc_id % 3 = 0 then 0 else coalesce(n_edges, 0) end as n_edges from (select distinct doc_id from triples) left join (select doc_id, count(*) as n_nodes from {_NODES} group by 1) using (doc_id) left join (select doc_id, count(*) as n_edges from {_EDGES} group by 1) using (doc_id)", "votes")
_add("g14_evidence", lambda v: kg.edge_evidence(_voted(v)[1], v.sents.select("doc_id", F.concat(F.lit("s"), F.col("pos") + 1).alias("sid"), F.col("s").alias("text"))), f"select e.*, s as evidence_text from {_EDGES} e left join (select doc_id, concat('s', pos + 1) as evidence, s from sents) using (doc_id, evidence)", "votes")
_add("g15_lineage", lambda v: kg.lineage(v.triples.select("doc_id", F.col("subject").alias("parent"), F.col("object").alias("child"))).select("doc_id", "id", F.array_join("parents", " ").alias("parents"), F.array_join("children", " ").alias("children")), """select doc_id, id, coalesce(p, '') as parents, coalesce(c, '') as children from
 (select doc_id, object as id, array_to_string(list_sort(list(distinct subject)), ' ') as p from triples group by 1, 2) full join (select doc_id, subject as id, array_to_string(list_sort(list(distinct object)), ' ') as c from triples group by 1, 2) using (doc_id, id)""", "triples")  # fmt: skip


_NAMES = "case when pos % 7 = 0 then 'part_of' when pos % 7 = 1 then ' connected_to ' else '' end"
#: Splits of the sentences that have a comma, at commas; documents without one fall back to their sentences.
_COMMA = "(select doc_id, concat('s', pos + 1, '.', k) as sid, trim(x) as text, concat('s', pos + 1) as parent, pos * 100 + k - 1 as place, x <> '' as ok from (select doc_id, pos, generate_subscripts(l, 1) as k, unnest(l) as x from (select doc_id, pos, string_split(s, ', ') as l from sents where contains(s, ', '))))"
_KG_SPLITS = f"(select doc_id, sid, text, parent, place from {_COMMA} where ok union all select doc_id, concat('s', pos + 1, '.1'), s, concat('s', pos + 1), pos * 100 from sents where doc_id not in (select doc_id from {_COMMA} where ok))"


def _kg(v: Views) -> dict[str, DataFrame]:
    def splits_of(sents: DataFrame) -> DataFrame:
        cut = sents.where("contains(s, ', ')").selectExpr("doc_id", "pos", "posexplode(split(s, ', ')) as (k, x)").where("x <> ''")
        return cut.selectExpr("doc_id", "concat('s', pos + 1, '.', k + 1) as sid", "trim(x) as text", "concat('s', pos + 1) as parent")

    def triples_of(splits: DataFrame) -> DataFrame:
        place = "(cast(regexp_extract(sid, 's([0-9]+)', 1) as int) - 1) * 100 + cast(regexp_extract(sid, '([0-9]+)$', 1) as int) - 1 as pos"
        w = splits.selectExpr("doc_id", "sid", place, "split(text, ' ') as w").where("size(w) >= 3")
        return w.selectExpr("doc_id", "pos", "sid", "lower(w[0]) as subject", "lower(w[1]) as surface_pred", "lower(w[size(w) - 1]) as object")

    def relations_of(splits: DataFrame) -> DataFrame:
        triples = triples_of(splits)
        return triples.selectExpr("doc_id", "pos", f"{_NAMES} as name", "'' as definition", "'' as domain_hint", "'' as range_hint")

    def votes_of(triples: DataFrame) -> DataFrame:
        several = triples.selectExpr("*", "count(*) over (partition by doc_id) as n").where("n > 1")
        return several.selectExpr("*", "explode(array(0, 1, 2)) as v").selectExpr("doc_id", "pos", "v", "sid", "subject", "object", "surface_pred", f"{CANONICAL} as canonical_pred")

    return pipelines.text_to_kg(v.documents, splits_of, triples_of, votes_of, relations_of)


def text_to_kg(v: Views) -> DataFrame:
    """The flagship's tables in one line per document: splits, relations, nodes and edges counted, with the mean confidence."""
    out = _kg(v)
    n = lambda table, name, *more: out[table].groupBy("doc_id").agg(F.count("*").alias(name), *more)
    edges = n("edges", "n_edges", F.round(F.avg("confidence"), 4).alias("confidence"))
    return n("splits", "n_splits").join(n("relation_schema", "n_relations"), "doc_id", "left").join(n("nodes", "n_nodes"), "doc_id", "left").join(edges, "doc_id", "left")


_KG_TRIPLES = f"(select doc_id, place as pos, sid, lower(w[1]) as subject, lower(w[2]) as surface_pred, lower(w[len(w)]) as object from (select *, string_split(text, ' ') as w from {_KG_SPLITS}) where len(w) >= 3 and w[1] <> '' and w[2] <> '' and w[len(w)] <> '')"
_KG_SQL = f"""(with triples as materialized {_KG_TRIPLES},
 votes as (select doc_id, pos, v, sid, subject, object, surface_pred, {CANONICAL} as canonical_pred from triples cross join (select 0 v union all select 1 union all select 2) vv where doc_id in (select doc_id from triples group by 1 having count(*) > 1)),
 names as (select distinct doc_id, trim({_NAMES}) as name from {_KG_TRIPLES.replace(" and w[1] <> '' and w[2] <> '' and w[len(w)] <> ''", "")} where trim({_NAMES}) <> ''),
 n as (select doc_id, count(*) as n_nodes from {_NODES} group by 1),
 e as (select doc_id, count(*) as n_edges, round(avg(confidence), 4) as confidence from {_EDGES.replace("predicate = 'part_of'", "(e.doc_id, predicate) in (select doc_id, name from names)")} group by 1)
 select * from (select doc_id, count(*) as n_splits from {_KG_SPLITS} group by 1) left join (select doc_id, count(*) as n_relations from names group by 1) using (doc_id) left join n using (doc_id) left join e using (doc_id))"""
_add("g16_text_to_kg", text_to_kg, f"select * from {_KG_SQL}", "sents")


def _saved_kg(v: Views) -> DataFrame:
    """Rows of each of the flagship's tables after they were written and read again."""
    at = f"{shared_folder(v.spark)}/kg-{uuid.uuid4().hex}"
    tables = {k: df for k, df in _kg(v).items() if k != "input"} | {"input": v.documents}
    write_kg(tables, at)
    counts = [df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n")) for name, df in read_kg(v.spark, at, sorted(tables)).items()]
    return reduce(DataFrame.union, counts)


_add("s3_saved_kg", _saved_kg, f"select * from (select unnest(['input', 'splits', 'relation_schema', 'nodes', 'edges']) as name, unnest([(select count(*) from documents), sum(n_splits), sum(n_relations), sum(n_nodes), sum(n_edges)]) as n from {_KG_SQL}) where n > 0", "sents")


def _partitioned(v: Views) -> DataFrame:
    """The documents saved by language and one language's read back."""
    at = f"{shared_folder(v.spark)}/kg-{uuid.uuid4().hex}"
    write_kg({"input": v.documents}, at, partition_by="lang")
    return read_kg(v.spark, at)["input"].where("lang = 'en'").select("doc_id", "source", F.length("text").alias("chars"))


_add("s3_partitioned", _partitioned, "select doc_id, source, length(text) as chars from documents where lang = 'en'")


def _saved_graph(v: Views) -> tuple[DataFrame, DataFrame]:
    """The customers' graph, saved as XML by Spark and read again."""
    at = f"{shared_folder(v.spark)}/graph-{uuid.uuid4().hex}"
    value = lambda key, c: F.concat(F.lit(f'<attvalue for="{key}" value="'), c.cast("string"), F.lit('"/>'))
    nodes = v.table("customer").select(F.concat(F.lit('<node id="c'), "c_custkey", F.lit('" label="'), "c_name", F.lit('"><attvalues>'), value(0, F.col("c_nationkey")), value(1, F.col("c_acctbal").cast("double")), value(2, F.col("c_acctbal") > 0), F.lit("</attvalues></node>")).alias("x"))
    edges = v.table("orders").select(F.concat(F.lit('<edge id="'), "o_orderkey", F.lit('" source="c'), "o_custkey", F.lit('" target="o'), "o_orderkey", F.lit('" weight="2"><attvalues>'), value(3, F.col("o_orderstatus")), F.lit("</attvalues></edge>")).alias("x"))
    declared = [("node", 0, "nation", "long"), ("node", 1, "balance", "double"), ("node", 2, "good", "boolean"), ("edge", 3, "status", "string")]
    head = "".join(f'<attributes class="{c}"><attribute id="{i}" title="{t}" type="{k}"/></attributes>' for c, i, t, k in declared)
    nodes.union(edges).mapInArrow(_as_files(f'<gexf><graph defaultedgetype="directed">{head}', "</graph></gexf>"), "x string").write.text(at)
    return read_graph_xml(v.spark, at)


def _as_files(head: str, foot: str) -> Callable:
    """Each partition's lines between head and foot, so that each file is a document of its own."""

    def rows(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], ["x"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array([foot])], ["x"])

    return rows


_add("s2_graph_nodes", lambda v: _saved_graph(v)[0].selectExpr("id", "label", "try_variant_get(attributes['nation'], '$', 'bigint') as nation", "try_variant_get(attributes['balance'], '$', 'double') as balance", "try_variant_get(attributes['good'], '$', 'boolean') as good"), "select concat('c', c_custkey) as id, c_name as label, c_nationkey::bigint as nation, c_acctbal::double as balance, c_acctbal > 0 as good from customer")
_add("s2_graph_edges", lambda v: _saved_graph(v)[1].selectExpr("id", "source", "target", "weight", "directed", "try_variant_get(attributes['status'], '$', 'string') as status"), "select concat(o_orderkey) as id, concat('c', o_custkey) as source, concat('o', o_orderkey) as target, 2.0::double as weight, true as directed, o_orderstatus as status from orders")

def _two_graphs(v: Views) -> tuple[DataFrame, DataFrame]:
    """Customers' and suppliers' graphs in one folder, whose declarations use the same ids for different attributes, and of which one is directed."""
    at = f"{shared_folder(v.spark)}/graphs-{uuid.uuid4().hex}"
    for name, table, kind, link, declared, default in (("a", "customer", "c", "edge_c", ("nation", "long"), "directed"), ("b", "supplier", "s", "edge_s", ("account", "double"), "undirected")):
        key, value = ("c_custkey", "c_nationkey") if kind == "c" else ("s_suppkey", "s_acctbal")
        node = F.concat(F.lit(f'<node id="{kind}'), key, F.lit('"><attvalues><attvalue for="0" value="'), F.col(value).cast("string"), F.lit('"/></attvalues></node>'))
        edge = F.concat(F.lit(f'<edge id="{link}'), key, F.lit(f'" source="{kind}'), key, F.lit('" target="x"><attvalues><attvalue for="1" value="7"/><attvalue for="1" value="8"/></attvalues></edge>'))
        head = f'<gexf><graph defaultedgetype="{default}"><attributes class="node"><attribute id="0" title="{declared[0]}" type="{declared[1]}"/></attributes><attributes class="edge"><attribute id="1" title="{declared[0]}_why" type="{"string" if kind == "c" else "long"}"/></attributes>'
        v.table(table).select(F.concat(node, edge).alias("x")).mapInArrow(_as_files(head, "</graph></gexf>"), "x string").write.text(f"{at}/{name}")
    return read_graph_xml(v.spark, f"{at}/*")


_add("s2_graphs_nodes", lambda v: _two_graphs(v)[0].selectExpr("id", "array_join(map_keys(attributes), ',') as titles", "try_variant_get(attributes['nation'], '$', 'bigint') as nation", "try_variant_get(attributes['account'], '$', 'double') as account"),
     "select concat('c', c_custkey) as id, 'nation' as titles, c_nationkey::bigint as nation, null::double as account from customer union all select concat('s', s_suppkey), 'account', null, s_acctbal::double from supplier")
_add("s2_graphs_edges", lambda v: _two_graphs(v)[1].select("id", "source", "target", "directed", F.to_json(F.transform_values("attributes", lambda _, x: x)).alias("attributes")),
     """select concat('edge_c', c_custkey) as id, concat('c', c_custkey) as source, 'x' as target, true as directed, '{"nation_why":"7"}' as attributes from customer union all select concat('edge_s', s_suppkey), concat('s', s_suppkey), 'x', false, '{"account_why":7}' from supplier""")  # fmt: skip

# Graphs
_TE = "(select subject as src, object as dst, surface_pred as rel, length(surface_pred)::double as weight, pos, doc_id from triples)"
_STRONG = f"(select doc_id, src, dst, arg_max(rel, row(weight, -pos)) as rel, max(weight) as weight, arg_max(pos, row(weight, -pos)) as pos from {_TE} where src <> dst group by 1, 2, 3)"
_nodes = lambda e: e.select("doc_id", F.col("src").alias("id")).union(e.select("doc_id", "dst")).distinct()
_DEG = "(select doc_id, id, count(*) as degree, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select doc_id, src as id, 0 as i, 1 as o from {0} union all select doc_id, dst, 1, 0 from {0}) group by 1, 2)"
_add("n1_simple_digraph", lambda v: graph.simple_digraph(v.triple_edges), f"select doc_id, src, dst, arg_max(rel, pos) as rel from {_TE} group by 1, 2, 3", "triples")
_add("n2_strongest_edges", lambda v: graph.strongest_edges(v.triple_edges), f"select * from {_STRONG}", "triples")
_add("n3_degrees", lambda v: graph.degrees(_nodes(v.triple_edges), v.triple_edges), f"select * from {_DEG.format(_TE)}", "triples")
_add("n4_root_by_degree", lambda v: graph.root_by_degree(graph.degrees(_nodes(v.triple_edges), v.triple_edges)), f"select doc_id, arg_max(id, row(in_degree, degree, -k)) as id from (select *, row_number() over (partition by doc_id order by id) as k from {_DEG.format(_TE)}) group by 1", "triples")
_add("n5_boost_part_of", lambda v: graph.boost_part_of(v.word_graph).select("src", "dst", "rel", "weight"), "select a as src, b as dst, case when w_dep > 0 then 'part-of' else 'spatial' end as rel, weight + case when w_dep > 0 then 5.0 else 0.0 end::double as weight from wedges", "wedges")
_add("n6_best_parent_tree", lambda v: graph.best_parent_tree(v.word_graph), "select src, dst, rel, weight from (select a as src, b as dst, case when w_dep > 0 then 'part-of' else 'spatial' end as rel, weight::double as weight, row_number() over (partition by b order by weight desc, a) as k from wedges) where k = 1", "wedges")
_add("n6_best_parent_tree_cyclic", lambda v: graph.best_parent_tree(v.supply))
_add("n7_reachable", lambda v: graph.reachable(v.tree, v.table("region").where("r_name < 'B'").selectExpr("concat('r', r_regionkey) as id")), "select * from (with recursive s as (select concat('r', r_regionkey) as id from region where r_name < 'B' union select dst from tree join s on src = id) select id from s)", "tree")
_add("n7_induced_subgraph", lambda v: graph.induced_subgraph(v.tree, graph.reachable(v.tree, v.table("region").where("r_name < 'B'").selectExpr("concat('r', r_regionkey) as id"))).select("src", "dst"), "select src, dst from tree where src in (with recursive s as (select concat('r', r_regionkey) as id from region where r_name < 'B' union select dst from tree join s on src = id) select id from s)", "tree")
_COMP = "(select id, min(least(id, r, n)) over (partition by r) as component from (with recursive s as (select distinct src as r, src as n, src as id from tree where starts_with(src, 'r') union select r, src, dst from tree join s on src = id) select r, id, id as n from s))"
_add("n8_components", lambda v: graph.connected_components(v.tree), f"select id, component from {_COMP}", "tree")
_add("n8_largest_component", lambda v: graph.largest_component(graph.connected_components(v.tree)), f"select id, component from {_COMP} where component = (select component from {_COMP} group by 1 order by count(*) desc, component limit 1)", "tree")
_add("n9_spanning_forest", lambda v: graph.maximum_spanning_forest(v.tree), "select least(src, dst) as u, greatest(src, dst) as v, 3.0::double as weight from tree", "tree")
_add("n8_document_components", lambda v: graph.document_components(v.triple_edges), f"""select doc_id, id, min(o) as component from (with recursive e as materialized (select doc_id, src as a, dst as b from {_TE} union select doc_id, dst, src from {_TE}),
 r as (select doc_id, a as id, a as o from e union select r.doc_id, r.id, e.b from r join e on e.doc_id = r.doc_id and e.a = r.o) select * from r) group by 1, 2""", "triples")  # fmt: skip
_add("n7_reachable_cyclic", lambda v: graph.reachable(v.supply, v.table("supplier").where("s_suppkey % 20 = 3").selectExpr("concat('s', s_suppkey) as id")), "select * from (with recursive r as (select concat('s', s_suppkey) as id from supplier where s_suppkey % 20 = 3 union select dst from supply join r on src = id) select id from r)", "supply")
_add("n8_components_cyclic", lambda v: graph.connected_components(v.supply), """select id, min(o) as component from (with recursive e as materialized (select src as a, dst as b from supply union select dst, src from supply),
 r as (select a as id, a as o from e union select r.id, e.b from r join e on e.a = r.o) select * from r) group by 1""", "supply")  # fmt: skip
_add("n9_spanning_forest_weighted", lambda v: graph.maximum_spanning_forest(v.supply), """select u, v, weight from (with recursive p as materialized (select least(src, dst) as u, greatest(src, dst) as v, max(weight) as weight from supply where src <> dst group by 1, 2),
 b as materialized (select u as a, v as b, weight, u, v from p union all select v, u, weight, u, v from p),
 r as (select u, v, weight, u as o from p union select r.u, r.v, r.weight, b.b from r join b on b.a = r.o and (b.weight > r.weight or b.weight = r.weight and (b.u, b.v) < (r.u, r.v)))
 select u, v, weight from p where (u, v) not in (select u, v from r where o = v))""", "supply")  # fmt: skip
_add("n9_spanning_forest_words", lambda v: graph.maximum_spanning_forest(v.word_graph, single=True))
_add("n10_tree_rows", lambda v: graph.tree_rows(v.tree, v.table("region").selectExpr("concat('r', r_regionkey) as id")).select("root", "id", "depth", "rel", F.array_join(F.transform("path", lambda p: p["name"]), "/").alias("path")), "select root, id, depth, case when depth > 0 then 'part-of' end as rel, path from (with recursive s as (select concat('r', r_regionkey) as root, concat('r', r_regionkey) as id, 0 as depth, '' as path from region union all select root, dst, depth + 1, case when path = '' then dst else path || '/' || dst end from tree join s on src = id) select * from s)", "tree")
_add("n11_concept_tree", lambda v: pipelines.concept_tree(v.token_rows(), part=WORDS, marker=WORDS, function=WORDS, spatial=WORDS, condition=WORDS))
_add("n12_attributed_graph", lambda v: graph.attributed_graph(v.table("customer").selectExpr("concat('c', c_custkey) as id", "c_acctbal as coverage", "array(cast(c_acctbal as double), cast(c_nationkey as double)) as feat", "0.5D as importance"), v.table("orders").selectExpr("concat('c', o_custkey) as src", "concat('o', o_orderkey) as dst", "'places' as rel", "cast(o_totalprice as double) as weight")).select("id", "coverage", F.get("feat", F.lit(0)).alias("feat0"), F.get("feat", F.lit(1)).alias("feat1"), "importance", F.round("weighted_out", 2).alias("weighted_out")), "select concat('c', c_custkey) as id, c_acctbal as coverage, c_acctbal::double as feat0, c_nationkey::double as feat1, 0.5::double as importance, round(coalesce(w, 0), 2) as weighted_out from customer left join (select o_custkey, sum(o_totalprice)::double as w from orders group by 1) on o_custkey = c_custkey")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: voted edges with node ids and confidence."""
    return _voted(Views(spark, "/root/testdata/sf0.001"))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(Views(spark, sf_dir))) for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
