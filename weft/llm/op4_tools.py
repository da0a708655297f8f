"""Tool-call linking for chat formatting, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier. Calls are put in topological order of their
dependencies (the identifiers in their arguments), their arguments are checked against the tools' schemas, and each call
with its result is serialised as canonical JSON: at every depth keys in order of their UTF-16 units (as RFC 8785 has it), no
white space, and one form for each number: plain digits from 1e-6 up to below 1e21, else d.dde+x, never a trailing zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, write_shared

#: Names that schemas use for the kinds of JSON values, and how Spark names these kinds; integer goes by the value besides.
KINDS = {"string": "STRING", "integer": "BIGINT|DOUBLE|DECIMAL.*", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}
NUMBER = r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def _bound(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(text: Column, f) -> Column:
    """f(sign, digits, power) of a number's text: its value is sign digits * 10**power, digits without zeros at either end ('' for zero)."""
    part = lambda k: F.regexp_extract(text, NUMBER, k)

    def trimmed(x: Column) -> Column:
        left = F.ltrim(x["raw"], F.lit("0"))
        return F.struct(x["sign"].alias("sign"), F.rtrim(left, F.lit("0")).alias("digits"), x["power"].alias("power"), left.alias("left"))

    raw = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("raw"), (F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3))).alias("power"))
    return _bound(_bound(raw, trimmed), lambda x: f(x["sign"], x["digits"], x["power"] + F.length(x["left"]) - F.length(x["digits"])))


def canonical_number(text: Column) -> Column:
    """The one form of a number, from any text of it."""

    def form(sign: Column, digits: Column, power: Column) -> Column:
        size = F.length(digits)
        point = size + power
        exponent = F.concat(F.lit("e"), F.when(point > 1, F.lit("+")).otherwise(F.lit("")), (point - 1).cast("string"))
        plain = F.when(power >= 0, F.concat(digits, F.repeat(F.lit("0"), power)))
        plain = plain.when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        plain = plain.otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        far = F.concat(F.left(digits, F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")), exponent)
        return F.when(digits == "", F.lit("0")).otherwise(F.concat(sign, F.when((point > -6) & (point <= 21), plain).otherwise(far)))

    return _number(text, form)


def quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _kind(value: Column) -> Column:
    return F.call_function("schema_of_variant", value)


def canonical(value: Column) -> Column:
    """Canonical JSON of a variant: its own text, which has keys in order and no white space, with each number outside the strings in its one form."""
    # no control character stands in a JSON text, so two of them can stand for the escapes that would confuse the quotes
    text = F.replace(F.replace(F.to_json(value), F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))

    def outside(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^-?[0-9]")), canonical_number(t)).otherwise(t)), "")

    parts = F.transform(F.split(text, '"'), lambda x, i: F.when((i % 2 == 0) & F.rlike(x, F.lit("[0-9]")), outside(x)).otherwise(x))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))


def beyond_double(json: Column) -> Column:
    """Does a JSON text hold a number that is beyond doubles?"""
    structure = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*"', "")  # without its strings
    numbers = F.regexp_extract_all(structure, F.lit(r"[0-9][0-9.eE+-]*"), F.lit(0))
    return F.exists(numbers, lambda x: F.coalesce(x.try_cast("double") == float("inf"), F.lit(False)))


def topological_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of dependencies below a call; calls on or above a cycle are absent.

    A call with one dependency is one step above it, so chains of such calls are climbed by pointer doubling: rounds grow
    with the logarithm of their length. Only calls with several dependencies are then taken level by level, in as many
    rounds as such calls stand on each other. Sorted by (level, turn, call_id) a conversation's calls stand after all they
    depend on. No conversation is gathered in one place.
    """
    key = ["conv_id", "call_id"]
    edges = write_shared(edges.distinct(), "edges")
    counts = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("needs"))
    none = calls.select(*key).join(edges, key, "left_anti").withColumn("level", F.lit(0))
    jump = write_shared(counts.where("n = 1").select(*key, F.col("needs").alias("top"), F.lit(1).alias("steps"), F.lit(False).alias("done")), "jump")
    climbing, before = jump.count(), None
    while climbing and climbing != before:  # each round some climb ends, until only those on or above cycles are left
        over = jump.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        step = jump.where("not done").join(over, ["conv_id", "top"], "left")
        step = step.select(*key, F.coalesce("top2", "top").alias("top"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("done2", F.lit(True)).alias("done"))
        jump = write_shared(jump.where("done").union(step), "jump", replaces=jump)
        climbing, before = jump.where("not done").count(), climbing
    below = jump.where("done").select("conv_id", F.col("call_id").alias("needs"), "top", "steps")
    several = edges.join(counts.where("n > 1").select(*key), key, "left_semi")
    endless = jump.where("not done").select("conv_id", F.col("call_id").alias("needs"))
    # a dependency on a call with one dependency is one on the top of its chain, steps further away
    pending = several.join(endless.withColumn("lost", F.lit(True)), ["conv_id", "needs"], "left").join(below, ["conv_id", "needs"], "left")
    pending = write_shared(pending.select(*key, F.when(F.col("lost").isNull(), F.coalesce("top", "needs")).alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "pending")
    known = write_shared(none, "known")
    while not pending.isEmpty():
        met = pending.join(known.withColumnRenamed("call_id", "top"), ["conv_id", "top"], "left")
        ready = met.groupBy(*key).agg(F.count("*").alias("n"), F.count("level").alias("k"), F.max(F.col("level") + F.col("steps")).alias("level")).where("n = k").select(*key, "level")
        ready = write_shared(ready, "ready")
        if ready.isEmpty():
            break
        pending = write_shared(pending.join(ready, key, "left_anti").select(*pending.columns), "pending", replaces=pending)
        known = write_shared(known.union(ready), "known", replaces=known)
    chained = below.withColumnRenamed("needs", "call_id").join(known.withColumnRenamed("call_id", "top"), ["conv_id", "top"])
    return known.select(*key, "level").union(chained.select(*key, (F.col("level") + F.col("steps")).alias("level")))


def argument_errors(values: Column, schema: Column) -> Column:
    """Sorted array of what is wrong: missing:p, type:p, unknown:p; schema: map of parameter -> struct(kind, required). No schema: tool."""

    def kind_differs(e: Column) -> Column:
        kind = F.try_element_at(schema, e["key"])["kind"]
        pattern = F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), kind)
        right = F.rlike(_kind(e["value"]), F.concat(F.lit("^("), pattern, F.lit(")$")))
        whole = (kind != "integer") | _number(e["value"].cast("string"), lambda _, digits, power: (digits == "") | (power >= 0))
        return kind.isNotNull() & ~F.coalesce(right & whole, F.lit(False))

    given = F.map_entries(values)
    missing = F.transform(F.filter(F.map_entries(schema), lambda s: s["value"]["required"] & ~F.map_contains_key(values, s["key"])), lambda s: F.concat(F.lit("missing:"), s["key"]))
    wrong = F.transform(F.filter(given, kind_differs), lambda e: F.concat(F.lit("type:"), e["key"]))
    unknown = F.transform(F.filter(given, lambda e: ~F.map_contains_key(schema, e["key"])), lambda e: F.concat(F.lit("unknown:"), e["key"]))
    return F.when(schema.isNull(), F.array(F.lit("tool"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, depends_on: str = "$.after") -> DataFrame:
    """One row per call and per result without a call: conv_id, call_id, turn, name, level, status, n_results, errors, message.

    calls: conv_id, call_id, turn, name, arguments (JSON text). results: conv_id, call_id, turn, content. schemas: name,
    param, kind (see KINDS), required. status: linked, no_result, orphan_result. Of calls or results repeated under one
    identifier the first by turn (ties: by content) stands, n_results counts all. Rows with a null conversation or
    identifier link to nothing and are left out. Arguments that are no JSON object, or hold a key twice or a number beyond
    doubles: error json, and no `arguments` in the message. Numbers go by their value: 1.0 and 1e2 are integers, of any
    size; more than 38 digits are rounded to a double. Errors are sorted by code point. A tool without a schema: error tool. A dependency on an
    identifier that is no call is no bar; level is null on and above cycles. Null contents are left out of the message.
    Other columns are not looked at. Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.where(known).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments")).alias("c")).select(*key, "c.turn", "c.name", "c.arguments")
    first = write_shared(first, "calls")
    answers = results.where(known).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")).select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    needs = first.select(*key, F.explode(F.try_variant_get(F.try_parse_json("arguments"), depends_on, "array<string>")).alias("needs")).where("needs is not null")
    edges = needs.join(first.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
    levels = topological_levels(first, edges.select(*key, "needs"))
    tools = schemas.where("name is not null and param is not null").groupBy("name", "param").agg(F.min("kind").alias("kind"), F.max("required").alias("required"))
    tools = tools.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("kind", F.coalesce("required", F.lit(False)).alias("required"))))).alias("schema"))
    full = first.withColumn("is_call", F.lit(True)).join(answers.hint("shuffle_hash"), key, "full").join(levels.hint("shuffle_hash"), key, "left").join(tools, "name", "left")
    json = F.when(~beyond_double(F.col("arguments")), F.try_parse_json("arguments"))
    full = full.withColumn("given", F.try_variant_get(json, "$", "map<string,variant>"))
    errors = F.when(F.col("is_call").isNull(), F.array().cast("array<string>")).when(F.col("given").isNull(), F.array(F.lit("json")))
    full = full.withColumn("errors", errors.otherwise(argument_errors(F.col("given"), F.col("schema"))))
    full = full.withColumn("status", F.when(F.col("is_call").isNull(), "orphan_result").when(F.col("n_results").isNull(), "no_result").otherwise("linked"))
    full = full.withColumn("turn", F.coalesce("turn", "result_turn"))
    fields = {
        "arguments": F.when(F.col("given").isNotNull(), canonical(F.try_parse_json("arguments"))),
        "call_id": quoted(F.col("call_id").cast("string")),
        "errors": F.concat(F.lit("["), F.array_join(F.transform("errors", quoted), ","), F.lit("]")),
        "level": F.col("level").cast("string"),
        "name": quoted(F.col("name")),
        "result": quoted(F.col("content")),
        "status": quoted(F.col("status")),
        "turn": F.col("turn").cast("string"),
    }  # in code point order
    message = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()))), ",")
    return full.select(*key, "turn", "name", "level", "status", F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"), F.array_join("errors", ",").alias("errors"), F.concat(F.lit("{"), message, F.lit("}")).alias("message"))


SCHEMAS = [(n, p, k, r) for n in ("search", "translate", "summarize") for p, k, r in (("query", "string", True), ("limit", "integer", n != "summarize"), ("after", "array", False))]


def all_turns(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results). The conversations hold no tool calls, so they are made from each turn of each role: a call with the turn's whole text in its arguments, and a result of the turn before it."""
    known = table.where("conv_id is not null and turn is not null").withColumn("k", F.col("conv_id") + F.col("turn"))
    every = lambda n: F.col("k") % n == 0
    length = F.length(F.coalesce("text", F.lit("")))
    after = F.when(every(17), F.array(F.concat(F.lit("c"), "turn"))).when(F.col("turn") >= 3, F.array(F.concat(F.lit("c"), F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    rest = [F.when(~every(11), F.col("text")).alias("query"), F.when(every(11), F.col("text")).alias("text"), F.when(every(19), F.parse_json(F.lit('{"b": 1, "a": [true, null]}'))).alias("extra"), after.alias("after")]
    given = F.when(every(5), F.to_json(F.struct(length.cast("string").alias("limit"), *rest))).otherwise(F.to_json(F.struct(length.alias("limit"), *rest)))
    name = F.element_at(F.array(*map(F.lit, ("search", "translate", "summarize"))), (F.pmod("k", F.lit(3)) + 1).cast("int"))
    calls = known.select("conv_id", F.concat(F.lit("c"), "turn").alias("call_id"), "turn", name.alias("name"), F.when(every(13), F.concat_ws(" ", F.lit("not json"), "text")).otherwise(given).alias("arguments"))
    results = known.select("conv_id", F.concat(F.when(every(7), "x").otherwise("c"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    return link_tool_calls(*all_turns(read_table(spark, sf_dir, "conversations")), spark.createDataFrame(SCHEMAS, "name string, param string, kind string, required boolean"))


#: DuckDB over the same tables.
ORACLE_SQL = r"""
with recursive t as (select conv_id, turn, text, conv_id + turn as k from conversations where conv_id is not null and turn is not null),
f as (select *, k % 13 = 0 as bad, concat('c', turn) as call_id, case k % 3 when 0 then 'search' when 1 then 'translate' else 'summarize' end as name from t),
up as (select f.conv_id, f.turn, not bad and k % 17 = 0 as loops, case when not bad and k % 17 <> 0 and f.turn >= 3 then b.turn end as below from f left join (select conv_id, turn from t) b on b.conv_id = f.conv_id and b.turn = f.turn - 2),
lv as (select conv_id, turn, 0 as level from up where not loops and below is null
       union all select up.conv_id, up.turn, lv.level + 1 from up join lv on up.conv_id = lv.conv_id and up.below = lv.turn where not loops),
r as (select conv_id, concat(case when k % 7 = 0 then 'x' else 'c' end, turn - 1) as call_id, turn as result_turn, text as content from t),
j as (select coalesce(f.conv_id, r.conv_id) as conv_id, coalesce(f.call_id, r.call_id) as call_id, coalesce(f.turn, result_turn) as turn, name, level, f.call_id is not null as is_call, result_turn is not null as has_result, content, bad, k, text, length(coalesce(text, '')) as n,
      case when f.call_id is null then 'orphan_result' when result_turn is null then 'no_result' else 'linked' end as status,
      case when f.call_id is null then []::varchar[] when bad then ['json'] else
        list_filter([case when k % 11 = 0 or text is null then 'missing:query' end, case when k % 5 = 0 then 'type:limit' end, case when k % 19 = 0 then 'unknown:extra' end, case when k % 11 = 0 and text is not null then 'unknown:text' end], lambda x: x is not null) end as e
      from f full join r on f.conv_id = r.conv_id and f.call_id = r.call_id left join lv on lv.conv_id = f.conv_id and lv.turn = f.turn)
select conv_id, call_id, turn, name, level, status, cast(has_result as bigint) as n_results, array_to_string(e, ',') as errors,
  concat('{', case when is_call and not bad then concat('"arguments":{"after":[', case when k % 17 = 0 then concat('"c', turn, '"') when turn >= 3 then concat('"c', turn - 2, '"') else '' end, ']',
      case when k % 19 = 0 then ',"extra":{"a":[true,null],"b":1}' else '' end, ',"limit":', case when k % 5 = 0 then concat('"', n, '"') else concat(n) end,
      case when text is null then '' when k % 11 = 0 then concat(',"text":', to_json(text)::varchar) else concat(',"query":', to_json(text)::varchar) end, '},') else '' end,
    '"call_id":"', call_id, '","errors":', replace(to_json(e)::varchar, ' ', ''), case when level is null then '' else concat(',"level":', level) end,
    case when name is null then '' else concat(',"name":"', name, '"') end, case when content is null then '' else concat(',"result":', to_json(content)::varchar) end,
    ',"status":"', status, '","turn":', turn, '}') as message
from j
"""
