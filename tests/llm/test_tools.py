"""Tool calls against plain Python: canonical JSON, errors, levels."""

import json
import random

from pyspark.sql import functions as F

from weft.llm import op4_tools as tools


def canonical(x):
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def some_json(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return [some_json(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    if kind == 6:
        return {some_text(rnd): some_json(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [some_text(rnd), rnd.randrange(-(10**12), 10**12), rnd.random() < 0.5, None, some_text(rnd) + " 1.50 e"][kind]


def some_text(rnd):
    return "".join(rnd.choice('ab"\\\\/\n\té文😀\uffff{}[]:,1. ') for _ in range(rnd.randrange(6)))


def test_canonical_json(spark):
    rnd = random.Random(4)
    values = [{"k": some_json(rnd), some_text(rnd): some_json(rnd)} for _ in range(200)]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 2]))) for i, v in enumerate(values)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", tools.canonical(F.try_parse_json("t")).alias("c")).collect()}
    assert got == {i: canonical(v) for i, v in enumerate(values)}


def test_numbers_have_one_form(spark):
    forms = {"1e2": "100", "100.0": "100", "1E-7": "1e-7", "0.00000010": "1e-7", "-0.0": "0", "0": "0", "12.50": "12.5", "1e20": "100000000000000000000", "1e21": "1e+21", "1000000000000000000000": "1e+21", "123456789012345678901234567890": "1.2345678901234567890123456789e+29", "0.000001": "0.000001", "-12.5e-3": "-0.0125", "9007199254740993": "9007199254740993"}
    df = spark.createDataFrame([(x,) for x in forms], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", tools.canonical(F.try_parse_json("t")).alias("c")).collect()} == forms


def test_arguments(spark):
    given = {
        "whole": '{"n": 1.0}', "power": '{"n": 1e2}', "big": '{"n": 123456789012345678901234567890}', "part": '{"n": 1.5}', "text": '{"n": "1"}',
        "twice": '{"n": 1, "n": 2}', "deep twice": '{"n": 1, "x": {"a": 1, "a": 2}}', "endless": '{"n": 1e400}', "list": "[1]", "nested": "[" * 3000 + "]" * 3000, "none": None, "in text": '{"n": 1, "x": "1e400"}',
    }
    calls = spark.createDataFrame([(1, k, 1, "f", v, "x", "y", "z") for k, v in given.items()], "conv_id bigint, call_id string, turn bigint, name string, arguments string, status string, level string, n string")
    results = spark.createDataFrame([], "conv_id bigint, call_id string, turn bigint, content string, errors string")
    schemas = spark.createDataFrame([("f", "n", "integer", True), ("f", "x", "string", False)], "name string, param string, kind string, required boolean")
    got = {r["call_id"]: (r["errors"], json.loads(r["message"]).get("arguments")) for r in tools.link_tool_calls(calls, results, schemas).collect()}
    assert got == {
        "whole": ("", {"n": 1}), "power": ("", {"n": 100}), "big": ("", {"n": 1.2345678901234568e29}), "part": ("type:n", {"n": 1.5}), "text": ("type:n", {"n": "1"}), "in text": ("", {"n": 1, "x": "1e400"}),
        **{k: ("json", None) for k in ("twice", "deep twice", "endless", "list", "nested", "none")},
    }


def test_levels_against_brute_force(spark):
    rnd = random.Random(7)
    needs = {(0, i): [i - 1] if i else [] for i in range(70)}  # a long chain
    for conv in range(1, 12):
        n = rnd.randrange(2, 14)
        for i in range(n):
            needs[conv, i] = sorted({rnd.randrange(n + 1) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))} if conv % 3 else {j for j in range(i) if rnd.random() < 0.4})
    level = {}
    while True:
        fresh = {(c, i): max((1 + level[c, j] for j in js if (c, j) in needs), default=0) for (c, i), js in needs.items() if (c, i) not in level and all((c, j) in level for j in js if (c, j) in needs)}
        if not fresh:
            break
        level |= fresh
    calls = spark.createDataFrame([(c, f"c{i}", i, "f", json.dumps({"after": [f"c{j}" for j in js]})) for (c, i), js in needs.items()], "conv_id bigint, call_id string, turn bigint, name string, arguments string")
    empty = spark.createDataFrame([], "conv_id bigint, call_id string, turn bigint, content string")
    schemas = spark.createDataFrame([("f", "after", "array", True)], "name string, param string, kind string, required boolean")
    got = {(r["conv_id"], int(r["call_id"][1:])): r["level"] for r in tools.link_tool_calls(calls, empty, schemas).collect()}
    assert got == {k: level.get(k) for k in needs} and None in got.values()
