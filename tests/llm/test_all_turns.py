"""Calls and results of every turn, against plain Python."""

import json

from weft.llm import queries


def test_every_turn_and_whole_texts_reach_the_messages(spark, tmp_path):
    roles = ["system", "user", "assistant"]
    text = 'Né "quoted"\nline \\ 文字 of {c} {t} ' + "x" * 300
    rows = [(c, t, roles[min(t, 1) + (t > 1 and t % 2 == 0)], None if (c, t) == (3, 2) else text.format(c=c, t=t)) for c in range(1, 30) for t in range(5)]
    spark.createDataFrame([*rows, (None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["call_id"]): r for r in queries.queries()["op4_tool_calls_all_turns"](spark, str(tmp_path)).collect()}
    texts = {(c, t): x for c, t, _, x in rows}
    levels = {}
    for c, t in sorted(texts):
        k = c + t
        levels[c, t] = 0 if k % 13 == 0 else None if k % 17 == 0 else 0 if t < 3 else None if levels[c, t - 2] is None else levels[c, t - 2] + 1
    want = set(texts) | {(c, t) for c, t in texts}
    assert {(c, f"c{t}") for c, t in want} <= set(got)
    for (c, t), x in texts.items():
        k, row = c + t, got[c, f"c{t}"]
        message = json.loads(row["message"])
        assert (row["turn"], row["level"], message.get("level")) == (t, levels[c, t], levels[c, t])
        linked = (c, t + 1) in texts and (k + 1) % 7 != 0
        assert row["status"] == ("linked" if linked else "no_result") and message.get("result") == (texts[c, t + 1] if linked else None)
        if k % 13 == 0:
            assert row["errors"] == "json" and "arguments" not in message
            continue
        size = len(x or "")
        arguments = {"limit": str(size) if k % 5 == 0 else size, "after": [f"c{t}"] if k % 17 == 0 else [f"c{t - 2}"] if t >= 3 else []}
        arguments |= {"text" if k % 11 == 0 else "query": x} if x is not None else {}
        arguments |= {"extra": {"a": [True, None], "b": 1}} if k % 19 == 0 else {}
        assert message["arguments"] == arguments
        wrong = ["missing:query"] * ("query" not in arguments) + ["type:limit"] * (k % 5 == 0) + ["unknown:extra"] * (k % 19 == 0) + ["unknown:text"] * ("text" in arguments)
        assert row["errors"] == ",".join(wrong)
    orphans = {(c, f"x{t - 1}" if (c + t) % 7 == 0 else "c-1"): x for (c, t), x in texts.items() if (c + t) % 7 == 0 or t == 0}
    assert {key: json.loads(r["message"]).get("result") for key, r in got.items() if r["status"] == "orphan_result"} == orphans
    assert len(got) == len(texts) + len(orphans)
