"""Context values are whole texts."""

from weft.plans import registry


def test_context_keeps_whole_texts(spark, tmp_path):
    start = "the same twenty characters "
    rows = [(1, t, role, f"{start}{t} é" + "y" * 400) for t, role in enumerate(("system", "user", "assistant", "user", "user"))] + [(2, 0, "user", None), (2, 1, "user", start)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    updates = [(c, t, f"p.{role}" + (".a" if t % 2 == 0 else ""), x) for c, t, role, x in rows]
    asof, merged = {}, {}
    for c, t, _, _ in rows:
        for d, u, path, x in updates:
            if d == c and u < t:
                asof[c, t, path] = x
    for c, _, path, x in updates:
        merged = {(d, p): y for (d, p), y in merged.items() if d != c or not (p.startswith(path + ".") or path.startswith(p + "."))} | {(c, path): x}
    queries = registry.queries()
    assert {tuple(r)[:3]: r["value"] for r in queries["r2_context_asof_whole"](spark, str(tmp_path)).collect()} == asof
    assert {tuple(r)[:2]: r["value"] for r in queries["r3_merge_context_whole"](spark, str(tmp_path)).collect()} == merged
