"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from . import op1_decontaminate, op2_language, op3_quality, op4_tools, op5_simhash, op6_tokens, op7_substring, op8_mix, op9_rules, op10_suffix, op11_runs, op12_search, op13_tokens

_MODULES = {
    "op1_decontamination": op1_decontaminate,
    "op2_language_id": op2_language,
    "op3_quality_classifier": op3_quality,
    "op4_tool_calls": op4_tools,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_tokens,
    "op7_substring_dedup": op7_substring,
    "op8_mixing": op8_mix,
    "op9_quality_rules": op9_rules,
    "op10_suffix_dedup": op10_suffix,
    "op11_periodic_runs": op11_runs,
    "op12_lexical_search": op12_search,
    "op13_token_files": op13_tokens,
}


def queries() -> dict[str, Callable]:
    return {name: module.query for name, module in _MODULES.items()} | {"op4_tool_calls_all_turns": op4_tools.query}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if hasattr(module, "ORACLE_SQL")} | {"op4_tool_calls_all_turns": op4_tools.ORACLE_SQL}
