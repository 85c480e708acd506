"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that holds query() and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_histogram_shards": "sharding",
    "op2_power_of_two_packing": "packing",
    "op3_bootstrapped_pii": "pii",
    "op4_suffix_repetition": "quality",
    "op5_phrase_automata": "phrases",
    "op6_bagminhash": "minhash",
    "op7_template_leaks": "templates",
    "op8_markov_secrets": "secrets",
    "op9_edit_join_lines": "lines",
    "op10_host_paths": "html",
    "op11_skip_list_middle": "middle",
    "op12_nearest_toxicity": "toxicity",
    "op13_checkpointed_repair": "repair",
}


def queries():
    return {name: import_module(f"cliploom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql():
    found = {name: getattr(import_module(f"cliploom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
