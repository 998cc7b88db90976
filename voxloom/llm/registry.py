"""The queries of this subpackage by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import importlib

MODULES = ("exact_dedup", "minhash", "mixing", "ngram_join", "packing", "periodic", "prefix_trie", "repeats", "secrets", "spotsigs", "token_planes", "toxicity", "warc_zip")

QUERIES: dict = {}
SQL: dict = {}
LOADED: dict = {}
for _name in MODULES:
    _module = LOADED[_name] = importlib.import_module(f"voxloom.llm.{_name}")
    QUERIES |= {k: v for k, v in vars(_module).items() if (k.startswith("op") and k[2:3].isdigit()) or k == "spotsigs_links"}
    SQL |= getattr(_module, "SQL", {})

#: Operator 3's links in SQL are operator 13's with other figures.
SQL["op3_minhash"] = f"SELECT *, doc_id = component_id AS kept FROM ({LOADED['ngram_join'].components_sql(3, 85)})"
