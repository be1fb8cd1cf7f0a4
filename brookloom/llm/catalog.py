"""The queries of this package, by name, with their SQL where SQL can say it."""

import importlib
import importlib.util

QUERIES: dict = {}
SQL: dict = {}
for _name in ("q_splitting", "q_encoding", "q_mixing", "q_chats", "q_duplicates", "q_pairs", "q_leaks", "q_neighbours"):
    if importlib.util.find_spec(f"brookloom.llm.{_name}"):
        _module = importlib.import_module(f"brookloom.llm.{_name}")
        QUERIES |= _module.QUERIES
        SQL |= _module.SQL
