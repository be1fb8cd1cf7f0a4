"""All queries of the core, by name, with their SQL where SQL can say it."""

from brookloom.plans import answer_queries, answer_text_queries, check_queries, fact_queries, knowledge_queries, late_queries, log_queries, note_queries, reading_queries, retrieval_queries, store_queries, text_queries, tree_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (retrieval_queries, knowledge_queries, log_queries, text_queries, fact_queries, note_queries, late_queries, reading_queries, tree_queries, store_queries, answer_queries, check_queries, answer_text_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
