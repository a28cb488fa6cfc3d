"""All queries of the llm problems and their SQL."""

from sarraf.llm import queries_lake, queries_names, queries_texts

_MODULES = (queries_names, queries_lake, queries_texts)
QUERIES = {n: q for m in _MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in _MODULES for n, s in m.SQL.items()}
