"""All queries of the core and their SQL."""

from sarraf.plans import composite, features, fusion, problems, relational, stores

_REGISTRIES = (relational.query, composite.query, features.query, fusion.query, stores.query)
QUERIES = {**problems.QUERIES, **{n: q for r in _REGISTRIES for n, q in r.queries.items()}}
SQL = {**problems.SQL, **{n: s for r in _REGISTRIES for n, s in r.sql.items()}}
