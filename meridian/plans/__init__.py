"""Views and registered queries over the given tables."""

from meridian.plans import coverage, derived, queries

QUERIES = {**queries.QUERIES, **derived.QUERIES, **coverage.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **derived.ORACLE_SQL, **coverage.ORACLE_SQL}
