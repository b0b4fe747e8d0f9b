"""Registered queries, each with DuckDB SQL where SQL can say it."""

from . import judging, sources, suites, traces

QUERIES = {**judging.QUERIES, **traces.QUERIES, **suites.QUERIES, **sources.QUERIES}
ORACLE = {**judging.ORACLE, **traces.ORACLE, **suites.ORACLE, **sources.ORACLE}
