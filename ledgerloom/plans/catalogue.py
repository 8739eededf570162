"""Registry of the engine's own queries and their SQL."""

from . import audits, corpora, corrections, files, programs, records, scoring, stores

_PARTS = (scoring, stores, corpora, corrections, audits, files, programs, records)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
