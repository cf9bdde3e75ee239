"""All queries of the reference's operators."""

from . import enrichment, filings, landed, more, questions, relational, search, statements, streams, texts, writes  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
