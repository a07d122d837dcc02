"""All queries of the library by name."""

from quarry.plans import curation, maintenance, reads, records, retrieval, scopes, streams, texts, trees, vectors  # noqa: F401  they register
from quarry.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
