"""Queries over the test tables."""

from quire.plans.registry import ORACLE, QUERIES, Query


def _load() -> None:
    from quire.plans import layout_queries, sequence_queries, state_queries, style_queries, text_queries  # noqa: F401


def all_queries() -> dict[str, Query]:
    """Query name to callable."""
    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    """Query name to the SQL that says the same."""
    _load()
    return dict(ORACLE)
