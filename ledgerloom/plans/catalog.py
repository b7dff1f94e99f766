"""All queries over the tables, and the SQL they are held against."""

from __future__ import annotations

from . import checks, domain, operations, relational, scalars  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
