"""All registered queries of the library and their SQL."""

from __future__ import annotations

from cliploom.plans import charged, cued, more, oracles, ranked, scoped, windowed  # noqa: F401  (they register their queries)
from cliploom.plans.queries import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
