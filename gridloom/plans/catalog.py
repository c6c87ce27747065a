"""All registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from gridloom.plans import basics, files, kernels, modelling, preparation, series, wording  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
