"""All queries of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import answers, asking, candidates, evaluation, hubs, inference, ingest, lookups, more, phrases, potentials, registered, resolution, scalars, singles, sources, streams, word_classes  # noqa: F401
from .plans.registered import flagship  # noqa: F401


def queries() -> dict:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.ORACLES)
