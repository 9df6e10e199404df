"""Every operator bound to the given tables, with the SQL that must agree."""

from __future__ import annotations

from .registry import oracles, runnable


def all_queries():
    from . import (  # noqa: F401  (importing registers)
        aggregates, articles, exports, filters, flagship, graphs, joins, mapping, readers, scalars, streams, windows,
    )

    return runnable()


def all_oracles():
    all_queries()
    return oracles()
