
from __future__ import annotations

from .plans import calendar, cells, chain, composites, joins, kernels, ordered, pieces, records, scalars, selection, storage

FLAGSHIP = "OP-AGG-GRID"
_ALL = [q for m in (cells, ordered, joins, chain, scalars, pieces, kernels, records, calendar, selection, composites, storage) for q in m.QUERIES]


def queries() -> dict:
    return {name: f for name, f, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _ALL if sql}
