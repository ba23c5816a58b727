"""The registered queries, by module, and their SQL."""

from __future__ import annotations

from axonlake.plans import composites, compositions, correlation, models, problems, relational, scalars, spikes, statistics, windows

_MODULES = (problems, spikes, relational, statistics, windows, correlation, models, scalars, composites, compositions)
FLAGSHIP = "agg_auc"


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        assert not out.keys() & m.QUERIES.keys()
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.ORACLE
    return out
