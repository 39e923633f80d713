"""All queries of the core by name."""

from __future__ import annotations

from tallylog.plans import brokers, datasets, queues, scalars, state, streams

FLAGSHIP = "route_topic"

_PLANS = [scalars.P, queues.P, state.P, streams.P, brokers.P]


def queries() -> dict:
    return datasets.QUERIES | {name: f for p in _PLANS for name, f in p.queries.items()}


def sql() -> dict[str, str]:
    return datasets.SQL | {name: text for p in _PLANS for name, text in p.sql.items()}
