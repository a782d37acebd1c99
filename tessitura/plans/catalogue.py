"""The catalogue of queries over the driver's tables, with their DuckDB oracles.

The tables hold no sound, so operators run on columns of the same shape: a track is a user
(or order, supplier), a source an event type, a level series the values by event_id, a bar a
day. Every window is partitioned by (track, source).
"""

from __future__ import annotations

from tessitura.plans import columnar, extended, sound


def queries() -> dict:
    return {**columnar.QUERIES, **extended.QUERIES, **sound.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**columnar.ORACLES, **extended.ORACLES, **sound.ORACLES}
