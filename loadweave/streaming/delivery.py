"""Delivery of setpoints: validated first, then handed to a transport. The transport is any function of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import control

Transport = Callable[[DataFrame], None]


def submit(points: DataFrame, transmit: Transport) -> None:
    """Hands all points to the transport, or none: an invalid point is an error that names some."""
    checked = control.validate_schedule(points)
    bad = checked.where(F.size("errors") > 0).select("malo", "errors").limit(5).collect()
    if bad:
        raise ValueError(f"invalid points, e.g. {[(r['malo'], r['errors']) for r in bad]}")
    transmit(points)


def deliver(points: DataFrame, transmit: Transport, checkpoint: str, refuse: Transport | None = None, **trigger) -> StreamingQuery:
    """A stream of points: each micro-batch's valid points go to the transport, the others with their errors to `refuse`. A
    batch that fails is delivered again, so transports should take a point twice (e.g. keyed by malo and start)."""

    def batch(df: DataFrame, _: int) -> None:
        checked = control.validate_schedule(df)
        transmit(checked.where(F.size("errors") == 0).drop("errors"))
        if refuse is not None:
            refuse(checked.where(F.size("errors") > 0))

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
