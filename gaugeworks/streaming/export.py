"""Durable fan-out of a stream to file destinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gaugeworks.model import Endpoint
from gaugeworks.operators.export import export


def export_stream(
    df: DataFrame, endpoints: Sequence[Endpoint], path: str, checkpoint: str
) -> None:
    """Export everything available; a micro-batch repeated after a failure replaces its
    own files, so each row arrives once.
    """
    query = (
        df.writeStream.foreachBatch(lambda rows, run: export(rows, endpoints, path, run))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
