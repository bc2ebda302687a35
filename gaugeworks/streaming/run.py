"""Running a stream over what has landed, with files as sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugeworks.session import rocksdb_state


def run_available(
    stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append"
) -> DataFrame:
    """Process everything available now into `path`; what the sink holds afterwards.

    Started again with the same checkpoint, it goes on where it stopped. Its state is in RocksDB,
    whatever the session has set, unless the checkpoint began with another store.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
        .trigger(availableNow=True)
    )
    with rocksdb_state(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
