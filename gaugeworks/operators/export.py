"""Batches for the gateway, and named file destinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.values import hash_fraction, hashable
from gaugeworks.model import Connection, Endpoint, require
from gaugeworks.operators.select import route
from gaugeworks.session import written

# Points put in order by one task while batches are cut.
BUCKET_ROWS = 200_000


def assign_batches(
    points: DataFrame,
    destination: str,
    id: str,
    max_batch_size: int = 1000,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adds `bucket` and `chunk`: no (destination, bucket, chunk) exceeds the size.

    A destination is first cut into as many hash buckets as its counted rows need, so
    one holding most of the data is numbered by many tasks. The counts are one row per
    destination; the numbering inside a bucket is by `id`.
    """
    require(1 <= max_batch_size <= 10_000, "maxBatchSize must be between 1 and 10000")
    buckets = written(
        points.groupBy(F.col(destination).alias("_d")).agg(
            F.ceil(F.count(F.lit(1)) / F.lit(bucket_rows)).alias("_buckets")
        ),
        "buckets",
    )
    own = F.xxhash64(*hashable(points))
    # A row without an id goes by its own hash.
    place = F.coalesce(hash_fraction(id, "pack"), hash_fraction(own, "pack"))
    spread = points.join(buckets, F.col(destination).eqNullSafe(F.col("_d"))).withColumns(
        {"bucket": F.floor(place * F.col("_buckets")).cast("int"), "_tie": own}
    )
    order = Window.partitionBy(destination, "bucket").orderBy(id, "_tie")
    return spread.withColumn(
        "chunk",
        F.floor((F.row_number().over(order) - 1) / F.lit(max_batch_size)).cast("int"),
    ).drop("_d", "_buckets", "_tie")


def pack_batches(
    points: DataFrame,
    destination: str,
    id: str,
    columns: Sequence[str],
    max_batch_size: int = 1000,
    bucket_rows: int = BUCKET_ROWS,
    format: str = "json",
) -> DataFrame:
    """Envelopes of at most `max_batch_size` points each, points in `id` order."""
    chunked = assign_batches(points, destination, id, max_batch_size, bucket_rows)
    no_labels = F.create_map().cast("map<string,string>")
    return (
        chunked.groupBy(destination, "bucket", "chunk")
        .agg(
            # At most max_batch_size entries.
            F.array_sort(
                F.collect_list(
                    F.struct(F.col(id).alias("o"), F.to_json(F.struct(*columns)).alias("p"))
                )
            ).alias("_points")
        )
        .select(
            F.concat_ws("-", destination, "bucket", "chunk").alias("batch_id"),
            F.encode(
                F.concat(F.lit("["), F.array_join(F.col("_points.p"), ","), F.lit("]")), "UTF-8"
            ).alias("data"),
            F.lit(format).alias("format"),
            F.lit(False).alias("replay"),
            F.lit(0).cast("bigint").alias("config_generation"),
            F.create_map(
                F.lit("destination"),
                F.col(destination).cast("string"),
                F.lit("points"),
                F.size("_points").cast("string"),
            ).alias("metadata"),
            no_labels.alias("internal_labels"),
        )
    )


def export(
    df: DataFrame, endpoints: Sequence[Endpoint], path: str, run: str | int
) -> None:
    """Write rows to every endpoint that takes them, under `<location>/<format>/run=<run>`.

    One write per location and file format, partitioned by endpoint. A run writes only its
    own folders and replaces them, so repeating a run leaves the same files.
    """
    require(len(endpoints) > 0, "at least one export endpoint must be set")
    require(
        len({e.name for e in endpoints}) == len(endpoints), "endpoint names must differ"
    )
    places = sorted({(e.location or path, e.format) for e in endpoints})
    for place, kind in places:
        own = [e for e in endpoints if (e.location or path, e.format) == (place, kind)]
        (
            route(df, [Connection(e.name, e.filter) for e in own])
            .withColumnRenamed("target", "endpoint")
            .write.mode("overwrite")
            .partitionBy("endpoint")
            .format(kind)
            .save(f"{place}/{kind}/run={run}")
        )


def exported(spark: SparkSession, path: str, format: str, schema: str) -> DataFrame:
    """What an export wrote in one format, with `endpoint` and `run`."""
    return (
        spark.read.schema(f"{schema}, endpoint string, run bigint")
        .format(format)
        .load(f"{path}/{format}")
    )
