"""Shards along a Hilbert curve through the metadata, for files that many dimensions prune.

Four dimensions are quantised to 2**BITS cells each: source and language (hashed), size (by its
logarithm) and doc_id (evenly between least and largest). Rows are sorted by their cell's index
on the Hilbert curve, neighbours on which are neighbours in space, and the order is cut into runs
of equal counts: law `rows`, counts of shards at most one apart. A run covers few cells, so the
ranges of its columns are narrow in every dimension at once.

The sort is distributed, by (curve, doc_id, text_crc32): a cell with many rows is spread over
partitions. Ranks follow from the counts of the sorted partitions.

Defined cases. A null source, language or id is cell 0; a null text has size 8 and crc 0. Repeated
rows are neighbours; ties are ordered as they were read. Without rows the result is empty. Equal
texts need not share a shard under this law. Further columns may be carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from gaugeworks.llm.common import fresh, table
from gaugeworks.session import written

BITS = 5
SHARDS = 24


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each column of cells (dimensions x points), each below 2**bits.

    Works from the highest bit down: the orientation of the curve in a cell's half is undone by
    inverting or exchanging lower bits, then the bits of all dimensions are Gray-decoded.
    """
    x = cells.astype(np.int64).copy()
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for axis in range(len(x)):
            inverted = (x[axis] & high) != 0
            exchange = np.where(inverted, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(inverted, low, exchange)
            x[axis] ^= exchange
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            index = index << 1 | (x[axis] >> level & 1)
    return index


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert(np.stack([x.to_numpy() for x in (a, b, c, d)]), BITS))


def cells(docs: DataFrame, size: Column) -> list[Column]:
    """The cell of a row in each dimension."""
    last = (1 << BITS) - 1
    ends = docs.agg(F.min("doc_id").cast("double").alias("low"), F.max("doc_id").cast("double").alias("high")).first()
    low, high = ends.low or 0.0, ends.high or 0.0
    hashed = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % (last + 1), F.lit(0))
    by_id = F.floor((F.col("doc_id").cast("double") - low) / max(high - low, 1.0) * (last + 1))
    by_size = F.floor((F.log2(size) - 3) * 1.5)
    return [
        hashed("source").cast("long"),
        hashed("lang").cast("long"),
        F.least(by_size, F.lit(last)).cast("long"),
        F.coalesce(F.least(by_id, F.lit(last)), F.lit(0)).cast("long"),
    ]


def shard(docs: DataFrame, shards: int = SHARDS, carry: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the columns in carry."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + 8
    curve, crc, length, place = fresh(docs, "curve", "text_crc32", "size", "place")
    told = docs.select("doc_id", *[F.col(f"`{c}`") for c in carry], size.alias(length), F.crc32(text).alias(crc), _curve(*cells(docs, size)).alias(curve))
    order = [curve, "doc_id", crc]
    told = told.repartitionByRange(*order).sortWithinPartitions(*order)
    told = written(told.withColumn(place, F.monotonically_increasing_id()), "curve-order")
    part = F.shiftright(place, 33)
    counts = told.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row per sorted partition.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    counts = written(
        counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total")),
        "curve-counts",
    )
    ranked = told.join(counts, part == F.col("part")).withColumn(
        "rank", F.col("base") + F.col(place).bitwiseAND((1 << 33) - 1)
    )
    own = F.expr(f"(rank * {shards}) div total")
    ranked = ranked.withColumn("own", own)
    return ranked.select(
        "doc_id",
        F.col(length).alias("size"),
        F.col(crc).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("own").cast("int").alias("shard"),
        F.expr(f"rank - (own * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col(curve).alias("curve"),
        *[F.col(f"`{c}`") for c in carry if c.lower() not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder per shard, rows in the order of the curve."""
    carry = [c for c in docs.columns if c.lower() != "doc_id"]
    out = shard(docs, shards, carry).repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
