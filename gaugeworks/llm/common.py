"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import written

#: Rows of (key, value) that a join may broadcast: some tens of MB. Above it Spark shuffles.
BROADCAST_ROWS = 1_000_000


#: Rows on their way to Python at once: a few MB of documents.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """`big` joined with a written table of narrow rows, broadcast only after counting them."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _both_ways(rows: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """(u, v) twice for each row, from two pairs of its columns; the rows are read once."""
    pairs = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (one, other)]
    return rows.select(F.inline(F.array(*pairs)))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u of edges (u, v), u > v, has one v only, and no v is another's u."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("u").alias("node"), F.col("v").alias("above")),
                F.struct(F.col("v").alias("node"), F.lit(None).cast(edges.schema["v"].dataType).alias("above")),
            )
        )
    )
    ends = ends.groupBy("node").agg(
        F.min("above").alias("least"), F.max("above").alias("most"), (F.count("*") - F.count("above")).alias("below")
    )
    return ends.where("least <> most or (least is not null and below > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b), longs: component is the smallest id reachable.

    Alternates two star contractions until every id hangs on the smallest. Each round takes minima
    per node (combined before the shuffle) and joins them back, so that a hub is never gathered in
    one task; every round is a written table. Rounds grow with the logarithm of the longest chain.
    Whether one is due is seen from the edges: every job and scan costs the driver some megabytes.
    """
    edges = written(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct(),
        "edges",
    )
    while not _is_forest_of_stars(edges):
        both = _both_ways(edges, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # A node that is its own minimum hangs its neighbours on itself: those edges stay as they are.
        large = written(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = _both_ways(large.join(low, "u"), ("v", "low"), ("u", "low"))
        edges = written(small.where("u <> v").distinct(), "small-star")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )


def with_component(rows: DataFrame, id_col: str, links: DataFrame) -> DataFrame:
    """rows plus component_id: the smallest id reachable over links (a, b), the own one included."""
    found = components(links).select(F.col("id").alias(id_col), F.col("component").alias("component_id"))
    out = rows.join(found, id_col, "left")
    return out.withColumn("component_id", F.coalesce("component_id", F.col(id_col)))


class Bits:
    """Hashed values of a column as bits: tells of a value that it is certainly absent.

    Read by their low bits, which are spread evenly even where the least hashes were chosen.
    `values` is a written table; 32 bits are taken for each, 2 ** bits at most. With more values
    more are wrongly thought to be held, which a caller must only pay for in rows.
    """

    def __init__(self, values: DataFrame, column: str, bits: int) -> None:
        bits = min(bits, max(12, (32 * values.count()).bit_length()))
        self.mask = (1 << bits) - 1
        slot = f"({column} & {self.mask}L)"
        words = values.groupBy(F.expr(f"{slot} div 64").alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 as int))")).alias("held")
        )
        found = words.toArrow()  # 2 ** (bits - 6) rows at most
        self.words = np.zeros(1 << bits - 6, np.uint64)
        self.words[found["word"].to_numpy()] = found["held"].to_numpy().view(np.uint64)

    def has(self, values: np.ndarray) -> np.ndarray:
        slot = values.view(np.uint64) & np.uint64(self.mask)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
