"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Candidates are scaled by the largest norm and get one more component that makes all norms 1;
queries get a 0 there. The nearest in Euclidean distance then have the largest inner products,
and p-stable hashes (a random normal projection, shifted and cut into steps of WIDTH) apply.

Each of TABLES tables keys a candidate by HASHES such steps, and holds every candidate. A query
visits its own bucket of a table and those that PROBES - 1 sets of steps up or down lead to, in
the order of estimated success: steps towards near borders first, sets by the expected sum of
squared distances to the borders crossed, which depends on the borders' order alone.

Buckets are dealt to tasks whole, several to a task; one larger than PART_ROWS is cut into parts,
each of them visited. A query goes once to a task, with the buckets it visits there, and comes back
with the NEAREST best of them by inner products of the original vectors in double precision. The best
of all tables and tasks are merged. Nothing is capped: buckets are read whole.

A row has one identity and one score in all tables: a block's matrix product only tells which rows
may be among the best (its last bits depend on the block's shape); the scores of those are added up
component by component, in their order, whatever the block. Rows are merged by identity.

Recall against brute force is measured in tests/llm, and stated in the README for larger tables.

Defined cases. Vectors that are null, empty, zero or hold null or non-finite parts take no part,
neither as query nor as candidate; vectors of another length than the query's are no candidates.
Rows that repeat an id are candidates each, but not for a query of their id; rows with null ids
take no part. Ties go to the smaller id. A query that finds fewer than NEAREST in its buckets is
compared with all candidates, block by block; it has fewer rows only if there are fewer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import table
from gaugeworks.llm.vectors import rows_of
from gaugeworks.session import written

TABLES = 2
HASHES = 4
WIDTH = 1.6
PROBES = 72
NEAREST = 20
EVERY = 20
PART_ROWS = 8000
#: Pairs whose scores are added up at once.
PAIRS = 16_384


def hashes(size: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (size + 1 by tables x HASHES) and shifts."""
    rng = np.random.default_rng([7, size])
    return rng.normal(size=(size + 1, tables * HASHES)), rng.uniform(0, WIDTH, tables * HASHES)


def probe_sets(k: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places among the 2 k borders sorted by distance, least expected sum of squares first.

    Places z and 2 k - 1 - z are the two borders of one step, so a set holds one of them at most.
    """
    def expected(z: int) -> float:
        z += 1
        if z <= k:
            return z * (z + 1) / (4 * (k + 1) * (k + 2))
        return 1 - (2 * k + 1 - z) / (k + 1) + (2 * k + 1 - z) * (2 * k + 2 - z) / (4 * (k + 1) * (k + 2))

    cost = [expected(z) for z in range(2 * k)]
    found: list[tuple[int, ...]] = [()]
    queue = [(cost[0], (0,))]
    while queue and len(found) < probes:
        _, s = heapq.heappop(queue)
        if all(2 * k - 1 - z not in s for z in s):
            found.append(s)
        last = s[-1] + 1
        if last < 2 * k:  # move the last one on, or add the one behind it
            for t in ((*s[:-1], last), (*s, last)):
                heapq.heappush(queue, (sum(cost[z] for z in t), t))
    return found


def buckets(steps: np.ndarray) -> np.ndarray:
    """One long for each row of integer steps."""
    x = np.zeros(len(steps), np.uint64)
    for column in steps.T:
        x = (x + column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def visited(place: np.ndarray, probes: int) -> np.ndarray:
    """Buckets of queries (rows of unrounded steps) in the order of the probes: queries x probes."""
    own = np.floor(place).astype(np.int64)
    below = place - own
    k = place.shape[1]
    order = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")
    out = np.empty((len(place), 0), np.int64)
    for s in probe_sets(k, probes):
        steps = own.copy()
        for z in s:
            border = order[:, z]
            np.add.at(steps, (np.arange(len(steps)), border % k), np.where(border < k, -1, 1))
        out = np.concatenate([out, buckets(steps)[:, None]], axis=1)
    return out


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, v) for i, v in zip(batch["vec_id"].to_pylist(), rows_of(batch["embedding"])) if v is not None and i is not None]
        yield pa.RecordBatch.from_pydict(
            {
                "vec_id": pa.array([r[0] for r in rows], pa.int64()),
                "size": pa.array([len(r[1]) for r in rows], pa.int32()),
                "norm": pa.array([float(np.sqrt((r[1] ** 2).sum())) for r in rows], pa.float64()),
                "vector": pa.array([r[1].tobytes() for r in rows], pa.binary()),
            }
        )


def _placed(batch: pa.RecordBatch, largest: dict[int, float], tables: int, query: bool) -> Iterator[tuple]:
    """(rows, table, unrounded steps) by vector length."""
    size = batch["size"].to_numpy()
    raw = batch["vector"].to_pylist()
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
        if query:
            x = np.c_[x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))]
        else:
            x = x / largest[int(s)]
            x = np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]
        a, b = hashes(int(s), tables)
        place = (x @ a + b) / WIDTH
        for t in range(tables):
            yield at, int(s), t, place[:, t * HASHES : (t + 1) * HASHES]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x, each added up in the order of the components."""
    out = np.zeros(len(q))
    for a, b in zip(q.T, x.T):
        out += a * b
    return out


def _best(nearest: int):
    def best(rows: pa.Table) -> pa.Table:
        """Of each query the best candidates in the buckets it visits in this task."""
        has = rows["visits"].is_valid().to_numpy()
        candidates, queries = rows.filter(pa.array(~has)), rows.filter(pa.array(has))
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(candidates) and len(queries):
            candidates = candidates.sort_by([("bucket", "ascending"), ("vec_id", "ascending")])
            bucket, ids, row = (candidates[c].to_numpy() for c in ("bucket", "vec_id", "row"))
            x = np.frombuffer(b"".join(candidates["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
            q = np.frombuffer(b"".join(queries["vector"].to_pylist()), np.float64).reshape(len(queries), -1)
            own = queries["vec_id"].to_numpy()
            # What two orders of adding up can differ by, twice over.
            slack = 8 * x.shape[1] * np.finfo(float).eps * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
            visits = queries["visits"].combine_chunks()
            who = np.repeat(np.arange(len(own)), visits.value_lengths().to_numpy())
            what = visits.flatten().to_numpy()
            order = np.argsort(what, kind="stable")
            who, what = who[order], what[order]
            score = np.full((len(own), nearest), -np.inf)
            found = np.full((len(own), nearest), np.iinfo(np.int64).max)
            place = np.full((len(own), nearest), -1)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(starts, [*starts[1:], len(bucket)]):
                lo, hi = np.searchsorted(what, bucket[a], "left"), np.searchsorted(what, bucket[a], "right")
                for at in range(lo, hi, 1024):
                    use = who[at : min(at + 1024, hi)]
                    rough = q[use] @ x[a:b].T
                    rough[ids[a:b] == own[use][:, None]] = -np.inf
                    s = np.concatenate([score[use], rough], axis=1)
                    bar = -np.partition(-s, nearest - 1, axis=1)[:, nearest - 1] - slack[use]
                    i, j = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
                    if not len(i):
                        continue
                    s[:, nearest:] = -np.inf
                    for c in range(0, len(i), PAIRS):
                        k, m = i[c : c + PAIRS], j[c : c + PAIRS]
                        s[k, nearest + m] = inner(q[use[k]], x[a + m])
                    n = np.concatenate([found[use], np.broadcast_to(ids[a:b], (len(use), b - a))], axis=1)
                    p = np.concatenate([place[use], np.broadcast_to(np.arange(a, b), (len(use), b - a))], axis=1)
                    keep = _first(s, n, nearest)
                    score[use], found[use], place[use] = (np.take_along_axis(v, keep, 1) for v in (s, n, p))
            i, j = np.nonzero(np.isfinite(score))
            out = (own[i], row[place[i, j]], found[i, j], score[i, j])
        return pa.table(
            {
                "query_id": pa.array(out[0], pa.int64()), "row": pa.array(out[1], pa.int64()),
                "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64()),
            }
        )

    return best


def _first(score: np.ndarray, ids: np.ndarray, nearest: int) -> np.ndarray:
    """Columns of the best of each row; among equal scores those with smaller ids."""
    k = min(nearest, score.shape[1])
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    # All at the k-th score take part, so that ids decide among them.
    most = int((score >= least).sum(axis=1).max())
    some = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
    order = np.lexsort((np.take_along_axis(ids, some, 1), -np.take_along_axis(score, some, 1)), axis=1)[:, :k]
    return np.take_along_axis(some, order, 1)


def nearest(
    vectors: DataFrame, every: int = EVERY, k: int = NEAREST, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k best other rows."""
    spark = vectors.sparkSession
    usable = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
            _usable, "vec_id long, size int, norm double, vector binary"
        ).withColumn("row", F.monotonically_increasing_id()),
        "usable",
    )
    largest = {r.size: r.norm for r in usable.groupBy("size").agg(F.max("norm").alias("norm")).collect()}
    is_query = F.pmod("vec_id", F.lit(every)) == 0

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, s, t, place in _placed(batch, largest, tables, query=False):
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array([t] * len(at), pa.int32()), "size": some["size"],
                        "bucket": buckets(np.floor(place).astype(np.int64)), "row": some["row"],
                        "vec_id": some["vec_id"], "vector": some["vector"],
                    }
                )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, s, t, place in _placed(batch, largest, tables, query=True):
                seen = visited(place, probes)
                some = batch.take(pa.array(np.repeat(at, seen.shape[1])))
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array([t] * seen.size, pa.int32()), "size": some["size"],
                        "bucket": pa.array(seen.ravel()), "vec_id": some["vec_id"],
                    }
                )

    held = usable.select("row", "vec_id", "size", "vector").mapInArrow(
        filed, "kind int, size int, bucket long, row long, vec_id long, vector binary"
    )
    asked = usable.where(is_query).select("vec_id", "size", "vector").mapInArrow(
        visits, "kind int, size int, bucket long, vec_id long"
    )
    # A bucket's task: its parts (one unless it is large), several buckets to a task.
    sizes = held.groupBy("kind", "size", "bucket").agg(F.count("*").alias("n"))
    tasks = max(1, usable.count() // PART_ROWS + 1)
    sizes = written(
        sizes.select(
            "kind", "size", "bucket",
            F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"),
            F.pmod(F.xxhash64("bucket"), F.lit(tasks)).alias("slot"),
        ),
        "buckets",
    )
    on = ["kind", "size", "bucket"]
    task = lambda part: F.when(F.col("parts") > 1, F.xxhash64("kind", "size", "bucket", part)).otherwise(
        F.xxhash64("kind", "size", "slot")
    )
    rows = held.join(sizes, on).select(
        task(F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("task"), "bucket", "row", "vec_id", "vector",
        F.lit(None).cast("array<bigint>").alias("visits"),
    )
    nothing = [F.lit(None).cast("long").alias(c) for c in ("bucket", "row")]
    asks = asked.join(sizes, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.groupBy(task(F.col("part").cast("long")).alias("task"), "vec_id").agg(F.collect_set("bucket").alias("visits"))
    asks = asks.join(usable.where(is_query).select("vec_id", "vector").dropDuplicates(["vec_id"]), "vec_id")
    asks = asks.select("task", *nothing, "vec_id", "vector", "visits")
    result = "query_id long, row long, vec_id long, score double"
    found = rows.union(asks).groupBy("task").applyInArrow(_best(k), result)
    # The same row comes from several tables.
    found = written(found.dropDuplicates(["query_id", "row"]), "found")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(
        usable.where(is_query).dropDuplicates(["vec_id"]).join(enough, "vec_id", "left_anti"), "short-queries"
    )
    if not short.isEmpty():
        slot = F.xxhash64("size", F.pmod(F.xxhash64("vec_id"), F.lit(tasks))).alias("task")
        every_row = usable.select(
            slot, F.lit(0).cast("long").alias("bucket"), "row", "vec_id", "vector",
            F.lit(None).cast("array<bigint>").alias("visits"),
        )
        each = short.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
        each = each.select(
            F.xxhash64("size", "slot").alias("task"), *nothing, "vec_id", "vector",
            F.array(F.lit(0).cast("long")).alias("visits"),
        )
        more = every_row.union(each).groupBy("task").applyInArrow(_best(k), result)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
