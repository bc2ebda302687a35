"""Near-duplicate vectors by sorted projection passes.

Vectors are compared only within a label (not null) and a length; a pair is linked when its
cosine, in double precision, is at least MIN_COSINE.

1. Equal vectors of a label are one class from here on.
2. Each of PASSES passes gives a class a key of KEY_BITS random hyperplane signs, other
   hyperplanes in each pass, and orders the classes of a label by their keys. Similar vectors
   have long common prefixes with fair probability. Each is compared with the next WINDOW in
   that order, on bytes per component; pairs whose rough cosine is near the bound are united.
   The orders of all passes are one distributed sort; the rows at the ends of its partitions are
   compared in a small second step.
3. The united groups of all passes hold every pair found. Inside them all original vectors are
   compared in blocks of at most BLOCK rows each (a larger group in pairs of blocks, one task each),
   which verifies the pairs, counts each class's links and leaves a forest of links for the components.

A pair is missed only if no pass brings the two, or a chain of others between them, together.

Defined cases. Vectors that are null, empty, zero or hold null or non-finite parts, or have no
label, link with nothing and are kept. Repeated rows are copies that link with each other. Null
ids do not count as the smallest; a component without an id has a null component_id and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import components, table
from gaugeworks.llm.vectors import rows_of
from gaugeworks.session import written

MIN_COSINE = 0.98
#: What bytes per component may be off by; candidates only.
ROUGH = 0.02
PASSES = 12
KEY_BITS = 62
WINDOW = 32
BLOCK = 1000
TASK_ROWS = 8000


def planes(size: int, one_pass: int) -> np.ndarray:
    return np.random.default_rng([one_pass, size]).normal(size=(size, KEY_BITS))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector its class (label and digest of the values); null for those that take no part."""
    for batch in batches:
        ids, values = [], []
        for label, v in zip(batch["label"], rows_of(batch["embedding"])):
            if v is None or not label.is_valid:
                ids.append(None)
                values.append(None)
                continue
            raw = (v + 0.0).tobytes()  # -0.0 is 0.0
            ids.append(f"{label.as_py()}:{xxhash.xxh3_128_hexdigest(raw)}")
            values.append(raw)
        yield pa.RecordBatch.from_pydict(
            {
                "vec_id": batch["vec_id"],
                "label": batch["label"].cast(pa.string()),
                "class": pa.array(ids, pa.string()),
                "vector": pa.array(values, pa.binary()),
            }
        )


def _keyed(passes: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.frombuffer(x.as_py(), np.float64) for x in batch["vector"]]
            sizes = np.array([len(v) for v in vectors], np.int32)
            weights = 1 << np.arange(KEY_BITS, dtype=np.int64)[::-1]
            keys = np.zeros((passes, len(vectors)), np.int64)
            rough: list[bytes] = [b""] * len(vectors)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.array([vectors[i] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                if size not in known:
                    known[size] = np.concatenate([planes(int(size), p) for p in range(passes)], axis=1)
                signs = (x @ known[size] > 0).reshape(len(at), passes, KEY_BITS)
                keys[:, at] = (signs * weights).sum(axis=2).T
                for i, q in zip(at, np.round(x * 127).astype(np.int8)):
                    rough[i] = q.tobytes()
            for p in range(passes):
                yield pa.RecordBatch.from_pydict(
                    {
                        "turn": pa.array([p] * len(vectors), pa.int32()),
                        "label": batch["label"],
                        "size": pa.array(sizes),
                        "key": pa.array(keys[p]),
                        "class": batch["class"],
                        "rough": pa.array(rough, pa.binary()),
                    }
                )

    return keyed


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root of each of n nodes over links i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def _near(rough: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart whose rough cosine is near the bound."""
    x = rough.astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = [np.empty((2, 0), np.int64)]
    for d in range(1, min(window, len(x) - 1) + 1):
        at = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= MIN_COSINE - ROUGH)
        found.append(np.stack([at, at + d]))
    return tuple(np.concatenate(found, axis=1))


LINKED = "a string, b string, turn int, label string, size int, place int, side int, class string, rough binary"


def _links_in_run(classes: np.ndarray, rough: np.ndarray, window: int) -> list[tuple[str, str]]:
    root = _forest(len(classes), *_near(rough, window))
    at = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(classes[at].tolist(), classes[root[at]].tolist()))


def _swept(window: int):
    """Links within a sorted partition, and the rows at its two ends."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        tail: list[tuple] = []
        head: list[tuple] = []
        full = False

        def out(links: list[tuple[str, str]], ends: list[tuple[int, tuple]]) -> pa.RecordBatch:
            none, blank = [None] * len(links), [None] * len(ends)
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([x[0] for x in links] + blank, pa.string()),
                    "b": pa.array([x[1] for x in links] + blank, pa.string()),
                    "turn": pa.array(none + [r[0] for _, r in ends], pa.int32()),
                    "label": pa.array(none + [r[1] for _, r in ends], pa.string()),
                    "size": pa.array(none + [r[2] for _, r in ends], pa.int32()),
                    "place": pa.array(none + [place - (side == 0) for side, _ in ends], pa.int32()),
                    "side": pa.array(none + [side for side, _ in ends], pa.int32()),
                    "class": pa.array(none + [r[3] for _, r in ends], pa.string()),
                    "rough": pa.array(none + [r[4] for _, r in ends], pa.binary()),
                }
            )

        for batch in batches:
            rows = tail + list(zip(*(batch[c].to_pylist() for c in ("turn", "label", "size", "class", "rough"))))
            if not full:
                head = rows[:window]
                full = len(head) == window
            yield out(_runs_linked(rows, window), [])
            tail = rows[-window:]
        # Side 0: the first rows, for the boundary before; side 1: the last, for the one after.
        yield out([], [(0, r) for r in head] + [(1, r) for r in tail])

    return swept


def _runs_linked(rows: list[tuple], window: int) -> list[tuple[str, str]]:
    links, start = [], 0
    for stop in range(1, len(rows) + 1):
        if stop == len(rows) or rows[stop][:3] != rows[start][:3]:
            if stop - start > 1:
                part = rows[start:stop]
                rough = np.frombuffer(b"".join(r[4] for r in part), np.int8).reshape(len(part), -1)
                links += _links_in_run(np.array([r[3] for r in part]), rough, window)
            start = stop
    return links


def _across(window: int):
    def across(ends: pa.Table) -> pa.Table:
        ends = ends.sort_by([("side", "descending")])
        rows = list(zip(*(ends[c].to_pylist() for c in ("turn", "label", "size", "class", "rough"))))
        sides = ends["side"].to_pylist()
        links = []
        for kind in {r[:3] for r in rows}:
            part = [r for r, s in zip(rows, sides) if r[:3] == kind]
            if len(part) > 1:
                links += _runs_linked(part, 2 * window)
        return pa.table({"a": pa.array([x[0] for x in links], pa.string()), "b": pa.array([x[1] for x in links], pa.string())})

    return across


def _verified(rows: pa.Table) -> pa.Table:
    """Of each pair of blocks: links per class (copies weigh) and a forest of the links."""
    rows = rows.sort_by([("pair", "ascending"), ("class", "ascending")])
    pair, classes = rows["pair"].to_numpy(), np.array(rows["class"].to_pylist(), object)
    part, copies = rows["part"].to_numpy(), rows["copies"].to_numpy()
    size = rows["size"].to_numpy()
    raw = rows["vector"].to_pylist()
    named, counts, roots = [], [], []
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, int)
    for a, b in zip(starts, [*starts[1:], len(pair)]):
        for s in np.unique(size[a:b]):
            at = a + np.flatnonzero(size[a:b] == s)
            x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            linked = (x @ x.T) / np.outer(norm, norm) >= MIN_COSINE
            np.fill_diagonal(linked, False)
            if len(np.unique(part[a:b])) > 1:  # pairs inside a block are another task's
                linked &= part[at][:, None] != part[at][None, :]
            root = _forest(len(at), *np.nonzero(np.triu(linked)))
            named += classes[at].tolist()
            counts += (linked @ copies[at]).tolist()
            roots += classes[at][root].tolist()
    return pa.table(
        {"class": pa.array(named, pa.string()), "links": pa.array(counts, pa.int64()), "root": pa.array(roots, pa.string())}
    )


def embedding_dedup(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label)."""
    vectors = vectors.select("vec_id", "embedding", "label")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = written(
        vectors.mapInArrow(_described, f"vec_id {id_type}, label string, class string, vector binary"), "vectors"
    )
    classes = rows.where("class is not null").groupBy("class", "label", "vector").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")
    )
    classes = written(classes, "vector-classes")
    keyed = classes.select("class", "label", "vector").mapInArrow(
        _keyed(passes), "turn int, label string, size int, key long, class string, rough binary"
    )
    order = ["turn", "label", "size", "key", "class"]
    keyed = written(keyed, "vector-keys").repartitionByRange(*order).sortWithinPartitions(*order)
    swept = written(keyed.select("turn", "label", "size", "class", "rough").mapInArrow(_swept(window), LINKED), "swept")
    ends = swept.where("side is not null").select("turn", "label", "size", "place", "side", "class", "rough")
    near = swept.where("a is not null").select("a", "b").union(
        ends.groupBy("place").applyInArrow(_across(window), "a string, b string")
    )
    groups = components(near).select(F.col("id").alias("class"), F.col("component").alias("group"))
    members = written(
        classes.select("class", "vector", "copies", (F.length("vector") / 8).cast("int").alias("size")).join(groups, "class"),
        "vector-groups",
    )
    sizes = members.groupBy("group").agg(F.count("*").alias("of"))
    parts = F.ceil(F.col("of") / BLOCK).cast("int")
    dealt = members.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("pair", F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")))
    tasks = max(1, members.count() // TASK_ROWS + 1)
    # Pairs of blocks are tasks of their own; small groups share one.
    dealt = dealt.withColumn("task", F.when(F.col("of") > BLOCK, F.col("pair")).otherwise(F.pmod("pair", F.lit(tasks))))
    verified = written(
        dealt.select("task", "pair", "class", "part", "copies", "size", "vector")
        .groupBy("task")
        .applyInArrow(_verified, "class string, links long, root string"),
        "vector-links",
    )
    counts = verified.groupBy("class").agg(F.sum("links").alias("links"))
    joint = components(verified.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "vec_id", "copies").join(joint.withColumnRenamed("id", "class"), "class", "left")
    named = named.join(counts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = written(named, "vector-components")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    told = named.join(least, "component").select(
        "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("vec_id", "class").join(told, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a
  ) SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
       r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id
"""
