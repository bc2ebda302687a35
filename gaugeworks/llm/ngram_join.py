"""Near-duplicate documents by exact Jaccard similarity of their word shingles, with signature trees.

Two documents are linked when 100 * |intersection| >= 80 * |union| over their distinct
5-word shingles (words: `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text with fewer words is one
shingle). The result tells each document's set size and component.

1. Documents with the same set are one class from here on; only classes are compared.
2. Two similar sets share a shingle among the first n - ceil(0.8 n) + 1 of either, in any order
   common to all. The order is by frequency (from a sketch of the counts of all shingles, rare
   first), so passages that many documents share come last. Shingles that one class alone has among
   its first ones are left out; what is left are groups of classes that share one.
3. Classes with an equal minimum under one of PERMUTATIONS hash orders are verified against the
   group's two end classes. That is a row per class, and makes large families one component, whose
   inner pairs need no more work: links inside a component cannot change the result.
4. Groups of the same classes are one. Each is a signature tree: leaves hold a class's bitmap of
   shingles, its size and its component so far; a node the bitwise or of its children, the range of their sizes, the most
   shingles that share a bit with others of their set, and the component if all have one. A dual
   traversal from the root against itself drops node pairs whose largest possible overlap is too
   small for their least sizes, and those of one component. A group too large for a task is cut into
   parts that are compared in pairs, one task each.
5. The leaf pairs that remain are verified on the whole sets, in two rounds. The first has, of each tree,
   only those with its HUBS most central classes, of whose first shingles most are shared; they make a
   family with its original one component, and the second round's trees leave that alone. Components
   follow from all links.

Defined cases. Null or blank texts have an empty set (n_shingles 0) and are linked with nothing.
Repeated rows are copies of one document. component_id is the smallest doc_id of the component;
null ids do not count, and a component without any has a null. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import BROADCAST_ROWS, Bits, components, fresh, table
from gaugeworks.llm.wording import stretches
from gaugeworks.session import written

WORDS = 5
PERMUTATIONS = 4
#: Counters of the frequency sketch: 16 MB. Order, not results, depends on it.
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
FILTER_BITS = 26
#: Bits of a leaf's bitmap, and children of a node.
BITMAP = 4096
FANOUT = 4
#: Members of a tree; a larger group is cut into parts of half of this.
TREE_ROWS = 4000
#: Rows in a task of trees, copies for pairs of parts included.
TASK_ROWS = 20_000
#: Classes of a tree that the others are compared with first.
HUBS = 3
#: Sets that a task holds before it puts out what they give.
HELD = 500
#: A long of the low digits of a set's name.
LOW_ID = "cast(conv(right(set_id, 15), 16, 10) as bigint)"
#: Bytes of texts that are hashed at once; a text of more than twice as many is hashed in such pieces.
PIECE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


#: A random number for each byte, capitals as small letters; words are sums of these by place.
_BYTES = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = re.compile(rb"[ \t-\r]")
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_STEP, _BACK):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of texts laid end to end, that begin at `begins`."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins[begins < len(data)]] = True
    edge[-1] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end[:-1] &= ~end[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    up, down = _powers(1 << max(PIECE, len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    # The same bytes sum to the same number wherever they stand, once shifted back.
    return _mixed((total[last + 1] - total[first]) * down[first]), first


def _word_hash(word: bytes) -> np.ndarray:
    """The same hash of one long word."""
    total, shift = 0, 1
    for at in range(0, len(word), PIECE):
        data = np.frombuffer(word[at : at + PIECE], np.uint8)
        up = _powers(1 << PIECE.bit_length())[0]
        total += int((_BYTES[data] * up[: len(data)]).sum()) * shift
        shift = shift * pow(_STEP, len(data), 1 << 64) % (1 << 64)
    return _mixed(np.array([total % (1 << 64)], np.uint64))


def _long_text(text: bytes) -> np.ndarray:
    """The hashes of a long text's words, found in pieces."""
    out, begins = [], np.zeros(1, np.int64)
    for part in stretches(text, _BLANK, PIECE):
        if len(part) > 2 * PIECE:
            # It ends in a word that is longer than a piece.
            head = 1 + max(part.rfind(bytes([c]), 0, PIECE) for c in b" \t\n\x0b\x0c\r")
            out.append(_words(np.frombuffer(part[:head], np.uint8), begins)[0])
            out.append(_word_hash(part[head:].rstrip()))
        else:
            out.append(_words(np.frombuffer(part, np.uint8), begins)[0])
    return np.concatenate(out)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles) for every text."""
    text = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, "right")) - 1)
        begins = ends[row : stop + 1] - ends[row]
        if begins[-1] > 2 * PIECE:
            word = _long_text(data[ends[row] : ends[stop]].tobytes())
            edges = np.array([0, len(word)])
        else:
            word, first = _words(data[ends[row] : ends[stop]], begins[:-1])
            edges = np.searchsorted(first, begins)
        whole = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for i in range(WORDS):
            whole = _mixed(whole * np.uint64(_STEP) + word[i : i + len(whole)])
        for k in range(stop - row):
            a, b = int(edges[k]), int(edges[k + 1])
            if b - a >= WORDS:
                yield row + k, np.unique(whole[a : b - WORDS + 1])
                continue
            x = np.zeros(int(b > a), np.uint64)
            for h in word[a:b]:
                x = _mixed(x * np.uint64(_STEP) + h)
            yield row + k, x
        row = stop


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """100 * common >= 80 * (a + b - common)."""
    return 9 * common >= 4 * (a + b)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its size, class and minima; at the end what the task adds to the sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    factors = [np.uint64(2 * xxhash.xxh64_intdigest(bytes([k])) + 1 & (1 << 64) - 1) for k in range(PERMUTATIONS)]
    id_type = pa.int64()
    for batch in batches:
        rows, id_type = [], batch["doc_id"].type
        for _, x in shingle_sets(batch["text"]):
            if not len(x):
                rows.append((0, None, None))
                continue
            np.add.at(counts, x >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
            least = [int(np.min(x * f).view(np.int64)) for f in factors]
            rows.append((len(x), xxhash.xxh3_128_hexdigest(x.tobytes()), least))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "n": pa.array([r[0] for r in rows], pa.int64()),
                "set_id": pa.array([r[1] for r in rows], pa.string()),
                "least": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                "block": pa.nulls(len(rows), pa.int32()),
                "counts": pa.nulls(len(rows), pa.binary()),
            }
        )
    blocks = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, SKETCH_BLOCK)
    some = [i for i in range(len(blocks)) if blocks[i].any()]
    packer = zstandard.ZstdCompressor(level=1)
    yield pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.nulls(len(some), id_type),
            "text_hash": pa.nulls(len(some), pa.int64()),
            "n": pa.nulls(len(some), pa.int64()),
            "set_id": pa.nulls(len(some), pa.string()),
            "least": pa.nulls(len(some), pa.list_(pa.int64())),
            "block": pa.array(some, pa.int32()),
            "counts": pa.array([packer.compress(blocks[i].tobytes()) for i in some], pa.binary()),
        }
    )


def _block_sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH_BLOCK, np.uint32)
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        for x in batch["counts"]:
            total += np.frombuffer(opener.decompress(x.as_py()), np.uint16)
    yield pa.RecordBatch.from_pydict(
        {"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())}
    )


def first_shingles(x: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The shingles of which any similar set shares one."""
    n = len(x) - -(-4 * len(x) // 5) + 1
    if n >= len(x):
        return x
    # Rare first, then by the hash's low bits, then by all: one order for all sets.
    slot = x >> np.uint64(65 - len(sketch).bit_length())
    count = np.minimum(sketch[slot], (1 << 20) - 1).astype(np.uint64)
    low = np.uint64(44)
    rank = np.argsort(count << low | x & ((np.uint64(1) << low) - np.uint64(1)), kind="stable")
    return x[rank[:n]]


def bitmap(x: np.ndarray) -> np.ndarray:
    out = np.zeros(BITMAP, np.uint8)
    out[(_mixed(x) & np.uint64(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(out)


def _levels(bits: np.ndarray, n: np.ndarray, component: np.ndarray, tree: np.ndarray) -> list[tuple]:
    """Leaves to roots of all trees: (bitmaps, least and most size, excess, component or -1, first
    child, children), nodes sorted by tree. The last level has one node for each tree."""
    excess = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    none = np.zeros(len(n), np.int64)
    levels = [(bits, n, n, excess, component, none, none)]
    while True:
        bits, least, most, excess, component, _, _ = levels[-1]
        first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        place = np.arange(len(tree)) - np.repeat(first, np.diff(np.r_[first, len(tree)]))
        at = np.flatnonzero(place % FANOUT == 0)
        if len(levels) > 1 and len(first) == len(tree):
            return levels
        low, high = np.minimum.reduceat(component, at), np.maximum.reduceat(component, at)
        levels.append(
            (
                np.bitwise_or.reduceat(bits, at, axis=0),
                np.minimum.reduceat(least, at),
                np.maximum.reduceat(most, at),
                np.maximum.reduceat(excess, at),
                np.where(low == high, low, -1),
                at,
                np.diff(np.r_[at, len(tree)]),
            )
        )
        tree = tree[at]


def _may_be_similar(level: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of node pairs, those under which some pair of different components may be similar."""
    bits, least, most, excess, component, _, _ = level
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 8192):
        a, b = x[at : at + 8192], y[at : at + 8192]
        # Shingles in common lie in common bits; more than one to a bit only where a set has them so.
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
        overlap += np.minimum(excess[a], excess[b])
        overlap = np.minimum(overlap, np.minimum(most[a], most[b]))
        out[at : at + 8192] = similar(overlap, least[a], least[b])
    # Of the sizes in the two ranges, some must be within the ratio.
    out &= (5 * most[x] >= 4 * least[y]) & (5 * most[y] >= 4 * least[x])
    return out & ((component[x] < 0) | (component[x] != component[y]))


def tree_pairs(
    bits: np.ndarray,
    n: np.ndarray,
    component: np.ndarray,
    part: np.ndarray | None = None,
    tree: np.ndarray | None = None,
) -> np.ndarray:
    """Leaf pairs of one tree and different components that may be similar, by dual traversal.

    All trees are gone through at once, level by level. part: in a tree with leaves of two parts only
    pairs across them are looked for.
    """
    tree = np.zeros(len(n), np.int64) if tree is None else tree
    if not len(n):
        return np.empty((0, 2), np.int64)
    order = np.lexsort((n, component, tree))
    levels = _levels(bits[order], n[order], component[order], tree[order])
    a = b = np.arange(len(levels[-1][1]))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
    for depth in range(len(levels) - 1, 0, -1):
        keep = (levels[depth][4][a] < 0) | (a != b)
        if depth < len(levels) - 1:
            keep &= _may_be_similar(levels[depth], a, b)
        a, b = a[keep], b[keep]
        first, children = levels[depth][5:]
        below = []
        for at in range(0, len(a), 1 << 18):
            x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            c, d = first[x][:, None] + i, first[y][:, None] + j
            there = (i < children[x][:, None]) & (j < children[y][:, None]) & (c <= d)
            below.append((c[there], d[there]))
        a, b = (np.concatenate([p[k] for p in below]) if below else np.empty(0, np.int64) for k in (0, 1))
    keep = a != b
    a, b = a[keep], b[keep]
    keep = _may_be_similar(levels[0], a, b)
    a, b = order[a[keep]], order[b[keep]]
    if part is not None and len(a):
        first = np.unique(tree, return_inverse=True)[1]
        low, high = np.full(first.max() + 1, np.iinfo(part.dtype).max), np.full(first.max() + 1, -1)
        np.minimum.at(low, first, part)
        np.maximum.at(high, first, part)
        keep = (low == high)[first[a]] | (part[a] != part[b])
        a, b = a[keep], b[keep]
    return np.stack([a, b], axis=1)


def hub_pairs(
    bits: np.ndarray, n: np.ndarray, component: np.ndarray, share: np.ndarray, tree: np.ndarray
) -> np.ndarray:
    """Leaf pairs as `tree_pairs` finds them, of every leaf with the HUBS of its tree of the greatest share."""
    order = np.lexsort((-share, tree))
    excess = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    level = (bits, n, n, excess, component, None, None)
    first = np.flatnonzero(np.r_[True, tree[order][1:] != tree[order][:-1]])
    size = np.diff(np.r_[first, len(order)])
    found = []
    for k in range(HUBS):
        some = size > k
        a = order[np.repeat(first[some] + k, size[some])]
        b = order[np.repeat(some, size)]
        keep = a != b
        a, b = a[keep], b[keep]
        keep = _may_be_similar(level, a, b)
        found.append(np.stack([a[keep], b[keep]], axis=1))
    return np.concatenate(found)


def _in_task(rows: pa.Table, hubs: bool) -> pa.Table:
    """Pairs of the trees of a task that may be similar, each once."""
    ids = np.array(rows["set_id"].to_pylist(), object)
    component = np.unique(np.array(rows["component"].to_pylist(), object), return_inverse=True)[1].astype(np.int64)
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
    n, tree = rows["n"].to_numpy(), rows["tree"].to_numpy()
    if hubs:
        found = hub_pairs(bits, n, component, rows["share"].to_numpy(), tree)
    else:
        found = tree_pairs(bits, n, component, rows["part"].to_numpy(), tree)
    # Pairs of several trees of the task go once.
    names, code = np.unique(ids, return_inverse=True)
    low, high = np.minimum(code[found[:, 0]], code[found[:, 1]]), np.maximum(code[found[:, 0]], code[found[:, 1]])
    pair = np.unique(low.astype(np.int64) * len(names) + high)
    a, b = names[pair // max(1, len(names))], names[pair % max(1, len(names))]
    return pa.table({"a": pa.array(a.tolist(), pa.string()), "b": pa.array(b.tolist(), pa.string())})


def _hub_pairs(rows: pa.Table) -> pa.Table:
    return _in_task(rows, True)


def _pairs_in_trees(rows: pa.Table) -> pa.Table:
    return _in_task(rows, False)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stay = []
        for x, y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            stay.append(bool(similar(int((x[at] == y).sum()), len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are similar, verified on the whole sets."""
    told = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a")
    told = told.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    return written(told.select("a", "b", "x", "y").mapInArrow(_verified, "a string, b string"), "links")


def _groups(postings: DataFrame) -> DataFrame:
    """(shingle, size) of the groups of postings (shingle, set_id, n, component) that may hold a new link.

    Classes that share one first shingle mostly share many: of groups of the same classes one stands for all.
    """
    members = [F.bit_xor(F.xxhash64(F.lit(seed), "set_id")).alias(f"_members{seed}") for seed in (0, 1)]
    component = F.xxhash64("component")
    sizes = postings.groupBy("shingle").agg(
        F.count("*").alias("size"), F.min(component).alias("one"), F.max(component).alias("other"),
        F.min("n").alias("least"), F.max("n").alias("most"), *members,
    )
    # Two sets that differ too much in size cannot be similar.
    sizes = sizes.where("one <> other and (size > 2 or 5 * least >= 4 * most)")
    sizes = sizes.groupBy("size", "_members0", "_members1").agg(F.min("shingle").alias("shingle"))
    return written(sizes.select("shingle", "size"), "groups")


def _tree_rows(postings: DataFrame, maps: DataFrame, tree_rows: int) -> DataFrame:
    """postings (shingle, set_id, n, share, component) by tree: all of a group, or two parts of a large one."""
    sizes = _groups(postings)
    grouped = postings.join(sizes, "shingle")
    small = grouped.where(F.col("size") <= tree_rows).select(
        "*", F.xxhash64("shingle").alias("tree"), F.lit(0).alias("part")
    )
    large = grouped.where(F.col("size") > tree_rows)
    parts = F.ceil(F.col("size") / (tree_rows // 2)).cast("int")
    large = large.withColumn("part", F.pmod(F.xxhash64("set_id"), parts).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    # A part by itself is in the pair with itself; pairs of parts look for pairs across only.
    large = large.withColumn(
        "tree", F.xxhash64("shingle", F.least("part", "other"), F.greatest("part", "other"))
    )
    names = ["tree", "part", "set_id", "n", "share", "component"]
    both = small.select(names).union(large.select(names)).join(maps, "set_id")
    copies = F.when(F.col("size") > tree_rows, F.col("size") * parts).otherwise(F.col("size"))
    tasks = max(1, sizes.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0] // TASK_ROWS + 1)
    return both.withColumn("task", F.pmod(F.xxhash64("tree"), F.lit(tasks)))


def ngram_join(docs: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    rows, named = grouped(docs, tree_rows)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = named.join(least, "component").select("set_id", "component_id")
    out = rows.select("doc_id", "n", "set_id").join(told, "set_id", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def grouped(docs: DataFrame, tree_rows: int = TREE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, set_id, ..) of each row, and (set_id, component, doc_id) of each set but the empty one."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    described = written(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
            _described, f"doc_id {id_type}, text_hash long, n long, set_id string, least array<long>, block int, counts binary"
        ),
        "shingled",
    )
    sums = described.where("block is not null").select("block", "counts").groupBy("block")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in sums.applyInArrow(_block_sum, "block int, counts binary").toLocalIterator():
        sketch[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = np.frombuffer(row.counts, np.uint32)
    rows = described.where("block is null").select("doc_id", "text_hash", "n", "set_id", "least")
    # Few shingles need few counters: neighbouring ones are added up.
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(SKETCH_BITS, max(10, (total // 4).bit_length()))
    order = spark.sparkContext.broadcast(sketch.reshape(1 << bits, -1).sum(axis=1, dtype=np.uint32))
    del sketch  # 16 MB of the driver's
    classes = written(
        rows.where("n > 0").groupBy("set_id", "n", "least").agg(F.min("doc_id").alias("doc_id")), "classes"
    )

    # One document stands for its class; the few others that pass only repeat its rows.
    standing = spark.sparkContext.broadcast(Bits(classes.select(F.xxhash64("doc_id").alias("h")), "h", FILTER_BITS))
    keyed = docs.select(F.xxhash64("doc_id").alias("h"), "text")

    def standing_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, np.ndarray]]]:
        seen: set[str] = set()
        found = []
        for batch in batches:
            some = batch.filter(pa.array(standing.value.has(batch["h"].to_numpy())))
            for _, x in shingle_sets(some["text"]):
                set_id = xxhash.xxh3_128_hexdigest(x.tobytes())
                if len(x) and set_id not in seen:
                    seen.add(set_id)
                    found.append((set_id, x))
                if len(found) >= HELD:
                    yield found
                    found = []
        yield found

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in standing_sets(batches):
            out = [first_shingles(x, order.value) for _, x in found]
            if out:
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(out).view(np.int64)})

    counted = keyed.mapInArrow(firsts, "shingle long").groupBy("shingle").count()
    again = written(counted.where("count > 1").select("shingle"), "shared-shingles")
    shared = spark.sparkContext.broadcast(Bits(again, "shingle", FILTER_BITS))

    # Stars: every class of an equal minimum against the ends of its group.
    minima = classes.select(F.struct("set_id", "n").alias("own"), F.posexplode("least").alias("k", "least"))
    ends = minima.groupBy("k", "least").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    stars = minima.join(ends.where("low <> high"), ["k", "least"])
    stars = stars.select("own", F.explode(F.array("low", "high")).alias("end"))
    stars = stars.where("own <> end and 5 * own.n >= 4 * end.n and 5 * end.n >= 4 * own.n").select(
        F.least("own.set_id", "end.set_id").alias("a"), F.greatest("own.set_id", "end.set_id").alias("b")
    ).distinct()
    stars = written(stars, "stars")

    def fetched(pairs: DataFrame) -> DataFrame:
        """The whole sets of all classes in some pair."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        ids = written(ids.select(F.expr(f"{LOW_ID} as h")), "pair-ids")
        wanted = spark.sparkContext.broadcast(Bits(ids, "h", FILTER_BITS))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in standing_sets(batches):
                hit = wanted.value.has(np.array([int(i[-15:], 16) for i, _ in found], np.int64))
                rows = [(i, x.tobytes()) for (i, x), yes in zip(found, hit) if yes]
                yield pa.RecordBatch.from_pydict(
                    {
                        "set_id": pa.array([r[0] for r in rows], pa.string()),
                        "shingles": pa.array([r[1] for r in rows], pa.binary()),
                    }
                )

        return written(keyed.mapInArrow(pick, "set_id string, shingles binary"), "pair-sets")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in standing_sets(batches):
            rows = []
            for set_id, x in found:
                first = first_shingles(x, order.value).view(np.int64)
                hit = first[shared.value.has(first)]
                if len(hit):
                    rows.append((set_id, len(x), len(hit) / len(first), bitmap(x).tobytes(), hit))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()))
            names = ("set_id", "n", "share", "bits", "firsts")
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    links = _links(stars, fetched(stars))
    kinds = "set_id string, n long, share double, bits binary, firsts array<long>"
    maps = written(keyed.mapInArrow(candidates, kinds).dropDuplicates(["set_id"]), "bitmaps")
    bits = maps.select("set_id", "bits")
    joint = written(components(links), "star-components").withColumnRenamed("id", "set_id")
    own = F.coalesce("component", "set_id").alias("component")
    met = maps.join(joint, "set_id", "left").select("set_id", "n", own, F.explode("firsts").alias("shingle"))
    groups = _groups(met)
    open_groups = spark.sparkContext.broadcast(Bits(groups, "shingle", FILTER_BITS))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of the groups that stand for all, and of a few others."""
        for batch in batches:
            lists = batch["firsts"]
            shingles = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(open_groups.value.has(shingles.to_numpy()))
            columns = [batch[c].take(pa.array(row[hit])) for c in ("set_id", "n", "share")]
            yield pa.RecordBatch.from_arrays([*columns, shingles.take(pa.array(hit))], names=["set_id", "n", "share", "shingle"])

    postings = maps.select("set_id", "n", "share", "firsts").mapInArrow(
        members, "set_id string, n long, share double, shingle long"
    )
    postings = written(postings.join(groups.select("shingle"), "shingle"), "postings")
    for search, name in ((_hub_pairs, "hub"), (_pairs_in_trees, "tree")):
        told = postings.join(joint, "set_id", "left").withColumn("component", own)
        # Read three times.
        trees = _tree_rows(written(told, f"{name}-postings"), bits, tree_rows)
        pairs = written(trees.groupBy("task").applyInArrow(search, "a string, b string").distinct(), f"{name}-pairs")
        links = links.union(_links(pairs, fetched(pairs)))
        joint = written(components(links), f"{name}-components").withColumnRenamed("id", "set_id")
    named = classes.join(joint, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = written(named.select("set_id", "component", "doc_id"), "named")
    return rows, named


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
           lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a
  ) SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id FROM sets s JOIN reach r ON r.a = s.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest id, null ids last, and smallest text hash.

    Repeated rows are a group's as well, and one of them stays. Rows without a word are in no group and stay.
    """
    rows, named = grouped(docs)
    keys = rows.where("n > 0").groupBy("doc_id", "text_hash", "set_id").agg(F.count("*").alias("rows"))
    keys = keys.join(named.select("set_id", "component"), "set_id").withColumn(
        "own", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    )
    keys = written(keys.select("component", "own", "rows"), "near-keys")
    first = written(keys.groupBy("component").agg(F.min("own").alias("first")), "near-first")
    stays = F.col("own").eqNullSafe(F.col("first")).alias("stays")
    told = written(keys.join(first, "component").select("own", "rows", stays), "near-told")
    id_, hash_ = fresh(docs, "id", "hash")

    def among(own: DataFrame, how: str) -> DataFrame:
        small = own.select(F.col("own.doc_id").alias(id_), F.col("own.text_hash").alias(hash_))
        if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            small = F.broadcast(small)
        return docs.join(small, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), how)

    again = told.where("stays and rows > 1")
    if again.isEmpty():
        return among(told.where("not stays"), "left_anti").select(docs.columns)
    # Rows of which one stays go through a shuffle, all others do not.
    one = among(again, "inner").dropDuplicates([id_, hash_]).select(docs.columns)
    return among(told.where("not stays or rows > 1"), "left_anti").select(docs.columns).union(one)
