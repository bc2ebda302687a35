"""Repeated passages: merged positional Burrows-Wheeler transforms of the places that can repeat.

Every byte covered by a WINDOW-byte string that also starts anywhere else (same document or
another) is removed. Strings are judged on the input, not on what is left; matches never cross
documents.

1. Anchors. Each window's anchor is the ANCHOR-byte string in it with the smallest hash
   (leftmost of equal ones), so equal windows have equal anchors at equal offsets. Consecutive
   windows with one anchor make a segment, about 285 bytes with its last window. Anchors that
   occur once cannot hold a repeated window; segments that are equal throughout repeat throughout.
2. Transforms. What is left are anchors with different segments around them. All segments of
   an anchor are aligned on it, so only suffixes starting in the same column can be equal. Each
   shard of segments gets the transform of every column: the symbols of that column in the order
   of the suffixes behind it. Shards are merged by refining an interleave: the vector that says
   which shard the next suffix comes from, sorted for the suffixes behind a column, becomes the
   one for the column by one stable distribution over its symbols. Nothing is sorted anew.
   Common prefixes of neighbours follow from the same step (one more than the least between
   them); intervals with common prefixes of WINDOW bytes are the repeated windows.
3. Repeated windows of a document are joined back to it, and cut out.

An anchor with more than GROUP_ROWS different segments is not put into one task: its windows
are counted by their digest, in rows spread over all tasks.

Defined cases. A null text is an empty one: nothing removed, kept is empty bytes. Texts shorter
than WINDOW never lose anything, being the same as others included. Repeated rows repeat their
windows. Null ids, further columns and names that clash are kept as they are; the added columns
replace columns of their names. Hashes of segments have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from gaugeworks.llm.common import Bits, fresh, table
from gaugeworks.session import written

WINDOW = 200
ANCHOR = 32
#: Starts of anchors in a window.
STARTS = WINDOW - ANCHOR + 1
#: Bytes worked on at once; longer texts are taken in pieces that overlap by a window.
PIECE = 1 << 18
#: Segments of one anchor that a task takes; anchors with more are counted window by window.
GROUP_ROWS = 20_000
#: Segments in a task, and in a shard before merging.
BUCKET_ROWS = 10_000
SHARD_ROWS = 4096
#: Bits of the filter that tells where to look again; false hits only cost rows.
FILTER_BITS = 26
END = 256


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ANCHOR-byte string."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    x, step = eight * np.uint64(0x9E3779B97F4A7C15), 8
    x ^= x >> np.uint64(32)
    while step < ANCHOR:
        x = x[:-step] * np.uint64(0xBF58476D1CE4E5B9) + x[step:]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        step *= 2
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each segment.

    room: for every byte, how many bytes its document has from there on.
    """
    if len(data) < WINDOW:
        return (np.empty(0, np.int64),) * 4
    x = _hashes(data)
    bits = np.uint64(PIECE.bit_length() + 1)
    place = np.arange(len(x), dtype=np.uint64)
    least = _least((x >> bits << bits) | place, STARTS) & ((np.uint64(1) << bits) - np.uint64(1))
    at = np.flatnonzero(room[: len(least)] >= WINDOW)
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    own = least[at].astype(np.int64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    last = np.r_[first[1:], len(own)] - 1
    anchors = own[first]
    return x[anchors].view(np.int64), anchors, at[first], at[last]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, room, row of each document, where it begins) for documents laid end to end.

    A long text comes as pieces on their own, each window in one of them; a piece's begin is
    then minus its place in the text.
    """
    text = pc.fill_null(batch["text"], "").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        begin, size = ends[row], ends[row + 1] - ends[row]
        if size > PIECE:
            for at in range(0, size - WINDOW + 1, PIECE - WINDOW + 1):
                part = data[begin + at : min(begin + at + PIECE, ends[row + 1])]
                yield part, np.arange(len(part), 0, -1), np.array([row]), np.array([-at])
            row += 1
            continue
        stop = int(np.searchsorted(ends, begin + PIECE, "right")) - 1
        own = ends[row : stop + 1] - begin
        part = data[begin : begin + own[-1]]
        yield part, np.repeat(own[1:], np.diff(own)) - np.arange(len(part)), np.arange(row, stop), own[:-1]
        row = stop


def _segment_hashes(part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    view = memoryview(part)
    spans = zip(lo.tolist(), (hi + WINDOW).tolist())
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans], np.uint64).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, room, _, _ in pieces(batch):
            anchor, _, lo, hi = segments(part, room)
            if len(anchor):
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "segment": _segment_hashes(part, lo, hi)})


def positional_bwt(columns: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every column its symbols in the order of (group, suffix behind the column).

    columns: symbols by column and row, rows sorted by group.
    """
    out = np.empty_like(columns)
    order = np.arange(columns.shape[1])
    for c in range(len(columns) - 1, -1, -1):
        out[c] = columns[c, order]
        order = order[np.argsort(group[order] * (END + 1) + out[c], kind="stable")]
    return out


def merged_repeats(shards: list[tuple[np.ndarray, np.ndarray]], window: int) -> list[np.ndarray]:
    """By shard (columns x rows): whether the row's window starting in the column occurs in another row.

    shards: (transform, group of each row) with rows sorted by group. The transforms are merged
    by refining the interleave from the last column to the first.
    """
    sizes = [len(g) for _, g in shards]
    bwt = np.concatenate([b for b, _ in shards], axis=1)
    groups = np.concatenate([g for _, g in shards])
    source = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    start = np.argsort(groups, kind="stable")
    n = len(groups)
    # All suffixes behind the last column are empty: ordered by group, then by shard.
    turn, rows, group = source[start], start, groups[start]
    common = np.zeros(n + 1, np.int32)
    found = np.zeros((bwt.shape[0] - window + 1, n), bool)
    for c in range(bwt.shape[0] - 1, -1, -1):
        symbol = np.empty(n, bwt.dtype)
        symbol[np.argsort(turn, kind="stable")] = bwt[c]
        key = group * (END + 1) + symbol
        move = np.argsort(key, kind="stable")
        key, turn, rows = key[move], turn[move], rows[move]
        fresh_common = np.zeros(n + 1, np.int32)
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[move][1:] != END))
        if len(same):
            a, b = move[same] + 1, move[same + 1] + 1
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = a, b
            least = np.minimum.reduceat(common, spans)[::2]
            fresh_common[same + 1] = np.minimum(least + 1, window)
        common = fresh_common
        if c < len(found):
            hit = common >= window
            found[c, rows] = hit[:-1] | hit[1:]
    cuts = np.cumsum(sizes)[:-1]
    return np.split(found, cuts, axis=1)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _repeats_in_bucket(rows: pa.Table) -> pa.Table:
    """(anchor, segment, repeated) with the first and last windows of runs, from the segment's begin."""
    rows = rows.sort_by([("anchor", "ascending"), ("segment", "ascending")])
    anchor, before = rows["anchor"].to_numpy(), rows["before"].to_numpy()
    content = rows["content"].to_pylist()
    group = np.unique(anchor, return_inverse=True)[1].astype(np.int64)
    shards = []
    for at in range(0, len(content), SHARD_ROWS):
        part = range(at, min(at + SHARD_ROWS, len(content)))
        columns = np.full((len(part), STARTS - 1 + WINDOW), END, np.int64)
        for i, r in enumerate(part):
            skip = STARTS - 1 - before[r]
            columns[i, skip : skip + len(content[r])] = np.frombuffer(content[r], np.uint8)
        own = group[part.start : part.stop]
        shards.append((positional_bwt(columns.T, own).astype(np.int16), own))
    found = np.concatenate(merged_repeats(shards, WINDOW), axis=1)
    repeated = []
    for r in range(len(content)):
        skip = STARTS - 1 - before[r]
        repeated.append(_runs(found[skip : skip + len(content[r]) - WINDOW + 1, r].copy()))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    repeated = [[{"first": a, "last": b} for a, b in x] for x in repeated]
    return pa.table({"anchor": rows["anchor"], "segment": rows["segment"], "repeated": pa.array(repeated, kind)})


RUNS = "array<struct<first: int, last: int>>"


def _repeats_by_window(hot: DataFrame) -> DataFrame:
    """The same for anchors with very many segments, by counting windows."""
    each = hot.select(
        "anchor", "segment", "before", "content",
        F.explode(F.sequence(F.lit(0), F.length("content") - WINDOW)).alias("w"),
    ).select(
        "anchor", "segment", "w", (F.col("w") - F.col("before")).alias("offset"),
        F.md5(F.expr(f"substring(content, w + 1, {WINDOW})")).alias("digest"),
    )
    twice = each.groupBy("anchor", "offset", "digest").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    each = each.join(twice, ["anchor", "offset", "digest"], "left_semi")
    one = F.struct(F.col("w").alias("first"), F.col("w").alias("last"))
    return each.groupBy("anchor", "segment").agg(F.collect_list(one).alias("repeated"))


def spans(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_hash, spans) for texts with repeated windows: the [begin, end) of covered stretches."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    seen = docs.select("text").mapInArrow(_anchors, "anchor long, segment long")
    seen = seen.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("segment").alias("a"), F.max("segment").alias("b")
    )
    again = written(seen.where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    repeated = spark.sparkContext.broadcast(Bits(again, "anchor", FILTER_BITS))
    mixed = spark.sparkContext.broadcast(Bits(again.where("mixed"), "anchor", FILTER_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for part, room, rows, begins in pieces(batch):
                anchor, at, lo, hi = segments(part, room)
                hit = np.flatnonzero(repeated.value.has(anchor))
                if not len(hit):
                    continue
                anchor, at, lo, hi = anchor[hit], at[hit], lo[hit], hi[hit]
                own = np.searchsorted(begins, lo, "right") - 1
                segment = _segment_hashes(part, lo, hi)
                content = []
                for i, (s, want) in enumerate(zip(segment.tolist(), mixed.value.has(anchor).tolist())):
                    # A task that has put out a segment's bytes need not do so again.
                    if want and s not in known:
                        known.add(s)
                        content.append(part[lo[i] : hi[i] + WINDOW].tobytes())
                    else:
                        content.append(None)
                if len(known) > 1_000_000:
                    known.clear()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].take(pa.array(rows[own])),
                        "text_hash": batch["text_hash"].take(pa.array(rows[own])),
                        "anchor": anchor,
                        "segment": segment,
                        "lo": pa.array(lo - begins[own], pa.int64()),
                        "hi": pa.array(hi - begins[own], pa.int64()),
                        "before": pa.array(at - lo, pa.int32()),
                        "content": pa.array(content, pa.binary()),
                    }
                )

    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("text_hash", LongType()),
        StructField("anchor", LongType()), StructField("segment", LongType()),
        StructField("lo", LongType()), StructField("hi", LongType()),
        StructField("before", IntegerType()), StructField("content", BinaryType()),
    ])
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    found = written(hashed.mapInArrow(places, schema), "segments")
    counted = found.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), F.first("content", ignorenulls=True).alias("content"), F.first("before").alias("before")
    )
    counted = written(counted, "segment-counts")
    whole = counted.where("n > 1").select("anchor", "segment")
    different = counted.where("content is not null").select("anchor", "segment", "before", "content")
    sizes = different.groupBy("anchor").agg(F.count("*").alias("size"))
    hot = written(sizes.where(F.col("size") > group_rows).select("anchor"), "hot-anchors")
    some = different.join(hot, "anchor", "left_anti").join(sizes.where("size > 1").select("anchor"), "anchor", "left_semi")
    buckets = max(1, counted.count() // BUCKET_ROWS + 1)
    some = some.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    parts = some.groupBy("bucket").applyInArrow(
        _repeats_in_bucket, f"anchor long, segment long, repeated {RUNS}"
    )
    parts = parts.union(_repeats_by_window(different.join(hot, "anchor", "left_semi")))
    parts = written(parts.where("size(repeated) > 0"), "segment-repeats")
    at = found.drop("content", "before")
    covered = at.join(whole, ["anchor", "segment"], "left_semi").select(
        "doc_id", "text_hash", F.struct(F.col("lo").alias("begin"), (F.col("hi") + WINDOW).alias("end")).alias("span")
    )
    # A segment that occurs twice is covered as a whole already.
    part = at.join(parts.join(whole, ["anchor", "segment"], "left_anti"), ["anchor", "segment"]).select(
        "doc_id", "text_hash", "lo", F.explode("repeated").alias("r")
    )
    part = part.select(
        "doc_id", "text_hash",
        F.struct((F.col("lo") + F.col("r.first")).alias("begin"), (F.col("lo") + F.col("r.last") + WINDOW).alias("end")).alias("span"),
    )
    return covered.union(part).groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("spans"))


def _cut(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal removed runs)."""
    if not len(spans):
        return text, 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    begins, ends = spans[new, 0], np.r_[reach[new[1:] - 1], reach[-1]]
    kept, at = [], 0
    for a, b in zip(begins.tolist(), ends.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), int((ends - begins).sum()), len(begins)


ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def suffix_dedup(docs: DataFrame, group_rows: int = GROUP_ROWS, readable: bool = False) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay;
    readable: as text, without characters that a cut has left incomplete)."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ADDED])
    names = docs.columns
    id_, hash_, at = fresh(docs, "id", "hash", "spans")
    found = spans(docs, group_rows).toDF(id_, hash_, at)
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left")
    both = both.select(*[F.col(f"`{c}`") for c in names], at)
    text = next(i for i, c in enumerate(names) if c.lower() == "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for x, s in zip(batch.column(text), batch.column(len(names))):
                raw = (x.as_py() or "").encode()
                s = np.array([(y["begin"], y["end"]) for y in s.as_py() or ()], np.int64).reshape(-1, 2)
                done.append((len(raw), *_cut(raw, s)))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array([x[0] for x in done], pa.int64()),
                    pa.array([x[2] for x in done], pa.int64()),
                    pa.array([x[3] for x in done], pa.int64()),
                    pa.array([x[1].decode("utf-8", "ignore") for x in done], pa.string())
                    if readable
                    else pa.array([x[1] for x in done], pa.binary()),
                ],
                names=[*names, *ADDED],
            )

    added = [StructField(c, LongType()) for c in ADDED[:3]] + [StructField("kept", StringType() if readable else BinaryType())]
    return both.mapInArrow(cut, StructType([*docs.schema.fields, *added]))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; one that is nothing else goes.

    A character that a cut has left without some of its bytes goes as well.
    """
    names = docs.columns
    out = suffix_dedup(docs, readable=True)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept"))
    return out.where("n_removed = 0 or n_removed < n_bytes").select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names]
    )

