"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

A document is its token ids and a closing id 0. Documents longer than CAPACITY are cut into
pieces of CAPACITY ids; the first piece takes what is over and may be shorter.

Which pieces share a sequence depends on lengths alone, and there are at most CAPACITY of
them. So the counts of pieces by length, whatever their number, are all that is packed in one
place; it yields patterns (how many pieces of which lengths) with how often each is used.
Pieces find their place by their rank among those of their length.

Reduction. For the longest pieces first, a set of at most three that holds the piece is fixed
for good if it dominates every other feasible set with it (each other set's members can be
exchanged for members at least as long):
* the piece alone, if nothing fits beside it;
* with the longest that fits, if that fills the sequence, or if no two fit, or if no two that
  fit are longer together;
* with the longest that fits and the longest that then fits, if no three fit beside it and no
  two pieces longer than the second fit together.
This goes on until nothing more can be fixed; best fit, longest first, packs the remainder.

Defined cases. A null text is an empty one: the closing id alone. Repeated rows and ties of
length are pieces like any other, ranked by where they were read. Further columns are ignored.
The strings of the vocabulary's added tokens become those tokens in the query and in the pipeline's
stage, as the file's own library does by default; pack and cut take them as ordinary text unless told
`added`. A run of LONG_RUN or more white
space characters is encoded apart, as the one or two pieces that the pattern makes of it: the library's
matcher gives up on runs of about a million.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import table
from gaugeworks.session import written

CAPACITY = 2048
#: The ranks of byte_bpe_50k.json; this library encodes with them about three times as fast.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space as the pattern has it, and the length from which a run is encoded apart.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 100_000
LONG_RUNS = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")

Pattern = tuple[int, dict[int, int]]


@lru_cache(maxsize=2)
def added_tokens(vocabulary: str) -> dict[str, int]:
    """The tokens that the vocabulary's json file adds to the ranks."""
    with open(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json"))) as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, added: bool = False) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(
        vocabulary,
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens=added_tokens(vocabulary) if added else {},
    )


def ids_of(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text of any length."""
    if len(text) < LONG_RUN:
        return encoding.encode_to_numpy(text, allowed_special="all")
    special = sorted(encoding.special_tokens_set)
    # A token's string ends the text before it; split at in any case, so that a run sees its end.
    parts = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
    out = []
    for part in parts:
        at = 0
        for run in LONG_RUNS.finditer(part):
            out.append(encoding.encode_to_numpy(part[at : run.start()], allowed_special="all"))
            # All of a run at the end is one piece; elsewhere its last character goes with what follows.
            at = run.end() if run.end() == len(part) else run.end() - 1
            out.append(np.array(encoding._encode_single_piece(part[run.start() : at]), np.uint32))
        out.append(encoding.encode_to_numpy(part[at:], allowed_special="all"))
    return np.concatenate(out)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the counts that are left."""
    left = {w: n for w, n in counts.items() if n}
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                beside = _dominating(j, left, capacity)
                if beside is None:
                    break
                need: dict[int, int] = {}
                for w in (j, *beside):
                    need[w] = need.get(w, 0) + 1
                times = min(left[w] // k for w, k in need.items())
                for w, k in need.items():
                    left[w] -= times * k
                    if not left[w]:
                        del left[w]
                fixed.append((times, need))
                again = True
    return fixed, left


def _dominating(j: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """What goes with j in a set that dominates all others, or None."""
    room = capacity - j
    others = dict(left)
    others[j] -= 1
    lengths = sorted(w for w, n in others.items() if n)
    at = bisect_right(lengths, room)
    if not at:
        return ()
    longest = lengths[at - 1]
    if longest == room:
        return (longest,)

    def smallest(above: int, k: int) -> list[int]:
        found: list[int] = []
        for w in lengths[bisect_right(lengths, above) :]:
            found += [w] * min(others[w], k - len(found))
            if len(found) == k:
                break
        return found

    three = smallest(0, 3)
    if len(three) < 2 or sum(three[:2]) > room:
        return (longest,)
    if len(three) == 3 and sum(three) <= room:
        return None
    if _largest_pair(lengths[:at], others, room) <= longest:
        return (longest,)
    others[longest] -= 1
    second = next((w for w in reversed(lengths[: bisect_right(lengths, room - longest)]) if others[w]), None)
    others[longest] += 1
    if second is not None:
        two = smallest(second, 2)
        if len(two) < 2 or sum(two) > room:
            return (longest, second)
    return None


def _largest_pair(lengths: list[int], counts: dict[int, int], room: int) -> int:
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or (i == j and counts[lengths[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, of counts by length: equal sequences are handled as one."""
    rooms: list[int] = []
    by_room: dict[int, list[Pattern]] = {}

    def put(times: int, pattern: dict[int, int], room: int) -> None:
        if times:
            if not by_room.get(room):
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append((times, pattern))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put(n // each, {w: each}, capacity - each * w)
                put(int(n % each > 0), {w: n % each}, capacity - n % each * w)
                break
            room = rooms[at]
            times, pattern = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
                del by_room[room]
            # What one takes leaves it the tightest for the next, as long as it fits.
            each = room // w
            full = min(times, n // each)
            n -= full * each
            put(full, pattern | {w: each}, room - each * w)
            times -= full
            if times and n:
                put(1, pattern | {w: n}, room - n * w)
                times, n = times - 1, 0
            put(times, pattern, room)
    return [p for room in rooms for p in by_room[room]]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Sequence and offset of a piece by its length and its rank among the pieces of that length."""

    def __init__(self, found: list[Pattern]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for times, pattern in found:
            offset = 0
            for w, each in pattern.items():
                rows.setdefault(w, []).append((taken.get(w, 0), sequence, each, offset))
                taken[w] = taken.get(w, 0) + times * each
                offset += w * each
            sequence += times
        self.rows = {w: np.array(x, np.int64) for w, x in rows.items()}

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            w = int(length[part[0]])
            first, begin, each, inner = self.rows[w].T
            use = np.searchsorted(first, rank[part], "right") - 1
            k = rank[part] - first[use]
            sequence[part] = begin[use] + k // each[use]
            offset[part] = inner[use] + k % each[use] * w
        return sequence, offset


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, added: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32; and the task and rank in it by length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary, added)
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, source = [], []
            for i, text in enumerate(batch["text"]):
                ids = np.append(ids_of(encoding, text.as_py() or "").astype("<u4"), np.uint32(0))
                over = len(ids) % capacity
                edges = [*([0] if over else []), *range(over, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ranks[b - a]))
                    source.append(i)
                    ranks[b - a] += 1
            k, start, length, crc, rank = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].take(pa.array(source, pa.int64())),
                    "piece": pa.array(k, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "task": pa.array([task] * len(rows), pa.int32()),
                    "rank": pa.array(rank, pa.int64()),
                }
            )

    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        pieces,
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long",
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, added: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) with the sequence_id and offset they are placed at."""
    pieces = written(cut(docs, capacity, vocabulary, added), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    # One row per length, whatever the corpus.
    counts = {row.length: row.n for row in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(patterns(counts, capacity)))
    ranked = pieces.join(base.drop("n"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.at(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        placed,
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of the documents that are left."""
    return pack(docs, added=True)
