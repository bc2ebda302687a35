"""Deduplication with a time to live, on a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.clock import instant, micros, parse_duration
from gaugeworks.functions.values import hashable
from gaugeworks.model import require
from gaugeworks.operators.dedup import (
    HEAVY_KEY_ROWS,
    dedup_against_store,
    dedup_key,
    expire_seen,
    follow,
    kept_entries,
)
from gaugeworks.session import by_value
from gaugeworks.sources.ledger import Ledger, Snapshot

#: Keys are dealt into so many buckets. A checkpoint is only good for the number that it began with.
BUCKETS = 512

#: Rows of a bucket, of different keys and times, that a worker holds before it lays them down by slice.
HELD_ROWS = 50_000

#: Rows that are not compared with any other are dealt into so many groups.
LANES = 256

#: Runs whose entries lie apart in the store before they are put together.
STORE_FANOUT = 8


_NEVER = np.iinfo(np.int64).min


class Due:
    """From when on a row of a key is new again: the keys' places, and the times by place."""

    def __init__(self, keys: Iterable[tuple], times: np.ndarray) -> None:
        self.places = {k: i for i, k in enumerate(keys)}
        self.times = times

    def place(self, frame: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
        """The frame with the places of its keys; new ones are given theirs."""
        places = self.places
        found = [places.setdefault(k, len(places)) for k in zip(*[frame[k] for k in keys])]
        self.times = np.append(self.times, np.full(len(places) - len(self.times), _NEVER, np.int64))
        return frame.assign(place=np.array(found, np.int64))

    def first(self) -> int | None:
        return int(self.times.min()) if len(self.times) else None


class KeepFirst(StatefulProcessor):
    """The kept rows of a bucket of keys. State: each key's last kept time, with a timer for when the
    first of them is of no more use.

    A call with its frames and its state costs about the same for one key as for a thousand, so the
    keys of a bucket are followed together. Frames come in any order of time. Of each only the first
    row of a key and time can matter, and none within the TTL of the key's last kept row. Where a
    bucket has more such rows in a trigger than are held, they are laid down in the state by slices
    of one TTL, which are then followed in order of time, one slice in memory at once.
    """

    def __init__(self, ttl: int, id: str, keys: Sequence[str], columns: Mapping[str, str], held_rows: int) -> None:
        """keys, and columns to those of the rows: names in the frames, which hold no others than identifiers."""
        self.ttl, self.id, self.keys, self.columns, self.held_rows = ttl, id, list(keys), dict(columns), held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        texts = [f"{k} array<string>" for k in self.keys]
        self.last = handle.getValueState("last_kept", ", ".join([*texts, "us array<bigint>"]))
        self.slices = handle.getMapState("slices", "slice bigint, part bigint", "rows binary")

    def _named(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame[list(self.columns)].rename(columns=self.columns)

    def _read(self) -> Due:
        if not self.last.exists():
            return Due([], np.zeros(0, np.int64))
        *keys, us = self.last.get()
        return Due(zip(*keys), np.array(us, np.int64) + self.ttl)

    def _write(self, due: Due) -> None:
        if due.places:
            self.last.update((*[list(k) for k in zip(*due.places)], (due.times - self.ttl).tolist()))
        else:
            self.last.clear()

    def _wait(self, first: int, watermark: int) -> None:
        """Once the watermark is past this time any row of the key is new, state or not."""
        self.handle.registerTimer(max(-(-first // 1000), watermark + 1))

    def _firsts(self, frames: list[pd.DataFrame], due: Due) -> pd.DataFrame:
        """The first row of each key and time that can still be kept, in order of both."""
        rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        rows = rows[rows["us"].to_numpy() >= due.times[rows["place"].to_numpy()]]
        times, place = rows["us"].to_numpy().astype(np.int64), rows["place"].to_numpy()
        # As the batch operator orders them: a null id first, equal ids by the row's hash.
        ids = pd.factorize(rows[self.id], sort=True)[0]
        order = np.lexsort((rows["tie"].to_numpy(), ids, times, place))
        times, place = times[order], place[order]
        first = np.ones(len(order), bool)
        first[1:] = (times[1:] != times[:-1]) | (place[1:] != place[:-1])
        return rows.take(order[first])

    def _lay_down(self, rows: pd.DataFrame, part: int) -> None:
        for slice_, piece in rows.groupby(rows["us"] // self.ttl, sort=False):
            self.slices.updateValue((int(slice_), part), (pickle.dumps(piece),))

    def _in_order(self, frames: Iterator[pd.DataFrame], due: Due) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, parts = 0, 0
        for frame in frames:
            held.append(self._firsts([due.place(frame, self.keys)], due))
            size += len(held[-1])
            if size > self.held_rows:
                held = [self._firsts(held, due)]
                size = len(held[0])
                if size > self.held_rows:
                    self._lay_down(held[0], parts)
                    held, size, parts = [], 0, parts + 1
        if not parts:
            if held:
                yield self._firsts(held, due)
            return
        if held:
            self._lay_down(self._firsts(held, due), parts)
        laid = sorted(tuple(k) for k in self.slices.keys())
        for _, slice_ in groupby(laid, key=lambda k: k[0]):
            pieces = []
            for k in slice_:
                pieces.append(pickle.loads(self.slices.getValue(k)[0]))
                self.slices.removeKey(k)
            yield self._firsts(pieces, due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            yield from (self._named(frame) for frame in rows)
            return
        due = self._read()
        before, changed = due.first(), False
        for frame in self._in_order(rows, due):
            if not len(frame):
                continue
            times, place = frame["us"].to_numpy().astype(np.int64), frame["place"].to_numpy()
            # What was kept before is a TTL away from all of them, so each key's first row is kept.
            head = np.r_[True, place[1:] != place[:-1]]
            marks, _ = follow(times, times + self.ttl, head, None)
            last = np.flatnonzero(marks)
            last = last[np.r_[place[last[1:]] != place[last[:-1]], True]]
            due.times[place[last]] = times[last] + self.ttl
            changed = True
            yield self._named(frame[marks])
        if changed:
            self._write(due)
            # The timer of the state as it was is there already.
            if before is None or due.first() < before:
                self._wait(due.first(), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due = self._read()
        live = -(-due.times // 1000) > watermark
        if not live.all():
            due = Due([k for k, there in zip(due.places, live) if there], due.times[live])
            self._write(due)
        if due.places:
            # Keys that were kept again since, or later.
            self._wait(due.first(), watermark)
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        due = self._read()
        before = due.first()
        place = due.place(initialState, self.keys)["place"].to_numpy()
        np.maximum.at(due.times, place, initialState["last_us"].to_numpy().astype(np.int64) + self.ttl)
        self._write(due)
        if before is None or due.first() < before:
            self._wait(due.first(), timerValues.getCurrentWatermarkInMs())


def dedup_ttl_stream(
    points: DataFrame,
    keys: Sequence[str],
    ttl: str | int,
    ts: str = "ts",
    id: str = "id",
    delay: str = "1 hour",
    seen: DataFrame | None = None,
    held_rows: int = HELD_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The kept rows of a stream, exactly as the batch operator keeps them.

    State is one time per key, survives restarts through the checkpoint and goes when the watermark
    has passed it by `ttl`. Keys are dealt into `buckets` groups, which are the most tasks that can work
    at once and whose state a trigger that has rows for them writes anew; the number stays for as long
    as the checkpoint. Input may be out of order inside a micro-batch; across micro-batches a row
    older than the key's last kept time plus `ttl` is a duplicate, and a keyed row behind the watermark
    (`delay` behind the newest row of the batches before) is dropped as late. Bound the work of one
    trigger with maxFilesPerTrigger at the source.

    `seen(dedup_key, last_kept)`, a store of the batch operators, is what the stream's first run
    starts from. `stream_store` gives such a store back.
    """
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    require(ttl > 0, "the deduplication TTL must be positive")
    marked = points.withWatermark(ts, delay)
    keyed = dedup_key(marked, keys)
    # Unkeyed and undated rows are dealt out by what they hold.
    alone = ~F.col("has_all_keys") | F.col(ts).isNull()
    tie = F.xxhash64(*hashable(keyed))
    # Keys as text: a null among numbers would reach Python as a NaN, which equals nothing.
    names = keyed.schema["dedup_key"].dataType.names
    flat = [f"k{i}" for i in range(len(names))]
    texts = [F.col("dedup_key")[n].cast("string").alias(k) for k, n in zip(flat, names)]
    bucket = F.pmod(F.xxhash64(*texts), F.lit(buckets))
    lane = F.when(alone, -1 - F.pmod(tie, F.lit(LANES))).otherwise(bucket)
    columns = {f"c{i}": c for i, c in enumerate(points.columns)}
    rows = keyed.select(
        lane.alias("bucket"),
        *texts,
        micros(ts).alias("us"),
        tie.alias("tie"),
        *[F.col(f"`{c}`").alias(k) for k, c in columns.items()],
    )
    initial = None
    if seen is not None:
        store = seen.select(bucket.alias("bucket"), *texts, micros("last_kept").alias("last_us"))
        initial = store.groupBy("bucket")
    of = {c: k for k, c in columns.items()}
    with by_value():
        return rows.groupBy("bucket").transformWithStateInPandas(
            KeepFirst(ttl, of[id], flat, columns, held_rows),
            outputStructType=points.schema,
            outputMode="append",
            timeMode="EventTime",
            initialState=initial,
        )


def stream_store(points: DataFrame, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """The store (dedup_key, last_kept) that `dedup_ttl_stream` of rows like `points` has in its checkpoint.

    Read while the stream isn't running; `expire_seen` tells the live entries from the expired, and the
    batch operators go on from it.
    """
    spark = points.sparkSession
    state = spark.read.format("statestore").option("stateVarName", "last_kept").load(checkpoint)
    kind = dedup_key(points, keys).schema["dedup_key"].dataType
    lists = [F.col(f"value.k{i}") for i in range(len(kind.fields))]
    entries = state.select(F.explode(F.arrays_zip(*lists, F.col("value.us"))).alias("e"))
    own = [F.col("e")[f"k{i}"].cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)]
    return entries.select(F.struct(*own).alias("dedup_key"), instant(F.col("e")["us"]).alias("last_kept"))


def store_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    kind = dedup_key(rows, keys).schema["dedup_key"].dataType.simpleString()
    return f"dedup_key {kind}, last_kept timestamp"


def read_store(ledger: Ledger, schema: str, snapshot: Snapshot) -> DataFrame:
    """The last kept time of each key, over the runs whose entries lie apart."""
    return ledger.read("seen", schema, snapshot).groupBy("dedup_key").agg(F.max("last_kept").alias("last_kept"))


def _level(slot: str) -> int:
    return int(slot.split("-")[0])


def put_store(
    ledger: Ledger, schema: str, snapshot: Snapshot, run: int, latest: DataFrame, horizon: int | None, ttl: int
) -> tuple[dict[str, str], list[str]]:
    """(slots to put, slots to drop) so that the store holds `latest`, the entries that a run changes.

    A run writes its own entries. Where STORE_FANOUT slots of a level have come together they are
    written as one of the next level, without what has expired by `horizon` (microseconds): an
    entry is written as often as there are levels, and what a run writes follows its rows.
    """
    slots = dict(snapshot.of("seen"))
    merged, level, parts = latest, 0, []
    while True:
        same = [s for s in slots if _level(s) == level]
        if len(same) + 1 < STORE_FANOUT:
            break
        parts += same
        level += 1
    if parts:
        older = ledger.read("seen", schema, snapshot, parts)
        merged = older.unionByName(latest).groupBy("dedup_key").agg(F.max("last_kept").alias("last_kept"))
        if horizon is not None:
            merged = expire_seen(merged, instant(F.lit(horizon)), ttl)
    return {f"{level}-{run}": ledger.write(merged, "seen")}, parts


def dedup_stream_with_store(
    points: DataFrame,
    keys: Sequence[str],
    ttl: str | int,
    path: str,
    checkpoint: str,
    ts: str = "ts",
    id: str = "id",
    delay: str | int = "1h",
    heavy_rows: int | None = HEAVY_KEY_ROWS,
) -> DataFrame:
    """The same on large micro-batches: each is deduplicated by the batch operator
    against a stored table of keys, so heavy keys are spread over tasks here as well.

    Kept rows and store are tables of a ledger at `path`, and each micro-batch is one version of
    it: stopped anywhere, a run holds whole or not at all, and isn't done twice. What a run writes
    follows its rows (`put_store`); two versions are kept. Rows more than `delay` behind the newest
    kept row of the runs before are late and dropped, which is what lets entries expire. Processes
    everything available and returns what is kept so far.
    """
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    delay = parse_duration(delay) if isinstance(delay, str) else delay
    ledger = Ledger(points.sparkSession, path)
    schema = store_schema(points, keys)

    def step(rows: DataFrame, run: int) -> None:
        if ledger.done(run):
            return
        base = ledger.snapshot()
        newest = base.notes.get("newest")
        if newest is not None:
            rows = rows.filter(F.col(ts).isNull() | (micros(ts) >= newest - delay))
        kept, _ = dedup_against_store(
            rows, read_store(ledger, schema, base), keys, ttl, ts, id, heavy_rows
        )
        folder = ledger.write(kept, "kept")
        kept = ledger.spark.read.schema(points.schema).parquet(f"{ledger.path}/{folder}")
        latest = kept_entries(kept, keys, ts)
        now = latest.agg(F.max(micros("last_kept"))).first()[0]
        horizon = None if newest is None else newest - delay
        put, drop = put_store(ledger, schema, base, run, latest, horizon, ttl)
        newest = max((t for t in (now, newest) if t is not None), default=None)
        ledger.commit(
            base,
            {"kept": {f"run={run}": folder}, "seen": put},
            {"seen": drop},
            lambda notes: {**notes, "stream": run, "newest": newest},
        )
        ledger.vacuum()

    query = (
        points.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return ledger.read("kept", points.schema)
