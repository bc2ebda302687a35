"""The last snapshot at or before each point, with both on streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.clock import micros, parse_duration
from gaugeworks.functions.values import hashable
from gaugeworks.model import require
from gaugeworks.session import by_value

#: Keys are dealt into so many buckets, which with the lanes of each are the groups. A checkpoint is
#: only good for the numbers that it began with.
BUCKETS = 64

#: Points of a key are dealt into so many groups, each with the key's snapshots.
LANES = 8

#: Points come out by minutes of their time.
SLICE_MICROS = 60_000_000

#: Points that wait are kept, and looked up, so many at once.
CHUNK_ROWS = 20_000

_EXACT_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class AsOf(StatefulProcessor):
    """The points and snapshots of a bucket of keys. Points wait until the watermark has passed their slice
    of time: by then every snapshot that is not late has come, in whatever order. Of a key's snapshots
    behind the watermark, and all points that wait, only the last is kept.

    A call with its frames and its state costs about the same for one key or slice as for thousands, so
    the snapshots of a bucket are one table, its points chunks in order of time, and one timer runs
    for the first of them. A chunk is in memory at once, with the bucket's snapshots.
    """

    def __init__(self, ttl: int, columns: Mapping[str, str], into: str) -> None:
        self.ttl, self.columns, self.into = ttl, dict(columns), into

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "rows binary")
        self.waiting = handle.getMapState("waiting", "slice bigint, part bigint", "rows binary")

    def _out(self, frame: pd.DataFrame, facts: Sequence) -> pd.DataFrame:
        return frame[list(self.columns)].rename(columns=self.columns).assign(**{self.into: facts})

    def _waiting(self) -> list[tuple[int, int]]:
        """The chunks that wait: the slice of each one's first point, and its number."""
        return sorted(tuple(k) for k in self.waiting.keys())

    def _lay_down(self, frames: list[pd.DataFrame], chunks: list[tuple[int, int]]) -> None:
        rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        rows = rows.sort_values("us", kind="stable")
        at = (int(rows["us"].iloc[0]) // SLICE_MICROS, max((part for _, part in chunks), default=-1) + 1)
        self.waiting.updateValue(at, (pickle.dumps(rows),))
        chunks.append(at)

    def _known(self) -> pd.DataFrame | None:
        return pickle.loads(self.facts.get()[0]) if self.facts.exists() else None

    def _keep(self, facts: pd.DataFrame, chunks: list[tuple[int, int]], watermark: int) -> None:
        """What points that wait or are still to come may look up."""
        first = min([watermark * 1000, *[slice_ * SLICE_MICROS for slice_, _ in chunks]])
        us, key = facts["us"].to_numpy(), pd.factorize(facts["k"])[0]
        later = us > first
        next_ = np.append((key[1:] == key[:-1]) & ~later[1:], False) if len(us) else later
        self.facts.update((pickle.dumps(facts[later | (~next_ & (us + self.ttl >= first))]),))

    def _wait(self, slice_: int, watermark: int) -> None:
        end = -(-(slice_ + 1) * SLICE_MICROS // 1000)
        self.handle.registerTimer(max(end, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            yield from (self._out(frame, [None] * len(frame)) for frame in rows)
            return
        before = self._waiting()
        chunks, told, held, size = list(before), [], [], 0
        for frame in rows:
            frame = frame.astype({"us": np.int64})
            fact = frame["fact"].notna().to_numpy()
            if fact.any():
                told.append(frame.loc[fact, ["k", "us", "fact"]])
            if not fact.all():
                held.append(frame.loc[~fact, ["k", "us", *self.columns]])
                size += len(held[-1])
            if size >= CHUNK_ROWS:
                self._lay_down(held, chunks)
                held, size = [], 0
        if held:
            self._lay_down(held, chunks)
        watermark = timerValues.getCurrentWatermarkInMs()
        if told:
            known = self._known()
            facts = pd.concat(told if known is None else [known, *told], ignore_index=True)
            # Of snapshots at one time the greater text, whichever comes first.
            facts = facts.sort_values(["k", "us", "fact"]).drop_duplicates(["k", "us"], keep="last")
            self._keep(facts, chunks, watermark)
        # The timer of what waited before is there already.
        if chunks and (not before or min(chunks)[0] < before[0][0]):
            self._wait(min(chunks)[0], watermark)

    def _look_up(self, points: pd.DataFrame, facts: pd.DataFrame | None) -> np.ndarray:
        """The text of the last fact of each point's key at or before it, null where it is too old."""
        if facts is None or not len(facts):
            return np.full(len(points), None, object)
        keys, names = pd.factorize(facts["k"])
        places = {k: i for i, k in enumerate(names)}
        own = np.array([places.get(k, -1) for k in points["k"]], np.int64)
        known, us = facts["us"].to_numpy(), points["us"].to_numpy()
        n = len(known)
        # In order of key and time, facts before points of the same time.
        order = np.lexsort((np.arange(n + len(us)) >= n, np.r_[known, us], np.r_[keys, own]))
        last = np.empty(len(order), np.int64)
        last[order] = np.maximum.accumulate(np.where(order < n, order, -1))
        last = last[n:]
        hit = (last >= 0) & (keys[last] == own) & (us - known[last] <= self.ttl)
        return np.where(hit, facts["fact"].to_numpy(object)[last], None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        # Slices that begin at or after this one have not been passed.
        until = watermark * 1000 // SLICE_MICROS
        chunks = self._waiting()
        passed = [c for c in chunks if c[0] < until]
        if passed:
            chunks = [c for c in chunks if c[0] >= until]
            facts, held, size = self._known(), [], 0
            for at in passed:
                points = pickle.loads(self.waiting.getValue(at)[0])
                self.waiting.removeKey(at)
                cut = int(np.searchsorted(points["us"].to_numpy(), until * SLICE_MICROS))
                out, points = points[:cut], points[cut:]
                yield self._out(out, self._look_up(out, facts))
                if len(points):
                    held.append(points)
                    size += len(points)
                if size >= CHUNK_ROWS:
                    self._lay_down(held, chunks)
                    held, size = [], 0
            if held:
                self._lay_down(held, chunks)
            if facts is not None:
                self._keep(facts, chunks, watermark)
        if chunks:
            self._wait(min(chunks)[0], watermark)


def as_of_stream(
    points: DataFrame,
    snapshots: DataFrame,
    key: str,
    snapshot_key: str,
    values: Sequence[str],
    ttl: str | int,
    ts: str = "ts",
    at: str = "collected_at",
    delay: str = "1 hour",
    into: str = "snapshot",
    lanes: int = LANES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """`as_of` over a stream of points and a stream of snapshots, in append mode.

    Both may be out of order by up to `delay`; what is behind the watermark is late and dropped. A point
    comes out once the watermark is past it, and the end of the input leaves those after it in the
    state. Points without a key or a time are misses and come out at once. Keys are dealt into `buckets`,
    and the points of each into `lanes` groups by a hash of the row; its snapshots go to each. Both
    numbers stay for as long as the checkpoint.
    """
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    require(ttl >= 0, "the snapshot TTL must not be negative")
    columns = {f"c{i}": c for i, c in enumerate(points.columns)}
    fact = F.struct(F.col(at), *[F.col(v) for v in values if v != at])
    kind = snapshots.select(fact.alias("f")).schema["f"].dataType.simpleString()
    alone = F.col(key).isNull() | F.col(ts).isNull()
    deal = F.xxhash64(*hashable(points))
    bucket = lambda text: F.pmod(F.xxhash64(text), F.lit(buckets))
    text, told = F.col(key).cast("string"), F.col(snapshot_key).cast("string")
    left = points.select(
        F.when(alone, -1 - F.pmod(F.shiftright(deal, 8), F.lit(buckets))).otherwise(bucket(text)).alias("bucket"),
        F.pmod(deal, F.lit(lanes)).alias("lane"),
        F.when(~alone, text).alias("k"),
        F.col(ts).cast("timestamp").alias("t"),
        F.lit(None).cast("string").alias("fact"),
        *[F.col(f"`{c}`").alias(n) for n, c in columns.items()],
    )
    right = snapshots.filter(F.col(snapshot_key).isNotNull() & F.col(at).isNotNull()).select(
        bucket(told).alias("bucket"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))).alias("lane"),
        told.alias("k"),
        F.col(at).cast("timestamp").alias("t"),
        F.to_json(fact, _EXACT_TIME).alias("fact"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(n) for n, c in columns.items()],
    )
    both = left.unionByName(right).withWatermark("t", delay).withColumn("us", micros("t"))
    with by_value():
        out = both.groupBy("bucket", "lane").transformWithStateInPandas(
            AsOf(ttl, columns, into),
            outputStructType=", ".join(
                [*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), f"`{into}` string"]
            ),
            outputMode="append",
            timeMode="EventTime",
        )
    return out.withColumn(into, F.from_json(into, kind, _EXACT_TIME))


def enrich_host_stream(
    points: DataFrame,
    hosts: DataFrame,
    ttl: str | int,
    host: str = "hostname",
    values: Sequence[str] = ("os", "architecture", "cpu_count", "total_memory"),
    ts: str = "ts",
    delay: str = "1 hour",
) -> DataFrame:
    """`enrich_host` by host name on streams: adds `host_info` and `host_hit`."""
    out = as_of_stream(points, hosts, host, "hostname", values, ttl, ts, delay=delay, into="host_info")
    return out.withColumn("host_hit", F.col("host_info").isNotNull())
