"""Windowed aggregation on a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.clock import instant, micros
from gaugeworks.functions.values import label_entries
from gaugeworks.model import CUSTOM_AGGREGATIONS, AggRule, require
from gaugeworks.operators.aggregate import aggregate, apply_rules, bounds_of, emit
from gaugeworks.operators.windows import add_points, stored_windows
from gaugeworks.session import by_value
from gaugeworks.sources.ledger import Ledger

#: Groups of anchored windows are dealt into so many buckets. A checkpoint is only good for the number
#: that it began with.
BUCKETS = 512

#: Points of a bucket whose anchors aren't known that a worker holds before it lays them down.
HELD_ROWS = 200_000


def aggregate_stream(
    points: DataFrame,
    rules: Sequence[AggRule],
    window_seconds: int = 60,
    delay: str = "1 hour",
    exact: bool = False,
) -> DataFrame:
    """The batch aggregation under a watermark; in append mode a window comes out once,
    when the watermark has passed its end. Windows still open when input ends stay in
    the state; `revised_windows` shows them at any time.
    """
    return aggregate(
        points.withWatermark("ts", delay), rules, window_seconds, exact=exact
    )


def revised_windows(
    points: DataFrame,
    rules: Sequence[AggRule],
    path: str,
    checkpoint: str,
    window_seconds: int = 60,
    delay: str = "1 hour",
    exact: bool = False,
) -> DataFrame:
    """The same in update mode: every window as it stands, open ones included.

    A micro-batch puts out the windows it has changed, and they take the place of what the ledger at
    `path` holds for the same rule, group and window; days without a change are not touched. So at
    the end of the input nothing is left to flush: the table equals the batch result, but for rows that
    came more than `delay` late. Processes everything available and returns the table.
    """
    stream = aggregate(points.withWatermark("ts", delay), rules, window_seconds, exact=exact)
    ledger = Ledger(points.sparkSession, path)
    table = "revised"
    row = F.xxhash64("rule_id", "window_start", "name", label_entries(F.col("labels")))

    def step(rows: DataFrame, run: int) -> None:
        if ledger.done(run):
            # The micro-batch is still to be run: it is what writes the stream's own state.
            rows.write.format("noop").mode("overwrite").save()
            return
        base = ledger.snapshot()
        day = F.to_date("window_start").cast("string")
        rows = rows.withColumns({"row": row, "day": day}).persist()
        try:
            days = sorted(r.day for r in rows.select("day").distinct().collect())
            put = {}
            if days:
                schema = rows.drop("day").schema
                before = ledger.read(table, schema, base, days).withColumn("day", day)
                # A histogram's buckets are rows of their own; all are revised together.
                kept = before.join(rows.select("row", "day"), ["row", "day"], "left_anti")
                folder = ledger.write(kept.unionByName(rows), table, ["day"])
                put = {d: f"{folder}/day={d}" for d in days}
            ledger.commit_run(run, base, {table: put})
        finally:
            rows.unpersist()
        ledger.vacuum()

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return ledger.read(table, stream.schema)


def stored_windows_stream(
    points: DataFrame,
    rules: Sequence[AggRule],
    path: str,
    checkpoint: str,
    window_seconds: int = 60,
    exact: bool = False,
) -> DataFrame:
    """Every micro-batch merged into the stored windows of the ledger at `path`: no row is ever late.

    Processes everything available and returns the windows. Replayed points are added to the same
    ledger by `add_points`, under a name of their own.
    """
    ledger = Ledger(points.sparkSession, path)

    def step(rows: DataFrame, run: int) -> None:
        add_points(ledger, run, rows, rules, window_seconds)
        ledger.vacuum()

    query = (
        points.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored_windows(ledger, rules, window_seconds, exact)


_NEVER = np.iinfo(np.int64).max

#: How the columns of windows are joined; of `least` and `most` a NaN is none.
_JOINED = {"n": np.add, "total": np.add, "least": np.fmin, "most": np.fmax, "under": np.add}


def _combined(windows: Sequence[Mapping[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One window of each place and number, in this order."""
    columns = {c: np.concatenate([w[c] for w in windows]) for c in ("place", "number", *_JOINED)}
    order = np.lexsort((columns["number"], columns["place"]))
    place, number = columns["place"][order], columns["number"][order]
    begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (number[1:] != number[:-1])])
    joined = {c: how.reduceat(columns[c][order], begin, axis=0) for c, how in _JOINED.items()}
    return {"place": place[begin], "number": number[begin], **joined}


class AnchoredWindows(StatefulProcessor):
    """The windows of a bucket of groups, the first of each of which begins at the group's first point.

    State: the groups' anchors, which stay, and the open windows by group and number. A timer at the first
    one's end puts out what has ended; windows without a point leave nothing, and the next ones keep to
    the same grid. A call with its frames and its state costs about the same for one group as for a
    thousand, so the groups of a bucket are worked on together.
    """

    def __init__(self, step: int, bounds: Sequence[Sequence[float]]) -> None:
        self.step, width = step, max(map(len, bounds))
        # By rule; nothing is at most a NaN.
        self.bounds = np.array([[*b, *[np.nan] * (width - len(b))] for b in bounds], float).reshape(len(bounds), width)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchors = handle.getValueState("anchors", "rule_id array<int>, group_json array<string>, us array<bigint>")
        self.open = handle.getValueState("open", "windows binary")
        self.held = handle.getMapState("held", "part bigint", "rows binary")

    def _read(self) -> tuple[dict[tuple, int], np.ndarray, dict[str, np.ndarray] | None]:
        """The place of each group, the anchors by place, and the open windows."""
        rules, groups, us = self.anchors.get() if self.anchors.exists() else ([], [], [])
        windows = pickle.loads(self.open.get()[0]) if self.open.exists() else None
        return {k: i for i, k in enumerate(zip(rules, groups))}, np.array(us, np.int64), windows

    def _ends(self, windows: Mapping[str, np.ndarray], anchors: np.ndarray) -> np.ndarray:
        return anchors[windows["place"]] + (windows["number"] + 1) * self.step

    def _wait(self, end: int, watermark: int) -> None:
        self.handle.registerTimer(max(-(-end // 1000), watermark + 1))

    def _windows(self, place: np.ndarray, us: np.ndarray, value: np.ndarray, anchors: np.ndarray, rules: np.ndarray):
        # A point before its group's first one counts into the first window.
        number = np.maximum((us - anchors[place]) // self.step, 0)
        under = (value[:, None] <= self.bounds[rules[place]]).astype(np.int64)
        n = np.ones(len(place), np.int64)
        return _combined([{"place": place, "number": number, "n": n, "total": value, "least": value, "most": value, "under": under}])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        places, anchors, before = self._read()
        known, first = len(anchors), None if before is None else int(self._ends(before, anchors).min())
        windows = [] if before is None else [before]
        held: list[tuple[np.ndarray, ...]] = []
        size, parts = 0, 0
        rules = np.array([rule for rule, _ in places], np.int64)
        for frame in rows:
            place = np.array([places.setdefault(k, len(places)) for k in zip(frame["rule_id"], frame["group_json"])], np.int64)
            us, value = frame["us"].to_numpy().astype(np.int64), frame["value"].to_numpy().astype(float)
            new = place >= known
            if not new.all():
                windows.append(self._windows(place[~new], us[~new], value[~new], anchors, rules))
            if new.any():
                # Points of a group without an anchor are held until the least time is known.
                anchors = np.append(anchors, np.full(len(places) - len(anchors), _NEVER, np.int64))
                np.minimum.at(anchors, place[new], us[new])
                held.append((place[new], us[new], value[new]))
                size += len(held[-1][0])
            if size > HELD_ROWS:
                self.held.updateValue((parts,), (pickle.dumps(held),))
                held, size, parts = [], 0, parts + 1
            if len(windows) > 16:
                windows = [_combined(windows)]
        rules = np.array([rule for rule, _ in places], np.int64)
        for part in range(parts + 1):
            if part < parts:
                points = pickle.loads(self.held.getValue((part,))[0])
                self.held.removeKey((part,))
            else:
                points = held
            if points:
                windows.append(self._windows(*map(np.concatenate, zip(*points)), anchors, rules))
                windows = [_combined(windows)]
        windows = _combined(windows)
        if len(places) > known:
            self.anchors.update((*[list(k) for k in zip(*places)], anchors.tolist()))
        self.open.update((pickle.dumps(windows),))
        end = int(self._ends(windows, anchors).min())
        # The timer of the windows as they were is there already.
        if first is None or end < first:
            self._wait(end, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        places, anchors, windows = self._read()
        if windows is None:
            return
        ends = self._ends(windows, anchors)
        closed = ends <= watermark * 1000
        if closed.any():
            out = {c: v[closed] for c, v in windows.items()}
            groups = list(places)
            yield pd.DataFrame({
                "rule_id": [groups[i][0] for i in out["place"]],
                "group_json": [groups[i][1] for i in out["place"]],
                "_anchor": anchors[out["place"]],
                "window_index": out["number"],
                "_n": out["n"],
                "_sum": out["total"],
                "_min": out["least"],
                "_max": out["most"],
                "under": out["under"].tolist(),
            })
            if closed.all():
                self.open.clear()
            else:
                self.open.update((pickle.dumps({c: v[~closed] for c, v in windows.items()}),))
        if not closed.all():
            self._wait(int(ends[~closed].min()), watermark)


def aggregate_anchored_stream(
    points: DataFrame,
    rules: Sequence[AggRule],
    window_seconds: int = 60,
    delay: str = "1 hour",
    buckets: int = BUCKETS,
) -> DataFrame:
    """`aggregate_anchored` on a stream: a window comes out when the watermark has passed its end.

    A group's windows begin at the earliest point of the first micro-batch that it appears in, and
    anchors stay in the state; with input in order across micro-batches that is its first point, as in
    the batch. Points without `ts` have no window and end here. Only built-in types. Groups are dealt
    into `buckets`, which are the most tasks that can work at once and whose open windows a trigger that
    has points for them writes anew; the number stays for as long as the checkpoint.
    """
    require(window_seconds > 0, "windowSeconds must be positive")
    require(not {r.type for r in rules} & set(CUSTOM_AGGREGATIONS), "a state is kept for built-in types only")
    step = window_seconds * 1_000_000
    matched = apply_rules(points.filter(F.col("ts").isNotNull()).withWatermark("ts", delay), rules).select(
        "rule_id",
        # Null and empty labels are different groups, and a key that Python reads is text.
        F.to_json("group_labels", {"ignoreNullFields": "false"}).alias("group_json"),
        micros("ts").alias("us"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
        "ts",
    )
    bucket = F.pmod(F.xxhash64("rule_id", "group_json"), F.lit(buckets))
    with by_value():
        states = matched.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
            AnchoredWindows(step, [bounds_of(r) for r in rules]),
            outputStructType=(
                "rule_id int, group_json string, _anchor bigint, window_index bigint, _n bigint, _sum double, "
                "_min double, _max double, under array<bigint>"
            ),
            outputMode="append",
            timeMode="EventTime",
        )
    width = max(len(bounds_of(r)) for r in rules)
    states = states.withColumns(
        {
            "group_labels": F.from_json("group_json", "array<string>"),
            "window_start": instant(F.col("_anchor") + F.col("window_index") * step),
            **{f"_b{j}": F.get("under", F.lit(j)) for j in range(width)},
        }
    )
    return emit(states.drop("group_json", "under"), rules, "group")
