"""Deduplication with a time to live.

A row is kept when no row of its key was *kept* within the last `ttl`; duplicates do
not extend it, and at exactly `ttl` after the kept row a row is new again. That makes
the kept rows of a key a chain: from a kept row to the first row at least `ttl` later.

Ordinary keys are followed by a scan over the sorted partition with one remembered
time. Keys too large for one task go through `_chain_of_heavy_keys`, which finds the
same chain with joins that halve the rows in play each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.clock import instant, micros, parse_duration
from gaugeworks.functions.values import hashable
from gaugeworks.model import DedupConfig, require
from gaugeworks.session import written

# A key with more rows than this is not left to a single task.
HEAVY_KEY_ROWS = 5_000_000

# Rows of one key and slot go to one task: with distinct microseconds, at most this many.
SLOT_MICROS = 1_000_000

# Slots of a key that go to one task; a key over any span of time has few such stretches.
STRETCH = 65_536


def _field(df: DataFrame, key: str) -> tuple[Column, Column]:
    """Value and presence of a key field: a column, or `map.key` for a map column."""
    if key in df.columns:
        return F.col(key), F.lit(True)
    if "." in key:
        source, name = key.split(".", 1)
        value = F.col(source)
        return value[name], F.coalesce(F.map_contains_key(value, name), F.lit(False))
    return F.lit(None).cast("string"), F.lit(False)


def dedup_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `dedup_key` (fields in name order) and `has_all_keys`.

    A present null is a value like any other; an absent field leaves the row unkeyed.
    """
    require(len(keys) > 0, "no deduplication keys")
    fields = {k: _field(df, k) for k in sorted(set(keys))}
    present = F.lit(True)
    for _, there in fields.values():
        present = present & there
    return df.withColumns(
        {
            "dedup_key": F.struct(
                *[v.alias(k.replace(".", "_")) for k, (v, _) in fields.items()]
            ),
            "has_all_keys": present,
        }
    )


def dedup_first(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", id: str = "id"
) -> DataFrame:
    """The first row of each key by (ts, id, hash of the row); unkeyed rows all stay.

    Each task passes on its first row of a key only, so no key is gathered. (A minimum of
    whole rows per key sorts twice as well and took twice the time.)
    """
    columns = df.columns
    keyed = dedup_key(df, keys).withColumn("_tie", F.xxhash64(*hashable(df)))
    order = Window.partitionBy("dedup_key").orderBy(ts, id, "_tie")
    first = (
        keyed.filter("has_all_keys")
        .withColumn("_place", F.row_number().over(order))
        .filter("_place = 1")
        .select(*columns)
    )
    return first.unionByName(keyed.filter("not has_all_keys").select(*columns))


def follow(
    us: np.ndarray, target: np.ndarray, head: np.ndarray, due: int | None
) -> tuple[np.ndarray, int | None]:
    """Marks each key's first row, then again and again the first at or after the marked
    row's target. Rows are sorted by (key, us); `head` marks where a key begins, and `due` is the
    target that rows before these have left to the first key.

    All keys step at once, so the cost follows the rows kept, not all rows.
    """
    marks = np.zeros(len(us), bool)
    if not len(us):
        return marks, due
    base, last = int(us.min()), int(us.max())
    span = last - base + 2
    begin = np.flatnonzero(head)
    keys = len(begin) + 1
    if keys * span >= 2**62 and keys > 2:
        # Keys are laid end to end on one line of 63 bits; too many long ones go in two steps.
        cut = int(begin[len(begin) // 2])
        left, due = follow(us[:cut], target[:cut], head[:cut], due)
        right, due = follow(us[cut:], target[cut:], head[cut:], due)
        return np.concatenate([left, right]), due
    key = np.cumsum(head)
    line = (us - base) + key * span
    goal = np.minimum(np.maximum(target, base), last + 1) - base + key * span
    end = np.append(begin[1:], len(us))[: len(begin)]
    at = begin
    if not head[0]:
        first = int(np.searchsorted(us[: begin[0]] if len(begin) else us, due))
        stop = int(begin[0]) if len(begin) else len(us)
        if first < stop:
            at, end = np.insert(at, 0, first), np.insert(end, 0, stop)
    while len(at):
        marks[at] = True
        at = np.searchsorted(line, goal[at])
        at, end = at[at < end], end[at < end]
    kept = np.flatnonzero(marks)
    if len(kept):
        due = int(target[kept[-1]])
    return marks, due


def _scan(of_target: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Marks kept rows of sorted rows; one remembered time, whatever the key's size."""

    def scan(
        batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
    ) -> Iterator[pd.Series]:
        due = None
        for us, other, head in batches:
            times = us.to_numpy()
            marks, due = follow(times, of_target(times, other.to_numpy()), head.to_numpy(), due)
            yield pd.Series(marks, dtype="bool")

    # Not deterministic for the optimizer: it must not move filters below the scan.
    return F.pandas_udf(scan, "boolean").asNondeterministic()


def _ttl_scan(us: Column, head: Column, ttl: int) -> Column:
    return _scan(lambda times, _: times + ttl)(us, us, head)


def _pointer_scan(us: Column, following: Column, head: Column) -> Column:
    """The same along pointers to times; a null pointer ends the chain."""
    return _scan(lambda _, to: to)(us, F.coalesce(following, F.lit(2**62)), head)


def _kept_by_scan(df: DataFrame, ttl: int, ts: str, id: str) -> DataFrame:
    """Kept rows among rows with `dedup_key` and `_alone`: one shuffle, O(1) memory."""
    # Rows that are not compared with any other are dealt out by what they hold.
    tie = F.xxhash64(*hashable(df))
    lane = F.when(F.col("_alone"), tie)
    timeline = Window.partitionBy("dedup_key", "_alone", "_lane").orderBy(ts, id, "_tie")
    return (
        df.withColumns({"_lane": lane, "_tie": tie})
        .withColumn("_head", F.row_number().over(timeline) == 1)
        .withColumn("_us", F.coalesce(micros(ts), F.lit(0)))
        .withColumn("_kept", _ttl_scan(F.col("_us"), F.col("_head"), ttl))
        .filter("_alone or _kept")
    )


def _stretch(slot: str) -> Column:
    return F.expr(f"{slot} div {STRETCH}")


def _following(filled: DataFrame, asked: DataFrame, at: str, by: list) -> DataFrame:
    """For every asked place the `low` of the next filled one within the same group, if any."""
    backwards = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col("low").asc_nulls_first())
    return (
        filled.unionByName(asked)
        .withColumn("following", F.last("low", ignorenulls=True).over(backwards))
        .filter("low is null")
        .select("key", at, "following")
    )


def _next_times(nodes: DataFrame, ttl: int) -> DataFrame:
    """For (key, us): `next`, the key's first time at or after us + ttl, if any.

    Work is grouped by (key, slot of time), so no group grows with the key. The slot of
    the looked-for time answers first; where nothing follows there, the first time of
    the key's next filled slot does, looked up once per slot.
    """
    slot = lambda c: F.expr(f"{c} div {SLOT_MICROS}")
    here = nodes.select(
        "key", slot("us").alias("slot"), F.col("us").alias("at"), "us",
        F.lit(None).cast("bigint").alias("source"),
    )
    asked = nodes.withColumn("at", F.col("us") + ttl).select(
        "key", slot("at").alias("slot"), "at",
        F.lit(None).cast("bigint").alias("us"), F.col("us").alias("source"),
    )
    backwards = Window.partitionBy("key", "slot").orderBy(
        F.col("at").desc(), F.col("source").asc_nulls_first()
    )
    in_slot = (
        here.unionByName(asked)
        .withColumn("next", F.last("us", ignorenulls=True).over(backwards))
        .filter("source is not null")
        .select("key", F.col("source").alias("us"), "slot", "next")
    )
    filled = nodes.groupBy("key", slot("us").alias("slot")).agg(F.min("us").alias("low"))
    open_slots = (
        in_slot.filter("next is null").select("key", "slot").distinct()
        .withColumn("low", F.lit(None).cast("bigint"))
    )
    following = _following(filled, open_slots, "slot", ["key", _stretch("slot")])
    # A stretch of slots is one task's work; what a stretch leaves open its followers answer.
    stretches = filled.groupBy("key", _stretch("slot").alias("stretch")).agg(F.min("low").alias("low"))
    left = following.filter("following is null").select("key", _stretch("slot").alias("stretch"))
    later = _following(
        stretches, left.distinct().withColumn("low", F.lit(None).cast("bigint")), "stretch", ["key"]
    ).withColumnRenamed("following", "beyond")
    following = (
        following.withColumn("stretch", _stretch("slot"))
        .join(later, ["key", "stretch"], "left")
        .select("key", "slot", F.coalesce("following", "beyond").alias("following"))
    )
    return in_slot.join(following, ["key", "slot"], "left").select(
        "key", "us", F.coalesce("next", "following").alias("next")
    )


def _scan_times(times: DataFrame, ttl: int) -> DataFrame:
    """Kept (key, us) where each key's distinct times fit a task."""
    timeline = Window.partitionBy("key").orderBy("us")
    return (
        times.withColumn("_head", F.row_number().over(timeline) == 1)
        .withColumn("kept", _ttl_scan(F.col("us"), F.col("_head"), ttl))
        .filter("kept")
        .select("key", "us")
    )


def _rounds_needed(nodes: DataFrame, last_cell: int, heavy_rows: int) -> int:
    """The fewest halvings after which no key has more nodes than `heavy_rows`."""
    most = max(int(last_cell).bit_length(), 1)
    counts = nodes.groupBy("key").agg(
        *[F.count_if(F.expr(f"cell % {1 << k} = 0 or low")).alias(f"n{k}") for k in range(most + 1)]
    )
    largest = counts.agg(*[F.max(f"n{k}") for k in range(most + 1)]).first()
    return next((k for k in range(most) if largest[k] <= heavy_rows), most)


def _chain_of_heavy_keys(times: DataFrame, ttl: int, heavy_rows: int) -> DataFrame:
    """Kept (key, us) among distinct (key, us), for keys of any size.

    Time is cut per key into cells of length `ttl` from the key's first time, so a chain
    has at most one row in a cell and the row after it lies in the next cell or is the
    first of a later one. Round k keeps, as nodes, the rows of every 2^k-th cell and the
    first row of each cell, and shortens pointers that end elsewhere by one step: the
    node reached then is a node of the smaller set. When a key's nodes fit a task the
    chain is read off there, and the rounds are undone by joins with the few rows kept.
    """
    # One row per heavy key.
    anchors = written(
        times.groupBy("key").agg(F.min("us").alias("anchor")), "dedup-anchors"
    )
    celled = times.join(anchors, "key").withColumn("cell", F.expr(f"(us - anchor) div {ttl}"))
    # One row per key and cell of time.
    lows = written(
        celled.groupBy("key", "anchor", "cell").agg(F.min("us").alias("first_us")),
        "dedup-cells",
    )
    next_lows = lows.select(
        "key", F.col("cell").alias("next_cell"), F.col("first_us").alias("next_first")
    )
    level = (
        _next_times(times, ttl)
        .join(anchors, "key")
        .withColumns(
            {
                "cell": F.expr(f"(us - anchor) div {ttl}"),
                "next_cell": F.expr(f"(next - anchor) div {ttl}"),
            }
        )
        .join(lows.select("key", "cell", "first_us"), ["key", "cell"])
        .join(next_lows, ["key", "next_cell"], "left")
        .withColumns(
            {"low": F.expr("us = first_us"), "next_low": F.expr("next = next_first")}
        )
        # In a key's first cell only the first row can be on the chain.
        .filter("cell > 0 or low")
        .select("key", "us", "cell", "low", "next", "next_cell", "next_low")
    )
    level = written(level, "dedup-level")
    last_cell = lows.agg(F.max("cell")).first()[0]
    levels = []
    for k in range(1, _rounds_needed(level, last_cell, heavy_rows) + 1):
        staying = f"cell % {1 << k} = 0 or low"
        ends_in_set = f"next is null or next_low or next_cell % {1 << k} = 0"
        hop = level.filter(f"not ({staying})").select(
            "key", F.col("us").alias("next"),
            F.struct("next", "next_cell", "next_low").alias("beyond"),
        )
        nodes = level.filter(staying)
        # On the way back a kept row brings in the row it was led past, if any.
        skipped = F.when(~F.expr(ends_in_set), F.col("next"))
        levels.append(nodes.select("key", "us", skipped.alias("skipped")))
        level = written(
            nodes.filter(ends_in_set).unionByName(
                nodes.filter(f"not ({ends_in_set})")
                .join(hop, ["key", "next"])
                .select("key", "us", "cell", "low", "beyond.*")
            ),
            "dedup-level",
        )
    most = level.groupBy("key").count().agg(F.max("count")).first()[0]
    kept = _read_off(level) if most <= heavy_rows else _reached(level)
    # Written each time: at most a row per key and cell, so known to be small.
    kept = written(kept, "dedup-chain")
    for finer in reversed(levels):
        kept = written(
            kept.join(finer, ["key", "us"]).select(
                "key", F.explode(F.array_compact(F.array("us", "skipped"))).alias("us")
            ),
            "dedup-chain",
        )
    return kept


def _read_off(level: DataFrame) -> DataFrame:
    """The chain along `next` from each key's first node, where a key's nodes fit a task."""
    timeline = Window.partitionBy("key").orderBy("us")
    return (
        level.withColumn("_head", F.row_number().over(timeline) == 1)
        .withColumn("on_chain", _pointer_scan(F.col("us"), F.col("next"), F.col("_head")))
        .filter("on_chain")
        .select("key", "us")
    )


def _reached(level: DataFrame) -> DataFrame:
    """The same by joins alone, for more nodes than fit a task.

    Pointers are doubled until none leads anywhere; then, longest first, each set of pointers
    adds the nodes that those found so far lead to. As many joins as the chain's length has bits.
    """
    jumps = [written(level.filter("next is not null").select("key", "us", "next"), "dedup-jump")]
    while not jumps[-1].isEmpty():
        onward = jumps[-1].select("key", F.col("us").alias("next"), F.col("next").alias("beyond"))
        doubled = jumps[-1].join(onward, ["key", "next"]).select("key", "us", F.col("beyond").alias("next"))
        jumps.append(written(doubled, "dedup-jump"))
    found = level.groupBy("key").agg(F.min("us").alias("us"))
    for jump in reversed(jumps[:-1]):
        more = found.join(jump, ["key", "us"]).select("key", F.col("next").alias("us"))
        found = written(found.unionByName(more), "dedup-reached")
    return found


def dedup_ttl(
    df: DataFrame,
    keys: Sequence[str],
    ttl: str | int,
    ts: str = "ts",
    id: str = "id",
    heavy_rows: int | None = HEAVY_KEY_ROWS,
) -> DataFrame:
    """The kept rows. Unkeyed and undated rows are all kept.

    Of rows of one key and time the first by id is kept, a null id before all others, and of
    equal ids the one with the smallest hash of the row.

    Counts rows per key first (a map-side combined job over the key columns) and sets
    keys above `heavy_rows` apart; `heavy_rows=None` states that there are none.
    """
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    require(ttl > 0, "the deduplication TTL must be positive")
    columns = df.columns
    keyed = dedup_key(df, keys).withColumn(
        "_alone", ~F.col("has_all_keys") | F.col(ts).isNull()
    )
    if heavy_rows is None:
        return _kept_by_scan(keyed, ttl, ts, id).select(*columns)
    counts = keyed.filter("not _alone").groupBy("dedup_key").count()
    # Heavy keys are few; a number stands for each, once written it does not change.
    heavy = written(
        counts.filter(F.col("count") > heavy_rows).select(
            F.col("dedup_key").alias("_heavy_key"),
            F.monotonically_increasing_id().alias("key"),
        ),
        "dedup-heavy",
    )
    if heavy.isEmpty():
        return _kept_by_scan(keyed, ttl, ts, id).select(*columns)

    # Read several times from here on: worked out once.
    keyed = written(keyed, "dedup-keyed")
    is_heavy = (F.col("dedup_key") == F.col("_heavy_key")) & ~F.col("_alone")
    light = keyed.join(heavy, is_heavy, "left_anti")
    hot = keyed.join(heavy, is_heavy).withColumn("us", micros(ts))
    # A null id is the first of its time.
    least = F.when(F.count_if(F.col(id).isNull()) == 0, F.min(id))
    times = written(hot.groupBy("key", "us").agg(least.alias("_first")), "dedup-times")
    moments = times.select("key", "us")
    most = moments.groupBy("key").count().agg(F.max("count")).first()[0]
    if most <= heavy_rows:
        chain = _scan_times(moments, ttl)
    else:
        chain = _chain_of_heavy_keys(moments, ttl, heavy_rows)
    # With the kept times written and small, the heavy rows themselves never move.
    kept = written(times.join(chain, ["key", "us"]), "dedup-kept")
    # Copies with the same id and time: any one, but the same one each time.
    one = F.min_by(F.struct(*columns), "_tie").alias("_row")
    kept = kept.withColumnsRenamed({"key": "_k", "us": "_u"})
    first_of_time = (
        (F.col("key") == F.col("_k")) & (F.col("us") == F.col("_u"))
        & F.col(id).eqNullSafe(F.col("_first"))
    )
    heavy_kept = (
        hot.withColumn("_tie", F.xxhash64(*hashable(keyed)))
        .join(kept, first_of_time, "left_semi")
        .groupBy("key", "us")
        .agg(one)
        .select("_row.*")
    )
    return (
        _kept_by_scan(light, ttl, ts, id).select(*columns).unionByName(heavy_kept)
    )


def dedup(df: DataFrame, config: DedupConfig, ts: str = "ts", id: str = "id") -> DataFrame:
    """By configuration; a disabled stage hands its input on."""
    if not config.enabled:
        return df
    return dedup_ttl(df, config.keys, config.ttl, ts, id)


def dedup_counts(
    df: DataFrame,
    keys: Sequence[str],
    ttl: str | int,
    ts: str = "ts",
    id: str = "id",
    heavy_rows: int | None = HEAVY_KEY_ROWS,
) -> DataFrame:
    """Rows seen, kept and dropped per key."""
    kept = dedup_ttl(df, keys, ttl, ts, id, heavy_rows)

    def one_each(rows: DataFrame, **flags: int) -> DataFrame:
        return (
            dedup_key(rows, keys)
            .filter("has_all_keys")
            .select("dedup_key", *[F.lit(v).cast("bigint").alias(k) for k, v in flags.items()])
        )

    return (
        one_each(df, seen=1, kept=0)
        .unionByName(one_each(kept, seen=0, kept=1))
        .groupBy("dedup_key")
        .agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept"))
        .select("dedup_key.*", "seen", "kept", (F.col("seen") - F.col("kept")).alias("dropped"))
    )


def empty_store(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """A store with no entries for rows like `df`."""
    return dedup_key(df.limit(0), keys).select(
        "dedup_key", F.col(ts).cast("timestamp").alias("last_kept")
    )


def kept_entries(kept: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """What `kept` changes in a store: the last kept time of each of its keys."""
    return (
        dedup_key(kept, keys)
        .filter(F.col("has_all_keys") & F.col(ts).isNotNull())
        .groupBy("dedup_key")
        .agg(F.max(F.col(ts).cast("timestamp")).alias("last_kept"))
    )


def next_store(
    seen: DataFrame, kept: DataFrame, keys: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """The store after `kept`: the last kept time of every key."""
    return (
        seen.select("dedup_key", "last_kept")
        .unionByName(kept_entries(kept, keys, ts))
        .groupBy("dedup_key")
        .agg(F.max("last_kept").alias("last_kept"))
    )


def dedup_against_store(
    df: DataFrame,
    seen: DataFrame,
    keys: Sequence[str],
    ttl: str | int,
    ts: str = "ts",
    id: str = "id",
    heavy_rows: int | None = HEAVY_KEY_ROWS,
    replay: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and the next version of the store `seen(dedup_key, last_kept)`.

    Rows within `ttl` of a stored time, or older, are duplicates; the rest starts
    afresh, so the store is only joined and never replayed. Rows whose boolean column
    `replay` holds bypass the store and are all kept. To write both results, write the
    kept rows first and give what was written to `next_store`.
    """
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    columns = df.columns
    fresh = df if replay is None else df.filter(~F.coalesce(replay, F.lit(False)))
    known = seen.select(F.col("dedup_key").alias("_known"), "last_kept")
    open_rows = (
        dedup_key(fresh, keys)
        .join(known, (F.col("dedup_key") == F.col("_known")) & F.col("has_all_keys"), "left")
        .filter(
            F.col("last_kept").isNull()
            | F.col(ts).isNull()
            | (micros(ts) >= micros("last_kept") + ttl)
        )
        .select(*columns)
    )
    kept = dedup_ttl(open_rows, keys, ttl, ts, id, heavy_rows)
    store = next_store(seen, kept, keys, ts)
    if replay is not None:
        kept = kept.unionByName(df.filter(F.coalesce(replay, F.lit(False))))
    return kept, store


def expire_seen(seen: DataFrame, now: Column, ttl: str | int) -> DataFrame:
    """Store entries whose expiry is not before `now`."""
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    return seen.filter(~(instant(micros("last_kept") + ttl) < now))
