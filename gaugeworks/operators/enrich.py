"""Enrichment from host snapshots and pod metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros, parse_duration
from gaugeworks.functions.values import hashable, put_labels
from gaugeworks.model import require
from gaugeworks.session import written

# Points of a key within one slice of time that one task merges; more are spread.
GROUP_ROWS = 500_000

# Snapshots looked up by a join, and how many of one key may share a slice then.
JOINED_FACTS = 200_000
FACTS_PER_SLICE = 64


def latest_snapshot(hosts: DataFrame, key: str = "hostname", id: str | None = None) -> DataFrame:
    """The last snapshot per host by collection time, then id, then hash of the row; each task
    passes on one row per host."""
    order = [F.desc("collected_at"), *([F.desc(id)] if id else []), "_tie"]
    newest = Window.partitionBy(key).orderBy(*order)
    return (
        hosts.withColumn("_tie", F.xxhash64(*hashable(hosts)))
        .withColumn("_place", F.row_number().over(newest))
        .filter("_place = 1")
        .select(*hosts.columns)
    )


def expire_snapshots(hosts: DataFrame, now: Column, ttl: str | int) -> DataFrame:
    """Snapshots not older than `ttl`; one exactly `ttl` old stays."""
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    return hosts.filter(micros(now) - micros("collected_at") <= ttl)


def as_of(
    points: DataFrame,
    snapshots: DataFrame,
    key: str,
    snapshot_key: str,
    values: Sequence[str],
    ttl: str | int,
    ts: str = "ts",
    at: str = "collected_at",
    group_rows: int = GROUP_ROWS,
    into: str = "snapshot",
    small: int = JOINED_FACTS,
) -> DataFrame:
    """Left lookup of the last snapshot at or before each point, not older than `ttl`.

    The result gains the struct column `into`, null on a miss; a snapshot at a point's
    own time counts. Time is cut into slices of length `ttl`, so a point needs only the
    snapshots of its own slice and the last one of the slice before. A point without a key
    or a time is a miss, and is not looked up.

    Up to `small` snapshots (counted, and few per key and slice) are looked up by a join
    in which they are broadcast, within Spark's own size limit, and the points stay
    where they are. Beyond that both sides are shuffled, see `_merge`.
    """
    ttl = parse_duration(ttl) if isinstance(ttl, str) else ttl
    require(ttl >= 0, "the snapshot TTL must not be negative")
    width = max(ttl, 1)
    facts = snapshots.filter(F.col(snapshot_key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(snapshot_key).alias("_key"),
        micros(at).alias("_at"),
        F.struct(F.col(at), *[F.col(v) for v in values if v != at]).alias("_fact"),
    )
    # One fact per (key, time) is enough, and per slice one goes on to the next slice.
    facts = facts.groupBy("_key", "_at").agg(F.max("_fact").alias("_fact"))
    facts = facts.withColumn("_slice", F.floor(F.col("_at") / width).cast("bigint"))
    carried = (
        facts.groupBy("_key", "_slice")
        .agg(F.max_by(F.struct("_at", "_fact"), "_at").alias("_last"))
        .select(
            "_key", (F.col("_slice") + 1).alias("_slice"), "_last._at", "_last._fact"
        )
    )
    facts = written(facts.unionByName(carried), "snapshots")
    keyed = points.withColumns(
        {
            "_key": F.col(key).cast(facts.schema["_key"].dataType),
            "_at": micros(ts),
            "_slice": F.floor(micros(ts) / width).cast("bigint"),
        }
    )
    if small > 0:
        per_slice = facts.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("n"))
        size, most = per_slice.agg(F.sum("n"), F.max("n")).first()
        if (size or 0) <= small and (most or 0) <= FACTS_PER_SLICE:
            return _probe(keyed, facts, ttl, points.columns, into)
    # In a shuffle by key they would be one task's, however many they are.
    asking = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    found = _merge(keyed.filter(asking), facts, ttl, points.columns, into, at, group_rows)
    return found.unionByName(
        keyed.filter(~asking).select(*points.columns, F.lit(None).cast(found.schema[into].dataType).alias(into))
    )


def _probe(
    keyed: DataFrame, facts: DataFrame, ttl: int, columns: list[str], into: str
) -> DataFrame:
    """Facts as intervals that do not overlap: one match at most per point.

    The facts are a written table, so Spark broadcasts them if their size allows.
    """
    order = Window.partitionBy("_key", "_slice").orderBy("_at")
    until = F.least(
        F.coalesce(F.lead("_at").over(order), F.lit(2**62)), F.col("_at") + ttl + 1
    )
    intervals = facts.select(
        F.col("_key").alias("_k"),
        F.col("_slice").alias("_s"),
        F.col("_at").alias("_from"),
        until.alias("_until"),
        F.col("_fact").alias(into),
    )
    here = (
        (F.col("_key") == F.col("_k"))
        & (F.col("_slice") == F.col("_s"))
        & (F.col("_at") >= F.col("_from"))
        & (F.col("_at") < F.col("_until"))
    )
    return keyed.join(intervals, here, "left").select(*columns, into)


def _merge(
    keyed: DataFrame,
    facts: DataFrame,
    ttl: int,
    columns: list[str],
    into: str,
    at: str,
    group_rows: int,
) -> DataFrame:
    """One running `last` over points and facts merged in time order, per key and slice.

    Linear, with no pairs built. Points are counted per (key, slice); as many groups as the
    count needs share them by a hash of the row and facts are copied to each, so a key holding
    a third of the points, even at one time, is never one task's work.
    """
    point = F.struct(*columns)
    counts = keyed.groupBy("_key", "_slice").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("int").alias("_groups")
    )
    # Only the large ones: few rows, whose written size decides whether they are broadcast.
    counts = written(counts.filter("_groups > 1"), "groups")
    groups = F.coalesce("_groups", F.lit(1))
    copies = F.explode(F.sequence(F.lit(0), groups - 1)).alias("_group")
    right = facts.join(counts, ["_key", "_slice"], "left").select(
        "_key", "_slice", copies, "_at", F.lit(0).alias("_kind"), "_fact",
        F.lit(None).cast(keyed.select(point).schema[0].dataType).alias("_point"),
    )
    left = keyed.withColumn("_row", F.xxhash64(*hashable(keyed))).join(
        counts, ["_key", "_slice"], "left"
    ).select(
        "_key", "_slice",
        F.pmod("_row", groups).cast("int").alias("_group"),
        "_at",
        F.lit(1).alias("_kind"),
        F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"),
        point.alias("_point"),
    )
    running = Window.partitionBy("_key", "_slice", "_group").orderBy("_at", "_kind")
    seen = F.last("_fact", ignorenulls=True).over(running)
    fresh = F.col("_at") - micros(F.col("_seen")[at]) <= ttl
    return (
        left.unionByName(right)
        .withColumn("_seen", seen)
        .filter("_kind = 1")
        .select("_point.*", F.when(fresh, F.col("_seen")).alias(into))
    )


def enrich_host(
    points: DataFrame,
    hosts: DataFrame,
    ttl: str | int,
    host: str = "hostname",
    ip: str | None = None,
    values: Sequence[str] = ("os", "architecture", "cpu_count", "total_memory"),
    ts: str = "ts",
    group_rows: int = GROUP_ROWS,
    small: int = JOINED_FACTS,
) -> DataFrame:
    """Adds `host_info` by host name or, failing that, by address; and `host_hit`."""
    out = as_of(
        points, hosts, host, "hostname", values, ttl, ts, group_rows=group_rows, into="host_info",
        small=small,
    )
    if ip is not None:
        out = as_of(
            out, hosts, ip, "ip", values, ttl, ts, group_rows=group_rows, into="_by_ip",
            small=small,
        ).withColumn("host_info", F.coalesce("host_info", "_by_ip"))
        out = out.drop("_by_ip")
    return out.withColumn("host_hit", F.col("host_info").isNotNull())


def enrich_process(
    points: DataFrame,
    hosts: DataFrame,
    ttl: str | int,
    host: str = "hostname",
    pid: str = "pid",
    ts: str = "ts",
    group_rows: int = GROUP_ROWS,
    small: int = JOINED_FACTS,
) -> DataFrame:
    """Adds `process` of (host, pid); an expired host or unknown pid is a miss.

    Snapshots are looked up as (host, pid, entry) rows, so a host's whole process map
    is not copied to each of its points.
    """
    # Every snapshot answers for the host, also with no such pid: a later snapshot
    # without the pid hides an earlier one with it. Hence the time of the host match.
    matched = as_of(
        points, hosts.select("hostname", "collected_at"), host, "hostname", [], ttl, ts,
        group_rows=group_rows, into="_match", small=small,
    )
    entries = hosts.select(
        "hostname", "collected_at", F.explode("processes").alias("_pid", "process")
    )
    # Among snapshots of one host and time the last in value order wins, as in as_of.
    entries = written(
        entries.groupBy("hostname", "collected_at", "_pid").agg(
            F.max("process").alias("process")
        ),
        "processes",
    )
    on = [
        F.col("_h") == F.col("hostname_"),
        F.col("_match.collected_at") == F.col("collected_at_"),
        F.col("_p") == F.col("_pid"),
    ]
    named = entries.select(
        F.col("hostname").alias("hostname_"),
        F.col("collected_at").alias("collected_at_"),
        "_pid",
        "process",
    )
    return (
        matched.withColumns({"_h": F.col(host), "_p": F.col(pid).cast("int")})
        .join(named, on, "left")
        .drop("_h", "_p", "_pid", "hostname_", "collected_at_", "_match")
        .withColumn("process_hit", F.col("process").isNotNull())
    )


def enrich_k8s(
    points: DataFrame,
    pods: DataFrame,
    on: Sequence[str] = ("namespace", "pod"),
    values: Sequence[str] = ("node", "deployment"),
    labels: str = "labels",
    prefix: str = "k8s.",
) -> DataFrame:
    """Pod metadata as labels where known; every point stays, once.

    The pod table is written once, so its real size decides whether it is broadcast.
    """
    # Known pods are made unique, so a point cannot multiply.
    unique = written(
        pods.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(
            F.max(F.struct(*values)).alias("_meta_")
        ),
        "pods",
    )
    keys = {f"_k{i}": F.col(labels)[c] for i, c in enumerate(on)}
    joined = points.withColumns(keys).join(
        unique, [F.col(f"_k{i}") == F.col(f"_{c}") for i, c in enumerate(on)], "left"
    )
    return (
        joined.withColumn(
            labels,
            F.when(
                F.col("_meta_").isNotNull(),
                put_labels(
                    F.col(labels), {f"{prefix}{v}": F.col("_meta_")[v] for v in values}
                ),
            ).otherwise(F.col(labels)),
        )
        .withColumn("pod_hit", F.col("_meta_").isNotNull())
        .drop("_meta_", *keys, *[f"_{c}" for c in on])
    )


def lookup_stats(enriched: DataFrame, hit: str = "host_hit", by: Sequence[str] = ()) -> DataFrame:
    """Lookups, hits and hit rate."""
    return enriched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if(F.col(hit)).alias("hits"),
        (F.count_if(F.col(hit)) / F.count(F.lit(1))).alias("hit_rate"),
    )
