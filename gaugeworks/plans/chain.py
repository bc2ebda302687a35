"""The stages put together: batches in; points, dead letters, outcomes, health out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.model import (
    ERR_INVALID_INPUT,
    ERR_PII_LEAK,
    STATUS_SUCCESS,
    AggRule,
    ClassRule,
    Connection,
    DedupConfig,
    Endpoint,
    PiiConfig,
    SampleRule,
)
from gaugeworks.functions.values import hashable
from gaugeworks.operators.aggregate import aggregate
from gaugeworks.operators.deadletter import outcome, to_dlq
from gaugeworks.operators.dedup import dedup_ttl
from gaugeworks.operators.export import export, pack_batches
from gaugeworks.operators.health import stage_counts
from gaugeworks.operators.pii import classify, hash_pii_labels, leaked_fields
from gaugeworks.operators.select import (
    filter_rules,
    route,
    sample_by_rule,
    strip_internal_labels,
)
from gaugeworks.operators.validate import error_message, with_violation
from gaugeworks.session import written
from gaugeworks.sources.envelopes import decode, flat_points

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PackConfig:
    """Batches of at most `size` output points for each value of `destination`."""

    destination: str = "name"
    size: int = 1000


@dataclass(frozen=True)
class ChainConfig:
    """What each stage does; a stage left at None is left out of the plan."""

    schema: Mapping[str, Any] | None = None
    enrichment: Sequence[Stage] = ()
    must_be_hashed: Sequence[str] = ()
    pii: PiiConfig | None = None
    dedup: DedupConfig | None = None
    sampling: Sequence[SampleRule] = ()
    seed: int | str = 0
    aggregation: Sequence[AggRule] = ()
    window_seconds: int = 60
    exact: bool = False
    label_policy: str = "strip"
    replay_bypasses_dedup: bool = True
    classification: Sequence[ClassRule] = ()
    filters: Sequence[SampleRule] = ()
    connections: Sequence[Connection] = ()
    extra_stages: Sequence[Stage] = ()
    pack: PackConfig | None = None
    output_schema: Mapping[str, Any] | None = None
    endpoints: Sequence[Endpoint] = ()


@dataclass(frozen=True)
class ChainResult:
    """`output` is what the last stage puts out: points, or packed batches that hold to the
    schema; those that do not are dead letters. `export` writes it to the endpoints."""

    points: DataFrame
    output: DataFrame
    dead_letters: DataFrame
    outcomes: DataFrame
    health: DataFrame
    endpoints: Sequence[Endpoint] = ()

    def export(self, path: str, run: str | int) -> None:
        export(self.output, self.endpoints, path, run)


def judge(batches: DataFrame, config: ChainConfig) -> DataFrame:
    """Per batch: decoded points, and the first thing wrong with it. No shuffle."""
    judged = decode(batches)
    if config.schema is not None:
        judged = with_violation(judged, config.schema)
    else:
        judged = judged.withColumn(
            "violation", F.lit(None).cast("struct<error:string,path:string>")
        )
    if config.must_be_hashed:
        leaks = F.array_distinct(
            F.flatten(
                F.transform(
                    "points",
                    lambda p: leaked_fields(p["labels"], list(config.must_be_hashed)),
                )
            )
        )
    else:
        leaks = F.array().cast("array<string>")
    judged = judged.withColumn("_leaks", F.array_sort(leaks))
    invalid = F.col("violation").isNotNull()
    leaking = F.coalesce(F.size("_leaks") > 0, F.lit(False))
    return judged.withColumns(
        {
            "error_code": F.when(F.col("malformed") | invalid, F.lit(ERR_INVALID_INPUT)).when(
                leaking, F.lit(ERR_PII_LEAK)
            ),
            "error_message": F.when(
                F.col("malformed"), F.lit("failed to parse batch data")
            )
            .when(invalid, error_message(F.col("violation")))
            .when(
                leaking,
                F.concat(
                    F.lit("PII leak detected: unhashed "), F.array_join("_leaks", ",")
                ),
            ),
            # An undecodable batch is reported only; the others go to the dead letters.
            "dlq_on_error": ~F.col("malformed"),
        }
    ).drop("violation", "_leaks")


def clean_points(
    decided: DataFrame, config: ChainConfig, deduplicate: Stage | None = None
) -> DataFrame:
    """Points of the batches that came through: enrich, hash, dedup, labels, classify, filter,
    sample, route (one row per point and target, in `target`), then the stages given.
    `deduplicate` takes the place of the configured deduplication."""
    good = decided.filter(F.col("status") == STATUS_SUCCESS)
    points = flat_points(
        good.drop("status", "error_code", "error_message", "sent_to_dlq", "data")
    )
    for stage in config.enrichment:
        points = points.transform(stage)
    if config.pii is not None:
        points = points.withColumn("labels", hash_pii_labels(F.col("labels"), config.pii))
    if deduplicate is not None:
        points = points.transform(deduplicate)
    elif config.dedup is not None and config.dedup.enabled:
        ttl, keys = config.dedup.ttl, list(config.dedup.keys)
        if config.replay_bypasses_dedup:
            replay = F.coalesce("replay", F.lit(False))
            points = dedup_ttl(points.filter(~replay), keys, ttl).unionByName(points.filter(replay))
        else:
            points = dedup_ttl(points, keys, ttl)
    points = strip_internal_labels(points, config.label_policy)
    if config.classification:
        points = classify(points, config.classification)
    if config.filters:
        points = filter_rules(points, config.filters)
    if config.sampling:
        points = sample_by_rule(points, config.sampling, "id", config.seed)
    if config.connections:
        points = route(points, config.connections)
    for stage in config.extra_stages:
        points = points.transform(stage)
    return points


def packed(output: DataFrame, config: ChainConfig) -> DataFrame:
    """Output points as envelopes; `id` gives the order inside them."""
    if "id" not in output.columns:
        output = output.withColumn("id", F.xxhash64(*hashable(output)))
    columns = [c for c in output.columns if c != "id"]
    return pack_batches(output, config.pack.destination, "id", columns, config.pack.size)


def run_chain(
    batches: DataFrame,
    config: ChainConfig,
    now: Column | None = None,
    forward: Column | None = None,
    dlq_ok: Column | None = None,
    deduplicate: Stage | None = None,
) -> ChainResult:
    """Lazy results over one written table of decided batches.

    That table holds each batch once: its points if it came through, its bytes if it
    goes to the dead letters. `forward` and `dlq_ok` are as in `outcome`; a batch that
    could not be forwarded puts no points out and leaves no trace in the deduplication.
    """
    if "received" not in batches.columns:
        # Written with the batch, so that all results give its points the same time.
        batches = batches.withColumn("received", F.current_timestamp())
    decided = outcome(
        judge(batches, config),
        F.col("error_code"),
        F.col("error_message"),
        F.col("dlq_on_error"),
        F.lit("ok") if forward is None else forward,
        F.lit(True) if dlq_ok is None else dlq_ok,
        carry=[*(c for c in batches.columns if c != "batch_id"), "points"],
    )
    through = F.col("status") == STATUS_SUCCESS
    decided = written(
        decided.withColumns(
            {
                "data": F.when(F.col("sent_to_dlq"), F.col("data")),
                "points": F.when(through, F.col("points")),
            }
        ),
        "decided",
    )
    points = clean_points(decided, config, deduplicate)
    output = (
        aggregate(
            points,
            config.aggregation,
            config.window_seconds,
            exact=config.exact,
        )
        if config.aggregation
        else points
    )
    refused = None
    if config.pack is not None:
        output = packed(output, config)
        if config.output_schema is not None:
            schema = {"properties": {"points": {"type": "array", "items": config.output_schema}}}
            body = F.concat(F.lit('{"points":'), F.col("data").cast("string"), F.lit("}"))
            judged = with_violation(output.withColumn("_body", body), schema, payload="_body")
            # Decided once; both parts are read from it.
            judged = written(judged.drop("_body"), "packed")
            output = judged.filter("violation is null").drop("violation")
            refused = judged.filter("violation is not null")
    outcomes = decided.select(
        "batch_id", "status", "error_code", "error_message", "sent_to_dlq"
    )
    dead = to_dlq(
        decided.filter("sent_to_dlq"),
        "chain",
        F.col("error_code"),
        F.col("error_message"),
        now,
    )
    if refused is not None:
        dead = dead.unionByName(
            to_dlq(refused, "export", ERR_INVALID_INPUT, error_message(F.col("violation")), now)
        )
    health = stage_counts(outcomes.withColumn("stage", F.lit("chain")))
    return ChainResult(points, output, dead, outcomes, health, config.endpoints)


