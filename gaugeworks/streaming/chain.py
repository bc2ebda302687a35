"""The chain on a stream: every micro-batch holds whole, or not at all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros, parse_duration
from gaugeworks.model import require
from gaugeworks.operators.deadletter import TABLE as DEAD_LETTERS
from gaugeworks.operators.deadletter import put_letters
from gaugeworks.operators.dedup import dedup_against_store, kept_entries
from gaugeworks.operators.health import rules_as_of, stage_counts
from gaugeworks.plans.chain import ChainConfig, run_chain
from gaugeworks.session import written
from gaugeworks.sources.ledger import Ledger
from gaugeworks.streaming.dedup import put_store, read_store, store_schema

OUTCOME = "batch_id string, status int, error_code string, error_message string, sent_to_dlq boolean"
COUNTS = (
    "stage string, received bigint, forwarded bigint, processed bigint, rejected bigint, dlq bigint, "
    "processing_errors bigint, validation_errors bigint"
)


def _pinned(ledger: Ledger, run: int, versions: Callable[[], DataFrame]) -> DataFrame:
    """The rule versions of a micro-batch: those of its first attempt."""
    slot = f"run={run}"
    base = ledger.snapshot()
    if slot not in base.of("rules"):
        older = [s for s in base.of("rules") if s != slot]
        base = ledger.commit(base, {"rules": {slot: ledger.write(versions(), "rules")}}, {"rules": older})
    return ledger.read("rules", None, base, [slot])


def chain_stream(
    batches: DataFrame,
    config: ChainConfig,
    path: str,
    checkpoint: str,
    now: Column | None = None,
    delay: str = "1h",
    versions: Callable[[], DataFrame] | None = None,
    rule_key: Sequence[str] = ("name",),
) -> Ledger:
    """Run everything available of a stream of envelopes through the chain, into a ledger at `path`.

    A micro-batch is one version over the tables `points`, `dead_letters`, `outcomes` and `health`, and
    over `seen`, the store that `config.dedup` compares with: a batch that fails after its keys were
    noted does not turn its own replay into duplicates. Stopped anywhere, nothing of a micro-batch is
    seen, and started again it is done anew; one that holds is not done twice.

    Rows more than `delay` behind the newest kept row of earlier micro-batches are late for the
    deduplication and dropped by it. `versions` gives the table of rule versions as `rules_as_of` takes
    it; it is written and noted in the ledger before a micro-batch is worked on, so that a repeated one
    has the rules of its first attempt, whatever came since. Windows are `aggregate_stream`'s over `points`.
    """
    require(not config.aggregation, "windows of a stream are aggregated by aggregate_stream")
    spark = batches.sparkSession
    ledger = Ledger(spark, path)
    pack = replace(config, dedup=None)
    late = parse_duration(delay)

    def step(rows: DataFrame, run: int) -> None:
        if ledger.done(run):
            return
        pinned = None if versions is None else _pinned(ledger, run, versions)
        base = ledger.snapshot()
        newest = base.notes.get("newest")
        changes: list[DataFrame] = []

        def deduplicate(points: DataFrame) -> DataFrame:
            keys, ttl = list(config.dedup.keys), parse_duration(config.dedup.ttl)
            schema = store_schema(points, keys)
            again = F.coalesce("replay", F.lit(False)) & F.lit(config.replay_bypasses_dedup)
            fresh = points.withColumn("_again", again)
            if newest is not None:
                fresh = fresh.filter(F.col("_again") | (micros("ts") >= newest - late))
            kept, _ = dedup_against_store(
                fresh, read_store(ledger, schema, base), keys, ttl, replay="_again"
            )
            kept = written(kept, "stream-kept")
            changes.append(kept_entries(kept.filter("not _again"), keys))
            return kept.drop("_again")

        stage = deduplicate if config.dedup is not None and config.dedup.enabled else None
        result = run_chain(rows, pack, now, deduplicate=stage)
        output = result.output
        if pinned is not None:
            output = rules_as_of(output, pinned, rule_key)
        slot = f"run={run}"
        counts = stage_counts(result.outcomes.withColumn("stage", F.lit("chain")))
        put = {
            "points": {slot: ledger.write(output, "points")},
            DEAD_LETTERS: put_letters(ledger, result.dead_letters),
            "outcomes": {slot: ledger.write(result.outcomes, "outcomes")},
            "health": {slot: ledger.write(counts, "health")},
        }
        drop: dict[str, list[str]] = {}
        latest = newest
        if changes:
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes[0].schema)
            entries = written(changes[0], "stream-entries")
            ttl = parse_duration(config.dedup.ttl)
            horizon = None if newest is None else newest - late
            put["seen"], drop["seen"] = put_store(ledger, schema, base, run, entries, horizon, ttl)
            last = entries.agg(F.max(micros("last_kept"))).first()[0]
            latest = max((t for t in (last, newest) if t is not None), default=None)
        ledger.commit(base, put, drop, lambda notes: {**notes, "stream": run, "newest": latest})
        ledger.vacuum()

    query = (
        batches.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return ledger


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """What the micro-batches counted, summed per stage: the counts of one batch run over all of them."""
    counts = Ledger(spark, path).read("health", COUNTS)
    names = [c.split()[0] for c in COUNTS.split(", ")][1:]
    return counts.groupBy("stage").agg(*[F.sum(c).alias(c) for c in names])
