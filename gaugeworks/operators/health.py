"""Pipeline health as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.model import (
    ERR_INVALID_INPUT,
    ERR_PII_LEAK,
    ERR_PROCESSING_FAILED,
    STATUS_ERROR,
    STATUS_SUCCESS,
    require,
)
from gaugeworks.operators.aggregate import histogram
from gaugeworks.session import written

# Latency bucket bounds in seconds.
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def stage_counts(outcomes: DataFrame, stage: str = "stage") -> DataFrame:
    """Counts per stage from result rows (status, error_code, sent_to_dlq)."""
    ok = F.col("status") == STATUS_SUCCESS
    failed = F.col("status") == STATUS_ERROR
    code = F.coalesce("error_code", F.lit(""))
    return outcomes.groupBy(stage).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(ok).alias("forwarded"),
        # Everything that got past the stage's own work, forwarded or not.
        F.count_if(
            ~failed | ~code.isin(ERR_INVALID_INPUT, ERR_PROCESSING_FAILED, ERR_PII_LEAK)
        ).alias("processed"),
        F.count_if(failed).alias("rejected"),
        F.count_if(F.coalesce("sent_to_dlq", F.lit(False))).alias("dlq"),
        F.count_if(failed & (code == ERR_PROCESSING_FAILED)).alias("processing_errors"),
        F.count_if(failed & (code == ERR_INVALID_INPUT)).alias("validation_errors"),
    )


def observed(df: DataFrame, name: str | Observation, **counts: Column) -> DataFrame:
    """The same rows, counted as they pass: `received` and one count per condition.

    On a stream the counts come with every progress report, on a table through an
    Observation given as `name`; either way without a pass of their own.
    """
    return df.observe(
        name,
        F.count(F.lit(1)).alias("received"),
        *[F.count_if(condition).alias(k) for k, condition in counts.items()],
    )


def latency_histogram(
    df: DataFrame,
    seconds: str,
    by: Sequence[str] = (),
    buckets: Sequence[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Cumulative latency counts over the fixed buckets."""
    return histogram(df, seconds, buckets, by)


def error_rate_trips(
    requests: DataFrame,
    dependency: str,
    failed: str,
    window_seconds: int = 60,
    threshold: float = 50.0,
    min_requests: int = 20,
    ts: str = "ts",
) -> DataFrame:
    """Windows in which a dependency had enough requests and too many failures."""
    require(window_seconds > 0, "the window must be positive")
    rate = F.col("failures") * 100 / F.col("requests")
    return (
        requests.groupBy(
            dependency, F.window(ts, f"{window_seconds} seconds").alias("window")
        )
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col(failed)).alias("failures"),
        )
        .withColumn("failure_percent", rate)
        .withColumn(
            "tripped",
            (F.col("requests") >= min_requests) & (F.col("failure_percent") >= threshold),
        )
        .select(
            dependency,
            F.col("window.start").alias("window_start"),
            "requests",
            "failures",
            "failure_percent",
            "tripped",
        )
    )


def _dense_slices(sliced: DataFrame, width: int, slice_rows: int) -> DataFrame | None:
    """(_entity, _hour, _width): a width for each slice of more than `slice_rows` events, at which none
    of its parts has more, down to a microsecond; None where there are no such slices.

    One pass counts by slice; only the events of dense slices are counted again, for each width at
    once, by what they have in parts of 1/16, 1/256 and so on.
    """
    counts = written(
        sliced.groupBy("entity", "hour").count().filter(F.col("count") > slice_rows)
        .select(F.col("entity").alias("_entity"), F.col("hour").alias("_hour")),
        "dense-slices",
    )
    if counts.isEmpty():
        return None
    widths = [width]
    while widths[-1] > 1:
        widths.append(max(1, widths[-1] // 16))
    same = F.col("entity").eqNullSafe(F.col("_entity")) & F.col("hour").eqNullSafe(F.col("_hour"))
    inside = sliced.join(counts, same).withColumn("_in", F.col("us") - F.col("hour") * width)
    # By the finest width first; each coarser one adds those up.
    finest = written(
        inside.groupBy("_entity", "_hour", F.col("_in").alias("_at")).agg(F.count(F.lit(1)).alias("n")),
        "dense-moments",
    )
    chosen = None
    for w in reversed(widths):
        parts = finest.groupBy("_entity", "_hour", F.floor(F.col("_at") / w).alias("part")).agg(F.sum("n").alias("n"))
        most = parts.groupBy("_entity", "_hour").agg(F.max("n").alias("most"))
        fits = most.filter((F.col("most") <= slice_rows) | F.lit(w == 1)).select("_entity", "_hour", F.lit(w).alias("_width"))
        chosen = fits if chosen is None else chosen.unionByName(fits)
    return written(
        chosen.groupBy("_entity", "_hour").agg(F.max("_width").cast("bigint").alias("_width")), "dense-widths"
    )


def state_transitions(
    events: DataFrame,
    entity: str,
    state: str,
    ts: str = "ts",
    id: str = "id",
    slice_seconds: int = 3600,
    slice_rows: int = 1_000_000,
) -> DataFrame:
    """Every step from one event of an entity to its next: from, to, microseconds.

    Steps inside a slice of time come from a window over (entity, slice). The first and
    last events of the slices, at most two per slice, then give the steps across
    slices, so an entity with most of the events is spread over its slices. Slices are
    `slice_seconds` long. Where an entity has more than `slice_rows` events in one, that
    slice alone is cut into parts by its own count: a dense second of one entity leaves
    all other slices, its own and others', as they are.
    """
    us = micros(ts)
    width = slice_seconds * 1_000_000
    sliced = events.select(
        F.col(entity).alias("entity"),
        F.col(state).alias("state"),
        us.alias("us"),
        F.col(id).alias("id"),
        F.floor(us / width).cast("bigint").alias("hour"),
    )
    dense = _dense_slices(sliced, width, slice_rows)
    if dense is None:
        sliced = sliced.withColumn("slice", F.struct("hour", F.lit(0).cast("bigint").alias("part")))
    else:
        same = F.col("entity").eqNullSafe(F.col("_entity")) & F.col("hour").eqNullSafe(F.col("_hour"))
        part = F.when(F.col("_width").isNull(), 0).otherwise(F.floor((F.col("us") - F.col("hour") * width) / F.col("_width")))
        sliced = sliced.join(dense, same, "left").select(
            "entity", "state", "us", "id", F.struct("hour", part.cast("bigint").alias("part")).alias("slice")
        )
    inside = Window.partitionBy("entity", "slice").orderBy("us", "id")
    after = F.lead(F.struct("state", "us"))
    lined = sliced.withColumns(
        {"after": after.over(inside), "opens": F.row_number().over(inside) == 1}
    )
    ends = lined.filter("opens or after is null").withColumn(
        "later", after.over(Window.partitionBy("entity").orderBy("us", "id"))
    )
    near = lined.filter("after is not null").select("entity", "state", "us", "after")
    far = ends.filter("after is null and later is not null").select(
        "entity", "state", "us", F.col("later").alias("after")
    )
    return near.unionByName(far).select(
        "entity",
        F.col("state").alias("from_state"),
        F.col("after.state").alias("to_state"),
        (F.col("after.us") - F.col("us")).alias("micros_in_state"),
    )


def transition_counts(steps: DataFrame, changes_only: bool = True) -> DataFrame:
    """Counts and time in the left state per (from, to)."""
    if changes_only:
        steps = steps.filter("from_state <> to_state")
    return steps.groupBy("from_state", "to_state").agg(
        F.count(F.lit(1)).alias("transitions"),
        F.sum("micros_in_state").alias("micros_in_state"),
    )


def accepted_versions(versions: DataFrame) -> DataFrame:
    """Rule versions that took effect: a generation not above an earlier one is ignored.

    `versions` holds rule_id, generation and seq (order of arrival); it is a table of
    configuration, with a handful of rows per rule.
    """
    before = (
        Window.partitionBy("rule_id")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return versions.withColumn("_newest", F.max("generation").over(before)).filter(
        F.col("_newest").isNull() | (F.col("generation") > F.col("_newest"))
    ).drop("_newest")


def rules_as_of(
    points: DataFrame,
    versions: DataFrame,
    on: Sequence[str],
    generation: str = "config_generation",
) -> DataFrame:
    """Each point with the rule version of its generation (0: the current one).

    A version is valid from its generation up to the next accepted one, so the lookup
    is an equi-join on `on` with a range check. The versions are written first: of known
    small size, they are broadcast and the points stay where they are.
    """
    following = Window.partitionBy("rule_id").orderBy("generation")
    valid = accepted_versions(versions).withColumn(
        "_until", F.lead("generation").over(following)
    )
    wanted = F.coalesce(F.col(generation), F.lit(0))
    left = points.withColumn("_wanted", wanted)
    renamed = written(valid, "rule-versions").select(
        *[F.col(c).alias(f"_{c}") for c in on],
        *[F.col(c).alias(f"rule_{c}" if c == "generation" else c)
          for c in valid.columns if c not in on and c not in ("seq", "_until")],
        "_until",
    )
    hit = (
        (F.col("_wanted") == 0) & F.col("_until").isNull()
    ) | (
        (F.col("_wanted") >= F.col("rule_generation"))
        & (F.col("_until").isNull() | (F.col("_wanted") < F.col("_until")))
    )
    condition = hit
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_{c}"))
    return left.join(renamed, condition, "left").drop(
        "_wanted", "_until", *[f"_{c}" for c in on]
    )
