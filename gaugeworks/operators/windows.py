"""Stored windows: partial states of tumbling windows that later points are merged into.

A state holds a group's count, sum, minimum, maximum and bucket counts for one window. States of the
same window merge into one, so points that arrive later, replayed ones included, need neither the
points before them nor any other window. They lie in a ledger by the day their window begins on; a
run replaces the days that its points fall on, and holds whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.clock import instant, micros
from gaugeworks.model import AggRule, require
from gaugeworks.operators.aggregate import EXACT, apply_rules, bounds_of, emit, of_rule
from gaugeworks.session import written
from gaugeworks.sources.ledger import Ledger, Snapshot

TABLE = "windows"
KEYS = ("rule_id", "group_labels", "window_us")


def _width(rules: Sequence[AggRule]) -> int:
    return max(len(bounds_of(r)) for r in rules)


def state_schema(rules: Sequence[AggRule]) -> str:
    """Of the states; `digits` is the sum as a decimal, right where no value is `lossy` as one."""
    counts = ", ".join(f"_b{j} bigint" for j in range(_width(rules)))
    return (
        "rule_id int, group_labels array<string>, window_us bigint, _n bigint, _total double, "
        f"_digits {EXACT}, _lossy bigint, _min double, _max double" + (f", {counts}" if counts else "")
    )


def window_states(points: DataFrame, rules: Sequence[AggRule], window_seconds: int) -> DataFrame:
    """One state per rule, group and window; points without a time have a window of their own, null."""
    require(window_seconds > 0, "windowSeconds must be positive")
    step = window_seconds * 1_000_000
    value = F.coalesce(F.col("value"), F.lit(0.0))
    number = F.when(~F.isnan(value), value)
    digits = value.try_cast(EXACT)
    lossy = digits.isNull() | (digits.cast("double") != value)
    bounds = of_rule([[str(b) for b in bounds_of(r)] for r in rules], "double")
    return (
        apply_rules(points, rules)
        .withColumn("window_us", micros("ts") - F.pmod(micros("ts"), F.lit(step)))
        .groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(value).alias("_total"),
            F.try_sum(F.when(~lossy, digits)).alias("_digits"),
            F.count_if(lossy).alias("_lossy"),
            F.min(number).alias("_min"),
            F.max(number).alias("_max"),
            *[F.count_if(number <= F.get(bounds, F.lit(j))).alias(f"_b{j}") for j in range(_width(rules))],
        )
    )


def merged_states(states: DataFrame) -> DataFrame:
    """States of the same group and window as one. A decimal sum that was too long stays so."""
    long = (F.count_if(F.col("_digits").isNull() & (F.col("_lossy") < F.col("_n"))) > 0)
    counts = [c for c in states.columns if c.startswith("_b")]
    return states.groupBy(*KEYS).agg(
        F.sum("_n").alias("_n"),
        F.sum("_total").alias("_total"),
        F.when(~long, F.try_sum("_digits")).alias("_digits"),
        F.sum("_lossy").alias("_lossy"),
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        *[F.sum(c).alias(c) for c in counts],
    )


def finished(
    states: DataFrame, rules: Sequence[AggRule], window_seconds: int, exact: bool = False
) -> DataFrame:
    """States as points, as `aggregate` puts them out."""
    total: Column = F.col("_total")
    if exact:
        total = F.when(F.col("_lossy") > 0, total).otherwise(F.coalesce(F.col("_digits").cast("double"), total))
    step = window_seconds * 1_000_000
    return emit(
        states.withColumns(
            {
                "_sum": total,
                "window_start": instant(F.col("window_us")),
                "window_end": instant(F.col("window_us") + step),
            }
        ).drop("window_us"),
        rules,
        "group",
    )


def add_points(
    ledger: Ledger,
    run: int,
    points: DataFrame,
    rules: Sequence[AggRule],
    window_seconds: int,
    stream: str = "windows",
) -> Snapshot:
    """Merge the points of a run into the stored windows, once however often it is called.

    Only the days that the points fall on are read and replaced. Two runs at the same time that meet on
    a day end in a Conflict for the later one, which can simply be called again.
    """
    base = ledger.snapshot()
    if ledger.done(run, stream):
        return base
    schema = state_schema(rules)
    fresh = written(window_states(points, rules, window_seconds), "window-states")
    day = F.coalesce(F.to_date(instant(F.col("window_us"))).cast("string"), F.lit("undated"))
    # As many as there are folders.
    days = {row.day for row in fresh.select(day.alias("day")).distinct().collect()}
    put = {}
    if days:
        both = merged_states(fresh.unionByName(ledger.read(TABLE, schema, base, sorted(days))))
        folder = ledger.write(both.withColumn("day", day), TABLE, ["day"])
        put = {d: f"{folder}/day={d}" for d in days}
    return ledger.commit_run(run, base, {TABLE: put}, stream=stream)


def stored_windows(
    ledger: Ledger,
    rules: Sequence[AggRule],
    window_seconds: int,
    exact: bool = False,
    snapshot: Snapshot | None = None,
) -> DataFrame:
    """All windows stored so far, open ones included: what `aggregate` gives for all points added."""
    return finished(ledger.read(TABLE, state_schema(rules), snapshot), rules, window_seconds, exact)
