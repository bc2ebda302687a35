"""Filter, sample, route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.values import hash_fraction, hashable
from gaugeworks.model import Connection, SampleRule, require


def _matches(rule: SampleRule, labels: Column) -> Column:
    return F.coalesce(labels[rule.label] == F.lit(rule.value), F.lit(False))


def _kept(df: DataFrame, by: str, rate: Column, seed: int | str) -> DataFrame:
    """Rows whose fraction is below their rate; without a value in `by` the row's own hash decides."""
    own = hash_fraction(F.xxhash64(*hashable(df)), seed)
    return df.filter((rate >= 1.0) | (F.coalesce(hash_fraction(by, seed), own) < rate))


def filter_rules(
    points: DataFrame, rules: Sequence[SampleRule], labels: str = "labels"
) -> DataFrame:
    """Rows matching any pattern."""
    require(len(rules) > 0, "at least one filter rule must be defined")
    keep = F.lit(False)
    for rule in rules:
        keep = keep | _matches(rule, F.col(labels))
    return points.filter(keep)


def sample_by_rule(
    points: DataFrame,
    rules: Sequence[SampleRule],
    id: str,
    seed: int | str = 0,
    labels: str = "labels",
) -> DataFrame:
    """The first matching rule sets the rate; rows no rule matches are kept.

    Rows without an id are sampled by a hash of the row.
    """
    rate = F.lit(1.0)
    for rule in reversed(rules):
        rate = F.when(_matches(rule, F.col(labels)), F.lit(rule.rate)).otherwise(rate)
    return _kept(points, id, rate, seed)


def sample(df: DataFrame, id: str, rate: float, seed: int | str = 0) -> DataFrame:
    """Keep a fixed share by id: the same rows in every run."""
    return _kept(df, id, F.lit(float(rate)), seed)


def sample_trace(
    df: DataFrame, group: str, ratio: float = 0.1, seed: int | str = 0
) -> DataFrame:
    """Keep whole groups: every row of a group shares the group's decision.

    Rows without a group are sampled one by one.
    """
    return sample(df, group, ratio, seed)


def route(points: DataFrame, connections: Sequence[Connection]) -> DataFrame:
    """One row per (point, target) edge taken; a row taking no edge leaves."""
    edges = F.array_compact(
        F.array(
            *[
                F.when(
                    F.lit(True)
                    if c.filter is None
                    else F.coalesce(F.expr(c.filter), F.lit(False)),
                    F.lit(c.target),
                )
                for c in connections
            ]
        )
    )
    return points.withColumn("target", F.explode(edges))


def strip_internal_labels(
    points: DataFrame,
    policy: str = "strip",
    prefix: str = "__",
    labels: str = "labels",
) -> DataFrame:
    """Drop labels that start with the internal prefix, or keep all of them."""
    require(policy in ("strip", "keep"), f"unknown label policy: {policy}")
    if policy == "keep":
        return points
    return points.withColumn(
        labels, F.map_filter(labels, lambda k, _: ~F.startswith(k, F.lit(prefix)))
    )
