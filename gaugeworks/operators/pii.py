"""Personal data: hash, detect, audit, scrub, classify."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.values import (
    EMAIL_IN_TEXT,
    IPV4_IN_TEXT,
    hash_pii,
    is_hashed_or_encoded,
    put_labels,
)
from gaugeworks.model import DEFAULT_PII_FIELDS, ERR_PII_LEAK, ClassRule, PiiConfig
from gaugeworks.session import written


def hash_pii_fields(df: DataFrame, config: PiiConfig) -> DataFrame:
    """Replace each listed column by `<field>_hash`; other columns stay."""
    present = [f for f in config.fields if f in df.columns]
    return df.withColumns(
        {f"{f}_hash": hash_pii(F.col(f), config.salt) for f in present}
    ).drop(*present)


def hash_pii_labels(labels: Column, config: PiiConfig) -> Column:
    """The same inside a label map; a hash already there is overwritten."""
    fields = list(config.fields)
    hashes = [f"{f}_hash" for f in fields]
    raw = F.map_filter(labels, lambda k, _: k.isin(*fields))
    # A hash label gives way only where its raw label is present.
    rest = F.map_filter(
        labels,
        lambda k, _: ~k.isin(*fields)
        & ~(
            k.isin(*hashes)
            & F.map_contains_key(raw, F.regexp_replace(k, r"_hash$", ""))
        ),
    )
    return F.map_concat(
        rest,
        F.transform_values(
            F.transform_keys(raw, lambda k, _: F.concat(k, F.lit("_hash"))),
            lambda _, v: hash_pii(v, config.salt),
        ),
    )


def _leaks(value: Column, hashed_twin: Column, strict: bool) -> Column:
    return (
        value.isNotNull() & hashed_twin.isNull() & ~is_hashed_or_encoded(value, strict)
    )


def leaked_fields(
    labels: Column, fields: Sequence[str] = DEFAULT_PII_FIELDS, strict: bool = False
) -> Column:
    """Names of the fields that are present raw, unhashed, and have no hash beside them."""
    checks = [
        F.when(_leaks(labels[f], labels[f"{f}_hash"], strict), F.lit(f)) for f in fields
    ]
    return F.array_compact(F.array(*checks))


def detect_leaks(
    points: DataFrame,
    fields: Sequence[str] = DEFAULT_PII_FIELDS,
    labels: str = "labels",
    batch: str = "batch_id",
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Clean points, and one error row per batch holding any leak.

    A batch with one leak is held back whole. Only the ids of leaking batches are
    combined and written, so a batch of any size is never gathered.
    """
    found = leaked_fields(F.col(labels), fields, strict)
    leaking = written(
        # The outer form keeps the test for leaks from being made once more as a filter.
        points.select(batch, F.explode_outer(found).alias("field"))
        .filter("field is not null")
        .groupBy(batch)
        .agg(
            # At most one entry per configured field.
            F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"),
        ),
        "leaking-batches",
    )
    errors = leaking.select(
        batch,
        F.lit(ERR_PII_LEAK).alias("error_code"),
        F.concat(F.lit("PII leak detected: unhashed "), "fields").alias("error_message"),
        F.lit(True).alias("sent_to_dlq"),
    )
    held = leaking.select(F.col(batch).alias("_held"))
    return points.join(held, F.col(batch).eqNullSafe(F.col("_held")), "left_anti"), errors


def leak_audit(
    points: DataFrame,
    fields: Sequence[str] = DEFAULT_PII_FIELDS,
    by: Sequence[str] = (),
    labels: str = "labels",
    strict: bool = False,
) -> DataFrame:
    """Seen, hashed and leaked counts per field (and sender): one pass, then unpivot."""
    sums = []
    for f in fields:
        value, twin = F.col(labels)[f], F.col(labels)[f"{f}_hash"]
        sums += [
            F.count_if(value.isNotNull() | twin.isNotNull()).alias(f"seen_{f}"),
            F.count_if(_leaks(value, twin, strict)).alias(f"leak_{f}"),
        ]
    counted = points.groupBy(*by).agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"seen_{f}").alias("seen"),
                F.col(f"leak_{f}").alias("leaked"),
            )
            for f in fields
        ]
    )
    return counted.select(*by, F.inline(rows))


def scrub_text(
    df: DataFrame, column: str, email: str = "<email>", ip: str = "<ip>"
) -> DataFrame:
    """Replace e-mail and IPv4 addresses in free text; count what was replaced."""
    text = F.col(column)
    # Most texts hold neither; a plain search for the telling character is far cheaper.
    at_sign = F.contains(text, F.lit("@"))
    no_email = F.when(at_sign, F.regexp_replace(text, EMAIL_IN_TEXT, email)).otherwise(text)
    counted = df.withColumns(
        {
            "emails_found": F.when(
                at_sign, F.regexp_count(text, F.lit(EMAIL_IN_TEXT))
            ).when(text.isNotNull(), F.lit(0)),
            "ips_found": F.regexp_count(text, F.lit(IPV4_IN_TEXT)),
            column: no_email,
        }
    )
    return counted.withColumn(
        column,
        F.when(
            F.col("ips_found") > 0, F.regexp_replace(column, IPV4_IN_TEXT, f"$1{ip}")
        ).otherwise(F.col(column)),
    )


def classify(points: DataFrame, rules: Sequence[ClassRule]) -> DataFrame:
    """Adds `category` of the first rule that holds, by priority, and its labels."""
    ordered = sorted(rules, key=lambda r: r.priority)
    category = F.lit(None).cast("string")
    extra = F.create_map().cast("map<string,string>")
    for rule in reversed(ordered):
        holds = F.coalesce(F.expr(rule.predicate), F.lit(False))
        category = F.when(holds, F.lit(rule.category)).otherwise(category)
        literal = [F.lit(x) for kv in rule.labels.items() for x in kv]
        extra = F.when(
            holds, F.create_map(*literal).cast("map<string,string>")
        ).otherwise(extra)
    named = {k for r in rules for k in r.labels}
    out = points.withColumn("category", category)
    if named:
        out = out.withColumn("_extra", extra)
        out = out.withColumn(
            "labels",
            put_labels(
                F.col("labels"),
                {k: F.coalesce(F.col("_extra")[k], F.col("labels")[k]) for k in named},
            ),
        ).drop("_extra")
    return out
