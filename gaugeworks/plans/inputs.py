"""Telemetry-shaped inputs derived from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.functions.values import hash_pii
from gaugeworks.model import (
    ERR_FORWARDING_FAILED,
    ERR_INVALID_INPUT,
    ERR_PII_LEAK,
    ERR_PROCESSING_FAILED,
)

SALT = "pepper-and-salt"
BATCH_POINTS = 100
BROKEN_EVERY = 17


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores: the tables here are files of one row group, and the work on
    a row is heavy. A large source has splits enough and needs no such step."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def as_points(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("name"),
        "value",
        F.create_map(
            F.lit("user"),
            F.col("user_id").cast("string"),
            F.lit("k"),
            F.get_json_object("props", "$.k"),
        ).alias("labels"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, ts, name, value, labels {user, k}."""
    return as_points(table(spark, d, "events"))


POINTS = """points AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, event_type AS name, value,
         user_id AS uid, user_id::VARCHAR AS u, props->>'$.k' AS k,
         event_id // 100 AS batch_no
  FROM events)"""


def ragged_points(spark: SparkSession, d: str) -> DataFrame:
    """Points whose label k is absent (id % 7 = 0) or empty (id % 7 = 1) at times."""
    at = F.col("id") % 7
    user = F.col("labels")["user"]
    return points(spark, d).withColumn(
        "labels",
        F.when(at == 0, F.create_map(F.lit("user"), user))
        .when(at == 1, F.create_map(F.lit("user"), user, F.lit("k"), F.lit("")))
        .otherwise(F.col("labels")),
    )


RAGGED = """ragged AS (
  SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' ELSE k END AS k)
  FROM points)"""


def email_label(user: Column, salt: str = SALT) -> tuple[Column, Column]:
    raw = F.concat(F.lit("u"), user, F.lit("@example.com"))
    return raw, hash_pii(raw, salt)


def points_with_email(spark: SparkSession, d: str) -> DataFrame:
    """Label `email` is raw where the value is above 200, else hashed."""
    raw, digest = email_label(F.col("labels")["user"])
    return points(spark, d).select(
        F.concat(F.lit("b"), F.expr("id div 100")).alias("batch_id"),
        "id",
        "ts",
        "name",
        "value",
        F.map_concat(
            "labels",
            F.create_map(
                F.lit("email"), F.when(F.col("value") > 200, raw).otherwise(digest)
            ),
        ).alias("labels"),
    )


def batches(spark: SparkSession, d: str, shape: str = "bare", broken: bool = True) -> DataFrame:
    """Envelopes of the points with equal `id div 100` (at most 100 each).

    shape: "bare" array, or "mixed" (bare, {"metrics"}, {"resource_metrics"} by turns).
    Every 17th batch is cut off when `broken`.
    """
    grouped = (
        points(spark, d)
        .groupBy(F.expr(f"id div {BATCH_POINTS}").alias("no"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("id", micros("ts").alias("ts"), "name", "value", "labels")
                ),
                lambda a, b: F.when(a["id"] < b["id"], F.lit(-1)).otherwise(F.lit(1)),
            ).alias("points")
        )
    )
    bare = F.to_json("points")
    if shape == "mixed":
        text = (
            F.when(F.col("no") % 3 == 0, bare)
            .when(F.col("no") % 3 == 1, F.concat(F.lit('{"metrics":'), bare, F.lit("}")))
            .otherwise(
                F.concat(
                    F.lit('{"resource_metrics":[{"resource":{"attributes":{"service":"s'),
                    F.col("no"),
                    F.lit('"}},"metrics":'),
                    bare,
                    F.lit("}]}"),
                )
            )
        )
    else:
        text = bare
    if broken:
        cut = F.substring(text, F.lit(1), F.length(text) - 5)
        text = F.when(F.col("no") % BROKEN_EVERY == 0, cut).otherwise(text)
    return grouped.select(
        F.concat(F.lit("b"), "no").alias("batch_id"),
        F.encode(text, "UTF-8").alias("data"),
        F.lit("json" if shape == "bare" else "otlp").alias("format"),
        (F.col("no") % 5 == 0).alias("replay"),
        (F.col("no") % 4).alias("config_generation"),
        F.create_map(
            F.lit("source"), F.lit("events"), F.lit("no"), F.col("no").cast("string")
        ).alias("metadata"),
        F.create_map(F.lit("origin"), F.lit("landing")).alias("internal_labels"),
    )


BATCHES = """batches AS (
  SELECT batch_no AS no, 'b' || batch_no AS batch_id, count(*) AS n,
         batch_no % 17 = 0 AS broken
  FROM points GROUP BY batch_no)"""


def hosts(spark: SparkSession, d: str) -> DataFrame:
    """Host snapshots: the signup events."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    user, pid = F.col("user_id"), (F.col("event_id") % 5).cast("int")
    process = F.struct(
        pid.alias("pid"),
        F.concat(F.lit("run --job="), F.col("event_id")).alias("command_line"),
        F.concat(F.lit("u"), user).alias("user"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.col("value").alias("cpu_usage"),
        F.col("event_id").alias("memory_usage"),
    )
    return e.select(
        F.concat(F.lit("h"), user).alias("hostname"),
        F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), user % 256).alias("ip"),
        F.lit("linux").alias("os"),
        F.lit("x86").alias("architecture"),
        F.floor("value").cast("int").alias("cpu_count"),
        F.col("event_id").alias("total_memory"),
        F.create_map(pid, process).alias("processes"),
        F.col("ts").cast("timestamp").alias("collected_at"),
    )


HOSTS = """hosts AS (
  SELECT 'h' || user_id AS hostname, ts AS collected_at, epoch_us(ts) AS us,
         floor(value)::INTEGER AS cpu_count, event_id AS total_memory,
         event_id % 5 AS pid, 'run --job=' || event_id AS command_line
  FROM events WHERE event_type = 'signup')"""


def host_points(spark: SparkSession, d: str) -> DataFrame:
    """The other events; every fourth names its host by address only."""
    e = table(spark, d, "events").filter("event_type <> 'signup'")
    by_ip = F.col("event_id") % 4 == 0
    address = F.concat(
        F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256
    )
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("name"),
        "value",
        F.when(~by_ip, F.concat(F.lit("h"), "user_id")).alias("hostname"),
        F.when(by_ip, address).alias("ip"),
        F.concat(F.lit("h"), "user_id").alias("host"),
        (F.col("event_id") % 8).cast("int").alias("pid"),
    )


HOST_POINTS = """host_points AS (
  SELECT event_id AS id, ts, epoch_us(ts) AS us, event_type AS name, value,
         'h' || user_id AS hostname, event_id % 8 AS pid
  FROM events WHERE event_type <> 'signup')"""


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a dead letter: code by id % 4, sender by id % 5."""
    e = table(spark, d, "events")
    codes = F.array(
        *[
            F.lit(c)
            for c in (
                ERR_INVALID_INPUT,
                ERR_PII_LEAK,
                ERR_FORWARDING_FAILED,
                ERR_PROCESSING_FAILED,
            )
        ]
    )
    senders = F.array(*[F.lit(s) for s in ("rx", "cl", "dp", "agg", "gw")])
    return e.select(
        F.concat(F.lit("e"), "event_id").alias("batch_id"),
        F.encode("props", "UTF-8").alias("data"),
        F.lit("json").alias("format"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.get(codes, (F.col("event_id") % 4).cast("int")).alias("error_code"),
        F.concat(F.lit("failed on "), "event_type").alias("error_message"),
        F.get(senders, (F.col("event_id") % 5).cast("int")).alias("fb_sender"),
        F.create_map(F.lit("origin"), "event_type").alias("internal_labels"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"),
    )


DEAD = """dead AS (
  SELECT 'e' || event_id AS batch_id, ts, epoch_us(ts) AS us, event_id, event_type, user_id,
         CASE event_id % 4 WHEN 0 THEN 'ERR_INVALID_INPUT' WHEN 1 THEN 'ERR_PII_LEAK'
              WHEN 2 THEN 'ERR_FORWARDING_FAILED' ELSE 'ERR_PROCESSING_FAILED' END AS error_code,
         CASE event_id % 5 WHEN 0 THEN 'rx' WHEN 1 THEN 'cl' WHEN 2 THEN 'dp'
              WHEN 3 THEN 'agg' ELSE 'gw' END AS fb_sender
  FROM events)"""


def ttl_chain(source: str, ttl_us: int, key: str = "k1, k2", extra: str = "") -> str:
    """CTEs: `kept` = ids kept by the greedy rule over `source(k1, k2, us, id)`.

    Distinct times step from one kept time to the next, then the lowest id is taken.
    """
    on = " AND ".join(f"s.{c.strip()} = c.{c.strip()}" for c in key.split(","))
    cols = ", ".join(f"c.{c.strip()}" for c in key.split(","))
    back = " AND ".join(f"s.{c.strip()} = c.{c.strip()}" for c in key.split(","))
    return f"""chain({key}, us) AS (
  SELECT {key}, min(us) FROM {source} GROUP BY {key}
  UNION ALL
  SELECT {cols}, min(s.us) FROM chain c JOIN {source} s
    ON {on} AND s.us >= c.us + {ttl_us} GROUP BY {cols}, c.us),
kept AS (
  SELECT min(s.id) AS id, {cols}, c.us FROM chain c JOIN {source} s
    ON {back} AND s.us = c.us GROUP BY {cols}, c.us){extra}"""
