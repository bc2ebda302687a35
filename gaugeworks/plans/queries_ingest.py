"""Queries over sources and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.clock import micros
from gaugeworks.operators import enrich
from gaugeworks.plans import inputs
from gaugeworks.plans.catalog import query
from gaugeworks.session import scratch_path
from gaugeworks.sources import envelopes

DAY_US = 86_400_000_000


@query(
    "envelope_scan",
    f"""WITH {inputs.POINTS}, {inputs.BATCHES}
    SELECT batch_id, 'json' AS format, no % 5 = 0 AS replay, no % 4 AS config_generation,
           'events' AS source, 'landing' AS origin, n AS payload_points
    FROM batches""",
)
def envelope_scan(spark, d):
    path = scratch_path(spark, "landed")
    inputs.batches(spark, d, broken=False).write.json(path)
    return envelopes.read_batches(spark, path, "json").select(
        "batch_id",
        "format",
        "replay",
        "config_generation",
        F.col("metadata")["source"].alias("source"),
        F.col("internal_labels")["origin"].alias("origin"),
        F.json_array_length(F.col("data").cast("string")).cast("bigint").alias("payload_points"),
    )


@query(
    "explode_points",
    f"""WITH {inputs.POINTS}
    SELECT 'b' || batch_no AS batch_id,
           row_number() OVER (PARTITION BY batch_no ORDER BY id) - 1 AS pos,
           id, us, name, value, u, k
    FROM points WHERE batch_no % 17 <> 0""",
)
def explode_points(spark, d):
    return envelopes.explode_points(inputs.batches(spark, d)).select(
        "batch_id",
        F.col("pos").cast("bigint").alias("pos"),
        "id",
        micros("ts").alias("us"),
        "name",
        "value",
        F.col("labels")["user"].alias("u"),
        F.col("labels")["k"].alias("k"),
    )


@query(
    "malformed_split",
    f"""WITH {inputs.POINTS}, {inputs.BATCHES}, stages(stage, code) AS (
      VALUES ('aggregate', 'ERR_INVALID_INPUT'), ('dedup', 'ERR_PROCESSING_FAILED'))
    SELECT stage, batch_id, CASE WHEN broken THEN 0 ELSE n END AS points,
           CASE WHEN broken THEN code END AS error_code, NOT broken AS decoded
    FROM batches, stages""",
)
def malformed_split(spark, d):
    parts = []
    for stage in ("aggregate", "dedup"):
        good, bad = envelopes.split_malformed(inputs.batches(spark, d), stage)
        parts.append(
            good.groupBy("batch_id").agg(F.count(F.lit(1)).alias("points")).select(
                F.lit(stage).alias("stage"), "batch_id", "points",
                F.lit(None).cast("string").alias("error_code"), F.lit(True).alias("decoded"),
            )
        )
        parts.append(
            bad.select(
                F.lit(stage).alias("stage"), "batch_id",
                F.lit(0).cast("bigint").alias("points"), "error_code",
                F.lit(False).alias("decoded"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "normalise_shapes",
    f"""WITH {inputs.POINTS}
    SELECT id, us, name, value, u, k,
           CASE WHEN batch_no % 3 = 2 THEN 's' || batch_no END AS service
    FROM points WHERE batch_no % 17 <> 0""",
)
def normalise_shapes(spark, d):
    labels = F.col("labels")
    return envelopes.normalise(inputs.batches(spark, d, "mixed")).select(
        "id",
        micros("ts").alias("us"),
        "name",
        "value",
        labels["user"].alias("u"),
        labels["k"].alias("k"),
        labels["service"].alias("service"),
    )


@query(
    "normalise_prom",
    f"""WITH {inputs.POINTS}
    SELECT 'b' || batch_no AS batch_id, us // 1000 AS ms, name, value, u FROM points""",
)
def normalise_prom(spark, d):
    sample = F.struct(F.unix_millis("ts").alias("timestamp"), "value")
    series = (
        inputs.points(spark, d)
        .groupBy(
            F.expr("id div 100").alias("no"), "name", F.col("labels")["user"].alias("user")
        )
        # At most the 100 points of one batch.
        .agg(F.collect_list(sample).alias("samples"))
        .select(
            "no",
            F.struct(
                F.create_map(F.lit("__name__"), "name", F.lit("user"), "user").alias("labels"),
                "samples",
            ).alias("s"),
        )
    )
    landed = series.groupBy("no").agg(F.collect_list("s").alias("timeseries")).select(
        F.concat(F.lit("b"), "no").alias("batch_id"),
        F.encode(F.to_json(F.struct("timeseries")), "UTF-8").alias("data"),
    )
    return envelopes.normalise_prometheus(landed).select(
        "batch_id",
        F.unix_millis("ts").alias("ms"),
        "name",
        "value",
        F.col("labels")["user"].alias("u"),
    )


@query(
    "host_latest",
    f"""WITH {inputs.HOSTS}
    SELECT hostname, us, cpu_count, total_memory FROM hosts
    QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY us DESC, total_memory DESC) = 1""",
)
def host_latest(spark, d):
    return enrich.latest_snapshot(inputs.hosts(spark, d), id="total_memory").select(
        "hostname", micros("collected_at").alias("us"), "cpu_count", "total_memory"
    )


ASOF = f"""{inputs.HOSTS}, {inputs.HOST_POINTS}, matched AS (
  SELECT p.*, h.us AS seen_us, h.cpu_count, h.total_memory, h.pid AS host_pid,
         h.command_line, coalesce(p.us - h.us <= {3 * DAY_US}, FALSE) AS hit
  FROM host_points p ASOF LEFT JOIN hosts h
    ON p.hostname = h.hostname AND p.us >= h.us)"""


def _enriched(spark, d):
    return enrich.enrich_host(
        inputs.host_points(spark, d), inputs.hosts(spark, d), "3d", ip="ip"
    )


@query(
    "enrich_host_asof",
    f"""WITH {ASOF}
    SELECT id, name, hit, CASE WHEN hit THEN seen_us END AS seen_us,
           CASE WHEN hit THEN cpu_count END AS cpu_count,
           CASE WHEN hit THEN total_memory END AS total_memory FROM matched""",
)
def enrich_host_asof(spark, d):
    return _enriched(spark, d).select(
        "id",
        "name",
        F.col("host_hit").alias("hit"),
        micros(F.col("host_info.collected_at")).alias("seen_us"),
        "host_info.cpu_count",
        "host_info.total_memory",
    )


@query(
    "enrich_host_asof_merge",
    f"""WITH {ASOF}
    SELECT id, hit, CASE WHEN hit THEN total_memory END AS total_memory FROM matched""",
)
def enrich_host_asof_merge(spark, d):
    # The way taken when there are too many snapshots to broadcast.
    points, hosts = inputs.host_points(spark, d), inputs.hosts(spark, d)
    return enrich.enrich_host(points, hosts, "3d", "host", small=0).select(
        "id", F.col("host_hit").alias("hit"), "host_info.total_memory"
    )


@query(
    "enrich_process",
    f"""WITH {ASOF}
    SELECT id, hit AND pid = host_pid AS process_hit,
           CASE WHEN hit AND pid = host_pid THEN command_line END AS command_line
    FROM matched""",
)
def enrich_process(spark, d):
    return enrich.enrich_process(
        inputs.host_points(spark, d), inputs.hosts(spark, d), "3d", host="host"
    ).select("id", "process_hit", F.col("process.command_line").alias("command_line"))


@query(
    "host_expire",
    f"""WITH {inputs.HOSTS}
    SELECT hostname, us, total_memory FROM hosts
    WHERE epoch_us(TIMESTAMP '2024-01-20 00:00:00') - us <= {3 * DAY_US}""",
)
def host_expire(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return enrich.expire_snapshots(inputs.hosts(spark, d), now, "3d").select(
        "hostname", micros("collected_at").alias("us"), "total_memory"
    )


@query(
    "enrich_k8s",
    f"""WITH {inputs.POINTS}
    SELECT id, u, k, n_name AS namespace, c_mktsegment AS node,
           c_custkey IS NOT NULL AS pod_hit
    FROM points LEFT JOIN customer ON c_custkey = uid * 11
    LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def enrich_k8s(spark, d):
    customer, nation = inputs.table(spark, d, "customer"), inputs.table(spark, d, "nation")
    pods = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("pod"),
        F.col("n_name").alias("namespace"),
        F.col("c_mktsegment").alias("node"),
    )
    points = inputs.points(spark, d)
    pod = (F.col("labels")["user"].cast("bigint") * 11).cast("string")
    points = points.withColumn(
        "labels", F.map_concat("labels", F.create_map(F.lit("pod"), pod))
    )
    labels = F.col("labels")
    return enrich.enrich_k8s(points, pods, on=["pod"], values=["namespace", "node"]).select(
        "id",
        labels["user"].alias("u"),
        labels["k"].alias("k"),
        labels["k8s.namespace"].alias("namespace"),
        labels["k8s.node"].alias("node"),
        "pod_hit",
    )


@query(
    "enrich_hit_rate",
    f"""WITH {ASOF}
    SELECT name, count(*) AS lookups, count(*) FILTER (hit) AS hits,
           (count(*) FILTER (hit))::DOUBLE / count(*) AS hit_rate
    FROM matched GROUP BY name""",
)
def enrich_hit_rate(spark, d):
    return enrich.lookup_stats(_enriched(spark, d), by=["name"])
