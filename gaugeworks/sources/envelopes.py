"""Landed batches and the payload shapes inside them.

A payload is decoded by one `from_json`, whatever its shape:

* a bare array of points, or `{"metrics": [points]}`;
* resources, as `resource_metrics` / `scope_metrics` or `resourceMetrics` / `scopeMetrics`, whose
  attributes are a map or a list of keys and values, and whose metrics are points or hold data
  points under `gauge`, `sum`, `histogram`, `exponentialHistogram` or `summary`;
* Prometheus series, `{"timeseries": [{"labels", "samples"}]}`; format `prometheus` asks for them.

An empty object and null hold no points. Any other object, a format that is not known, a metric of a
resource that has neither data points of a kind known nor a value, and a payload that cannot be
decoded yield no points and come out of `split_malformed` as error rows. No payload ends the job.

Of repeated keys the last holds, in labels and in attributes. A time that is missing, or none that a
timestamp can hold, is the time of receipt. Histograms give `_count`, `_sum` and cumulative `_bucket`
points with the label `le`; summaries `_count`, `_sum` and a point for each quantile, with the label
`quantile`. Bounds are written as `bound_text` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.clock import instant
from gaugeworks.functions.values import bound_text_sql
from gaugeworks.model import (
    ENVELOPE,
    ERR_INVALID_INPUT,
    ERR_PROCESSING_FAILED,
    POINT_JSON,
)

_BUCKETS = "struct<offset:double,bucketCounts:array<string>,bucket_counts:array<string>>"
_QUANTILES = "array<struct<quantile:double,value:double>>"
_DATA_POINT = (
    "struct<attributes:string,timeUnixNano:string,time_unix_nano:string,"
    "asDouble:double,as_double:double,asInt:string,as_int:string,count:string,sum:double,"
    "bucketCounts:array<string>,bucket_counts:array<string>,"
    "explicitBounds:array<double>,explicit_bounds:array<double>,"
    "scale:double,zeroCount:string,zero_count:string,zeroThreshold:double,zero_threshold:double,"
    f"positive:{_BUCKETS},negative:{_BUCKETS},"
    f"quantileValues:{_QUANTILES},quantile_values:{_QUANTILES}>"
)
_DATA = f"struct<dataPoints:array<{_DATA_POINT}>,data_points:array<{_DATA_POINT}>>"
_METRIC = (
    "struct<id:bigint,ts:bigint,name:string,value:double,labels:map<string,string>,"
    f"gauge:{_DATA},sum:{_DATA},histogram:{_DATA},summary:{_DATA},"
    f"exponentialHistogram:{_DATA},exponential_histogram:{_DATA}>"
)
_SCOPES = f"array<struct<metrics:array<{_METRIC}>>>"
_RESOURCE = (
    f"struct<resource:struct<attributes:string>,metrics:array<{_METRIC}>,"
    f"scope_metrics:{_SCOPES},scopeMetrics:{_SCOPES}>"
)
_SERIES = "struct<labels:map<string,string>,samples:array<struct<timestamp:bigint,value:double>>>"
_DOCUMENT = (
    f"struct<points:array<{POINT_JSON}>,"
    f"body:struct<metrics:array<{POINT_JSON}>,resource_metrics:array<{_RESOURCE}>,"
    f"resourceMetrics:array<{_RESOURCE}>,timeseries:array<{_SERIES}>>,"
    "undecoded:string>"
)
_CORRUPT = {"columnNameOfCorruptRecord": "undecoded"}
_POINTS = f"array<{POINT_JSON}>"

# Members an object may have, and formats an envelope may name.
MEMBERS = ("metrics", "resource_metrics", "resourceMetrics", "timeseries")
FORMATS = ("json", "otlp", "prometheus")

# The first and last microsecond that a point's time may be.
POSSIBLE_US = (-62_135_596_800_000_000, 253_402_300_799_999_999)

# The code each stage gives an undecodable payload.
DECODE_ERRORS = {"aggregate": ERR_INVALID_INPUT, "dedup": ERR_PROCESSING_FAILED}


def read_batches(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    stream: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """Envelope rows from landed files, as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).schema(ENVELOPE)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(format).load(path)


def _is_one_value(text: Column) -> Column:
    """True when the text is exactly one JSON value, with nothing after it."""
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(one, F.lit(False))


# The decoder is one SQL text, so that building it is one call however large it is. The functions
# below each write a part of it; what is used more than once is bound by a lambda.

_NO_LABELS = "CAST(map() AS MAP<STRING,STRING>)"


def _bind(value: str, name: str, body: str) -> str:
    """body, with `name` for the value."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _list(*arrays: str) -> str:
    """Arrays laid end to end; one that is null is empty."""
    if len(arrays) == 1:
        return f"coalesce({arrays[0]}, array())"
    return f"concat({', '.join(f'coalesce({a}, array())' for a in arrays)})"


def _each(items: str, name: str, of: str) -> str:
    return f"flatten(transform({items}, {name} -> {of}))"


def _last_of(entries: str, key: str, value: str) -> str:
    """A map of entries; of repeated keys the last. An entry without a key is none."""
    later = f"transform(slice({entries}, i + 2, size({entries})), o -> o.{key})"
    kept = f"filter({entries}, (e, i) -> e.{key} IS NOT NULL AND NOT array_contains({later}, e.{key}))"
    return f"map_from_entries(transform({kept}, e -> struct(e.{key}, {value})))"


def _once(labels: str) -> str:
    """A parsed map as it is, or with each key once."""
    repeated = f"size(array_distinct(map_keys({labels}))) < size({labels})"
    return f"CASE WHEN {repeated} THEN {_bind(f'map_entries({labels})', 'es', _last_of('es', 'key', 'e.value'))} ELSE {labels} END"


def _attributes(text: str) -> str:
    """A map of attributes, or a list of keys and typed values."""
    as_map = _bind(f"from_json({text}, 'map<string,string>')", "am", _once("am"))
    listed = f"from_json({text}, 'array<struct<key:string,value:map<string,string>>>')"
    as_list = _bind(listed, "al", _last_of("al", "key", "get(map_values(e.value), 0)"))
    return f"CASE WHEN startswith({text}, '[') THEN {as_list} ELSE {as_map} END"


def _point(name: str, value: str, at: str, labels: str, id: str = "CAST(NULL AS BIGINT)") -> str:
    return f"named_struct('id', {id}, 'ts', {at}, 'name', {name}, 'value', {value}, 'labels', {labels})"


def _number(text: str) -> str:
    return f"try_cast({text} AS DOUBLE)"


def _points_of(kinds: str, tag: str) -> str:
    """The data points of these kinds, tagged."""
    both = [f"m.{kind}.{spelt}" for kind in kinds.split() for spelt in ("dataPoints", "data_points")]
    return f"transform({_list(*both)}, d -> named_struct('kind', '{tag}', 'd', d))"


def _named(suffix: str) -> str:
    return f"concat(m.name, '{suffix}')"


_KINDS = ("gauge", "sum", "histogram", "summary", "exponentialHistogram", "exponential_histogram")
_DATA_POINTS = "concat({}, {}, {}, {})".format(
    _points_of("gauge sum", "number"),
    _points_of("histogram", "histogram"),
    _points_of("exponentialHistogram exponential_histogram", "exponential"),
    _points_of("summary", "summary"),
)
_SINGLE = _point(
    "m.name",
    f"coalesce(d.asDouble, d.as_double, {_number('d.asInt')}, {_number('d.as_int')})",
    "z.at",
    "z.own",
)
_COUNT_AND_SUM = ", ".join(
    [
        _point(_named("_count"), _number("d.count"), "z.at", "z.own"),
        _point(_named("_sum"), "d.sum", "z.at", "z.own"),
    ]
)
# What a data point holds besides: buckets as (bound, count), the one without a bound last, or
# quantiles with their values. Bucket i of a scale ends at base ** (offset + i + 1); negative ones
# mirror it.
_SERIES_OF = (
    "CASE t.kind WHEN 'histogram' THEN "
    "transform(coalesce(d.bucketCounts, d.bucket_counts, array()), (c, i) -> named_struct("
    "'at', coalesce(get(coalesce(d.explicitBounds, d.explicit_bounds), i), CAST('Infinity' AS DOUBLE)), "
    f"'n', {_number('c')})) "
    "WHEN 'exponential' THEN concat("
    "transform(reverse(coalesce(d.negative.bucketCounts, d.negative.bucket_counts, array())), (c, i) -> named_struct("
    "'at', -power(2D, power(2D, -coalesce(d.scale, 0D)) * (coalesce(d.negative.offset, 0D)"
    " + size(coalesce(d.negative.bucketCounts, d.negative.bucket_counts, array())) - 1 - i)), "
    f"'n', {_number('c')})), "
    "array(named_struct('at', coalesce(d.zeroThreshold, d.zero_threshold, 0D), "
    f"'n', {_number('coalesce(d.zeroCount, d.zero_count)')})), "
    "transform(coalesce(d.positive.bucketCounts, d.positive.bucket_counts, array()), (c, i) -> named_struct("
    "'at', power(2D, power(2D, -coalesce(d.scale, 0D)) * (coalesce(d.positive.offset, 0D) + i + 1)), "
    f"'n', {_number('c')})), "
    "array(named_struct('at', CAST('Infinity' AS DOUBLE), 'n', 0D))) "
    "ELSE transform(coalesce(d.quantileValues, d.quantile_values, array()), q -> "
    "named_struct('at', q.quantile, 'n', q.value)) END"
)
_LABEL = "CASE WHEN t.kind = 'summary' THEN 'quantile' ELSE 'le' END"
_CUMULATED = "aggregate(slice(bs, 1, j + 1), 0D, (a, x) -> a + coalesce(x.n, 0D))"
_MEMBER = _point(
    f"CASE WHEN t.kind = 'summary' THEN m.name ELSE {_named('_bucket')} END",
    f"CASE WHEN t.kind = 'summary' THEN b.n ELSE {_CUMULATED} END",
    "z.at",
    f"map_concat(map_filter(coalesce(z.own, {_NO_LABELS}), (k, v) -> k <> {_LABEL}), "
    f"map({_LABEL}, {bound_text_sql('b.at')}))",
)
_TIME = (
    "CAST(floor(try_cast(coalesce(d.timeUnixNano, d.time_unix_nano) AS DECIMAL(20,0)) / 1000) AS BIGINT)"
)
_OF_DATA_POINT = _bind(
    "t.d",
    "d",
    _bind(
        f"named_struct('at', {_TIME}, 'own', {_attributes('d.attributes')})",
        "z",
        f"CASE WHEN t.kind = 'number' THEN array({_SINGLE}) ELSE concat(array({_COUNT_AND_SUM}), "
        + _bind(_SERIES_OF, "bs", f"transform(bs, (b, j) -> {_MEMBER})")
        + ") END",
    ),
)
_NO_KIND = " AND ".join(f"m.{kind} IS NULL" for kind in _KINDS)
_METRIC_POINTS = (
    f"CASE WHEN {_NO_KIND} THEN array({_point('m.name', 'm.value', 'm.ts', _once('m.labels'), 'm.id')}) "
    f"ELSE {_each(_DATA_POINTS, 't', _OF_DATA_POINT)} END"
)
_METRICS = _list("r.metrics", _each(_list("r.scope_metrics", "r.scopeMetrics"), "s", _list("s.metrics")))
# Resource attributes lie under the points' own labels.
_OVER = (
    "CASE WHEN coalesce(size(o), 0) = 0 THEN p.labels ELSE map_concat("
    "map_filter(o, (k, v) -> NOT coalesce(map_contains_key(p.labels, k), false)), coalesce(p.labels, " + _NO_LABELS + ")) END"
)
_RESOURCE_POINTS = _bind(
    _attributes("r.resource.attributes"),
    "o",
    f"transform({_each(_METRICS, 'm', _METRIC_POINTS)}, p -> {_point('p.name', 'p.value', 'p.ts', _OVER, 'p.id')})",
)
_RESOURCES = _list("_doc.body.resource_metrics", "_doc.body.resourceMetrics")
_SAMPLES = _bind(
    _once("s.labels"),
    "l",
    "transform(coalesce(s.samples, array()), x -> "
    + _point("l['__name__']", "x.value", "try_multiply(x.timestamp, 1000L)", "map_filter(l, (k, v) -> k <> '__name__')")
    + ")",
)
# Rebuilt only where some point repeats a label.
_PLAIN = _bind(
    "coalesce(_doc.points, _doc.body.metrics)",
    "ps",
    "CASE WHEN exists(ps, p -> size(array_distinct(map_keys(p.labels))) < size(p.labels)) THEN "
    f"transform(ps, p -> {_point('p.name', 'p.value', 'p.ts', _once('p.labels'), 'p.id')}) ELSE ps END",
)
_FOUND = (
    f"CASE WHEN _doc.points IS NOT NULL THEN {_PLAIN} ELSE concat("
    f"coalesce({_PLAIN}, array()), {_each(_RESOURCES, 'r', _RESOURCE_POINTS)}, "
    f"{_each(_list('_doc.body.timeseries'), 's', _SAMPLES)}) END"
)
# A metric that has neither a kind known nor a value would be a value made up.
_UNREAD = f"exists({_RESOURCES}, r -> exists({_METRICS}, m -> {_NO_KIND} AND m.value IS NULL))"
_ANY = " OR ".join(f"_doc.body.{member} IS NOT NULL" for member in MEMBERS)


def decode(batches: DataFrame) -> DataFrame:
    """Adds `points` (an array; null when undecodable) and `malformed`."""
    text = F.col("data").cast("string")
    bare = F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("["))
    document = F.from_json(
        F.concat(
            F.when(bare, F.lit('{"points":')).otherwise(F.lit('{"body":')),
            text,
            F.lit("}"),
        ),
        _DOCUMENT,
        _CORRUPT,
    )
    # Only a payload without any known member is read for the names of its members: null for an
    # array and for null; names that say nothing known are an error.
    names = "json_object_keys(CAST(data AS STRING))"
    members = ", ".join(f"'{m}'" for m in MEMBERS)
    known = (
        f"_doc.points IS NOT NULL OR {_ANY} OR "
        f"{_bind(names, 'ns', f'coalesce(size(ns) <= 0 OR arrays_overlap(ns, array({members})), true)')}"
    )
    if "format" in batches.columns:
        formats = ", ".join(f"'{f}'" for f in FORMATS)
        series = (
            f"_doc.body.timeseries IS NOT NULL OR coalesce(array_contains({names}, 'timeseries'), "
            "ltrim(CAST(data AS STRING)) = 'null')"
        )
        form = "lower(coalesce(format, 'json'))"
        known = f"({known}) AND {form} IN ({formats}) AND ({form} <> 'prometheus' OR {series})"
    ok = f"_one AND _doc.undecoded IS NULL AND ({known}) AND NOT {_UNREAD}"
    own = [F.col(f"`{c}`") for c in batches.columns]
    found = f"CASE WHEN NOT malformed THEN CAST({_FOUND} AS {_POINTS}) END"
    return (
        batches.select(*own, _is_one_value(text).alias("_one"), document.alias("_doc"))
        .select(*own, "_doc", F.expr(f"NOT coalesce({ok}, false)").alias("malformed"))
        .select(*own, "malformed", F.expr(found).alias("points"))
    )


def flat_points(decoded: DataFrame) -> DataFrame:
    """One row per point, each with an id and a time.

    A point without an id gets one from its batch and place; one without a time, or with one
    outside the years 1 to 9999, gets the time of receipt: the column `received` where there is
    one, otherwise now.
    """
    carried = [
        c for c in decoded.columns if c not in ("points", "malformed", "data", "received")
    ]
    received = F.col("received") if "received" in decoded.columns else F.current_timestamp()
    possible = F.col("p.ts").between(*POSSIBLE_US)
    # The outer form keeps the optimizer from decoding again for a null check.
    exploded = decoded.select(
        *carried, received.alias("_received"), F.posexplode_outer("points").alias("pos", "p")
    )
    return exploded.filter(F.col("pos").isNotNull()).select(
        *carried,
        "pos",
        F.coalesce(F.col("p.id"), F.xxhash64("batch_id", "pos")).alias("id"),
        F.coalesce(F.when(possible, instant(F.col("p.ts"))), F.col("_received")).alias("ts"),
        F.coalesce("p.name", F.lit("")).alias("name"),
        F.coalesce("p.value", F.lit(0.0)).alias("value"),
        F.coalesce(
            F.col("p.labels"), F.create_map().cast("map<string,string>")
        ).alias("labels"),
    )


def explode_points(batches: DataFrame) -> DataFrame:
    """One row per point; a missing name is '', a missing value 0.0."""
    return flat_points(decode(batches))


# All shapes go through the same decoder.
normalise = explode_points


def split_malformed(
    batches: DataFrame, stage: str = "aggregate"
) -> tuple[DataFrame, DataFrame]:
    """Points of the decodable batches, and one error row per undecodable batch."""
    decoded = decode(batches)
    errors = decoded.filter("malformed").select(
        "batch_id",
        F.lit(DECODE_ERRORS[stage]).alias("error_code"),
        F.lit("failed to parse batch data").alias("error_message"),
        F.lit(False).alias("sent_to_dlq"),
    )
    return flat_points(decoded), errors


def normalise_prometheus(batches: DataFrame) -> DataFrame:
    """Points of Prometheus series; `__name__` becomes the name, times are milliseconds.

    Batches are taken as of format `prometheus`, whatever they say. A payload without series is
    malformed; `split_malformed` tells which.
    """
    return explode_points(batches.withColumn("format", F.lit("prometheus")))
