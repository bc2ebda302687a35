from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.model import DEAD_LETTER, ENVELOPE, ConfigError, Endpoint
from gaugeworks.operators import deadletter as dl
from gaugeworks.operators import export as ex
from gaugeworks.sources.ledger import Ledger

NOW = datetime(2024, 1, 31)


def now():
    return F.lit(NOW)


def letters(spark, rows):
    """rows: (batch_id, hours before now, code, sender)."""
    return spark.createDataFrame(
        [(b, bytearray(b"x"), "json", NOW - timedelta(hours=h), c, "m", s, {"replay": "old"}, {"k": "v"})
         for b, h, c, s in rows],
        DEAD_LETTER,
    )


ROWS = [("a", 1, "X", "gw"), ("b", 24, "X", "rx"), ("c", 48, "Y", "gw"), ("d", 0, None, None)]


@pytest.mark.parametrize(
    "how, expected",
    [
        ({}, "abcd"),
        ({"since": "24h"}, "abd"),  # inclusive
        ({"since": "23h59m"}, "ad"),
        ({"until": "1d"}, "bc"),  # inclusive
        ({"since": "2d", "until": "24h"}, "bc"),
        ({"error_code": "X"}, "ab"),
        ({"sender": "gw"}, "ac"),
        ({"error_code": "", "sender": ""}, "abcd"),
        ({"error_code": "X", "sender": "gw", "since": "1h", "until": "1h"}, "a"),
    ],
)
def test_select(spark, how, expected):
    got = dl.replay_select(letters(spark, ROWS), now(), **how).collect()
    assert "".join(sorted(r.batch_id for r in got)) == expected


def test_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "dlq")
    dl.write_dlq(letters(spark, ROWS), path)
    table = dl.read_dlq(spark, path)
    out = dl.replay_select(table, now(), since="12h")
    assert {r.batch_id for r in out.collect()} == {"a", "d"}
    assert "PartitionFilters: [isnotnull(day" in out._jdf.queryExecution().executedPlan().toString()
    kept = dl.retain(table, 24, now())
    assert {r.batch_id for r in kept.collect()} == {"a", "b", "d"}


def test_stamp(spark):
    row = dl.replay_stamp(letters(spark, ROWS[:1]), now()).first()
    assert row.replay is True and row.config_generation == 0 and row.metadata == {"k": "v"}
    assert row.internal_labels == {"replay": "true", "replay_timestamp": "2024-01-31T00:00:00Z"}


def test_stats(spark):
    df = letters(spark, [*ROWS, ("e", 1, "X", "gw")])
    attempts = dl.replay_attempts(
        df, dl.matches(now(), sender="gw"), F.col("batch_id") == "b",
        F.when(F.col("batch_id") == "c", F.lit("ERR_TIMEOUT")).when(
            F.col("batch_id") == "d", F.lit("never asked")),
    )
    got = {r.stat: r["count"] for r in dl.replay_stats(attempts).collect()}
    assert got == {"total": 5, "filtered": 1, "replayed": 2, "errors": 2,
                   "error:unmarshal-error": 1, "error:ERR_TIMEOUT": 1}
    replayed = attempts.filter("attempt = 'replayed'")
    left = dl.delete_replayed(df, replayed).collect()
    assert {r.batch_id for r in left} == {"b", "c", "d"}
    none = dl.replay_stats(attempts.filter("false")).collect()
    assert {r.stat: r["count"] for r in none} == dict.fromkeys(
        ("total", "filtered", "replayed", "errors"), 0)


def test_annotation_overwrites_older_labels(spark):
    batch = spark.createDataFrame(
        [("b", bytearray(b"1"), "json", True, 3, None, {"error": "older", "keep": "1"})], ENVELOPE)
    row = dl.to_dlq(batch, "cl", "ERR_PII_LEAK", "leak", now()).first()
    assert row.internal_labels == {
        "error": "leak", "keep": "1", "error_code": "ERR_PII_LEAK", "fb_sender": "cl",
        "dlq_timestamp": str(int((NOW - datetime(1970, 1, 1)).total_seconds())),
    }
    assert row.metadata == {} and bytes(row.data) == b"1"


@pytest.mark.parametrize(
    "code, to_dlq, forward, dlq_ok, expected",
    [
        (None, True, "ok", True, (1, None, False)),
        ("ERR_PII_LEAK", True, "ok", True, (2, "ERR_PII_LEAK", True)),
        ("ERR_PII_LEAK", True, "ok", False, (2, "ERR_DLQ_SEND_FAILED", False)),
        ("ERR_PROCESSING_FAILED", False, "failed", True, (2, "ERR_PROCESSING_FAILED", False)),
        (None, True, "failed", True, (2, "ERR_FORWARDING_FAILED", True)),
        (None, True, "failed", False, (2, "ERR_DLQ_SEND_FAILED", False)),
        (None, True, "open", True, (2, "ERR_CIRCUIT_BREAKER_OPEN", False)),
        (None, True, "throttled", True, (3, None, False)),
    ],
)
def test_outcome(spark, code, to_dlq, forward, dlq_ok, expected):
    batch = spark.createDataFrame([("b",)], "batch_id string")
    row = dl.outcome(batch, F.lit(code).cast("string"), F.lit("why"), F.lit(to_dlq),
                     F.lit(forward), F.lit(dlq_ok)).first()
    assert (row.status, row.error_code, row.sent_to_dlq) == expected


def points(spark, n=1000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("d"), F.col("id") % 2)).alias("dest"), (F.col("id") * 1.0).alias("value"))


def test_batches_are_bounded_and_complete(spark):
    packed = ex.pack_batches(points(spark), "dest", "id", ["id", "value"], 50, bucket_rows=120)
    rows = packed.withColumn(
        "p", F.from_json(F.col("data").cast("string"), "array<struct<id:bigint,value:double>>")
    ).collect()
    sizes = [len(r.p) for r in rows]
    assert max(sizes) <= 50 and sum(sizes) == 1000
    assert len({x.id for r in rows for x in r.p}) == 1000
    assert len({r.batch_id for r in rows}) == len(rows)
    assert all([x.id for x in r.p] == sorted(x.id for x in r.p) for r in rows)
    # A large destination is cut into several buckets.
    assert len({r.batch_id.split("-")[1] for r in rows if r.batch_id.startswith("hot")}) > 1
    for size in (0, 10_001):
        with pytest.raises(ConfigError):
            ex.pack_batches(points(spark), "dest", "id", ["id"], size)


def test_export_repeats_without_copies(spark, tmp_path):
    ends = [Endpoint("all"), Endpoint("hot", filter="dest = 'hot'"), Endpoint("j", "json", "id < 10")]
    path = str(tmp_path / "out")
    for run in (1, 2, 2):
        ex.export(points(spark).filter(f"id % 2 = {run % 2}"), ends, path, run)
    back = ex.exported(spark, path, "parquet", "id bigint, dest string, value double")
    got = {r.endpoint: r["count"] for r in back.groupBy("endpoint").count().collect()}
    assert got == {"all": 1000, "hot": 334}
    assert ex.exported(spark, path, "json", "id bigint").count() == 10
    with pytest.raises(ConfigError):
        ex.export(points(spark), [], path, 0)
    with pytest.raises(ConfigError):
        ex.export(points(spark), [Endpoint("a"), Endpoint("a")], path, 0)


def test_json_letters(spark, tmp_path):
    path = str(tmp_path / "dlq")
    letters(spark, ROWS).write.json(path)
    (tmp_path / "dlq" / "broken.json").write_text('{"batch_id": "z", \n')
    table = dl.read_dlq_json(spark, path)
    got = {r.batch_id: (r.unreadable, r.data) for r in table.collect()}
    assert {k for k, v in got.items() if not v[0]} == set("abcd")
    assert bytes(got["a"][1]) == b"x"
    attempts = dl.replay_attempts(table, dl.matches(now()), F.col("unreadable"), F.lit(None))
    stats = {r.stat: r["count"] for r in dl.replay_stats(attempts).collect()}
    assert stats == {"total": 5, "filtered": 0, "replayed": 4, "errors": 1, "error:unmarshal-error": 1}


def test_days_are_replaced_and_others_left_alone(spark, tmp_path):
    path = str(tmp_path / "dlq")
    dl.write_dlq(letters(spark, ROWS), path)
    before = {f.name for f in (tmp_path / "dlq").rglob("*.parquet")}
    gone = dl.read_dlq(spark, path).filter("batch_id in ('a')")
    dl.delete_replayed_at(spark, path, gone)
    left = {r.batch_id for r in dl.read_dlq(spark, path).collect()}
    assert left == {r[0] for r in ROWS} - {"a"}
    assert before & {f.name for f in (tmp_path / "dlq").rglob("*.parquet")}
    dl.retain_at(spark, path, 0, now())
    assert dl.read_dlq(spark, path).filter(F.col("timestamp") < now()).count() == 0
    dl.delete_replayed_at(spark, path, gone.filter("false"))


def test_letters_appended_during_a_rewrite_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dlq")
    dl.write_dlq(letters(spark, ROWS), path)
    commit, late = Ledger.commit, [letters(spark, [("late", 1, "X", "gw")]), letters(spark, [("later", 1, "X", "gw")])]

    def disturbed(self, *args, **kwargs):
        # Between reading the day and committing what is left of it.
        if late:
            df = late.pop()
            dl.write_dlq(df, path)
        return commit(self, *args, **kwargs)

    gone = dl.read_dlq(spark, path).filter("batch_id = 'a'")
    monkeypatch.setattr(Ledger, "commit", disturbed)
    dl.delete_replayed_at(spark, path, gone)
    assert sorted(r.batch_id for r in dl.read_dlq(spark, path).collect()) == ["b", "c", "d", "late", "later"]


def test_a_rewrite_that_another_overtakes_starts_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dlq")
    dl.write_dlq(letters(spark, [*ROWS, ("e", 1, "X", "gw"), ("n", 1, "X", "gw")]), path)
    table = dl.read_dlq(spark, path)
    commit, others = Ledger.commit, [table.filter("batch_id = 'e'")]

    def overtaken(self, *args, **kwargs):
        if others:
            dl.delete_replayed_at(spark, path, others.pop())
        return commit(self, *args, **kwargs)

    monkeypatch.setattr(Ledger, "commit", overtaken)
    dl.delete_replayed_at(spark, path, table.filter("batch_id = 'a'"))
    assert sorted(r.batch_id for r in dl.read_dlq(spark, path).collect()) == ["b", "c", "d", "n"]
    # One who read before still has all.
    assert table.count() == 6


def test_letters_without_a_time(spark, tmp_path):
    path = str(tmp_path / "dlq")
    undated = letters(spark, ROWS[:2]).withColumn("timestamp", F.lit(None).cast("timestamp"))
    dl.write_dlq(undated, path)
    dl.write_dlq(undated.limit(0), path)
    dl.write_dlq(letters(spark, ROWS[2:]), path)
    dl.delete_replayed_at(spark, path, undated.filter("batch_id = 'a'"))
    assert sorted(r.batch_id for r in dl.read_dlq(spark, path).collect()) == ["b", "c", "d"]
    dl.retain_at(spark, path, 24, now())
    assert [r.batch_id for r in dl.read_dlq(spark, path).collect()] == ["d"]


def test_letters_of_two_senders_are_told_apart(spark):
    df = letters(spark, [("a", 1, "X", "gw"), ("a", 1, "X", "dp"), (None, 1, "X", None)])
    left = dl.delete_replayed(df, df.filter("fb_sender = 'gw' or batch_id is null")).collect()
    assert [(r.batch_id, r.fb_sender) for r in left] == [("a", "dp")]


def test_endpoints_with_locations(spark, tmp_path):
    here, there = str(tmp_path / "a"), str(tmp_path / "b")
    ends = [Endpoint("x"), Endpoint("y", filter="id < 10", location=there), Endpoint("z", "json", "id < 5", there)]
    ex.export(points(spark), ends, here, 3)
    assert ex.exported(spark, here, "parquet", "id bigint").count() == 1000
    got = ex.exported(spark, there, "parquet", "id bigint").collect()
    assert {(r.endpoint, r.run) for r in got} == {("y", 3)} and len(got) == 10
    assert ex.exported(spark, there, "json", "id bigint").count() == 5


def test_rows_without_an_id_are_packed_into_many_buckets(spark):
    df = points(spark).withColumn("id", F.when(F.col("id") < 0, F.col("id")))
    packed = ex.pack_batches(df, "dest", "id", ["id", "value"], 50, bucket_rows=100).collect()
    assert len({r.batch_id.split("-")[1] for r in packed if r.batch_id.startswith("hot")}) > 1
    assert sum(int(r.metadata["points"]) for r in packed) == 1000
