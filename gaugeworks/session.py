"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE: ROCKSDB,
}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gaugeworks")
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cores),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_STARTING = threading.RLock()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, which `transformWithState` needs.

    A stream has a copy of the session's settings from its start on, and its checkpoint the store
    that it began with, so the session's own setting is back afterwards.
    """
    with _STARTING:
        before = spark.conf.get(STATE_STORE, None)
        spark.conf.set(STATE_STORE, ROCKSDB)
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(STATE_STORE)
            else:
                spark.conf.set(STATE_STORE, before)


_PICKLING = threading.RLock()


@contextmanager
def by_value() -> Iterator[None]:
    """Python functions that Spark is given in here carry the library's code that they use.

    A stream's first micro-batch also makes its stateful processor in a Python process beside the
    driver, which reads no files shipped with `addPyFile` and so could not import the library.
    """
    library = sys.modules[__name__.partition(".")[0]]
    with _PICKLING:
        known = library.__name__ in cloudpickle.list_registry_pickle_by_value()
        cloudpickle.register_pickle_by_value(library)
        try:
            yield
        finally:
            if not known:
                cloudpickle.unregister_pickle_by_value(library)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="gaugeworks-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one."""
    return f"{scratch_root(spark).rstrip('/')}/gaugeworks/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write once to the shared folder, go on from the files.

    Spark then knows the real size, and broadcasts the table in a join only if it is
    within `spark.sql.autoBroadcastJoinThreshold`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
