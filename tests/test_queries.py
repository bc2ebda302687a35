"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_point
import pytest
from compare import compare, duck
from gaugeworks.plans import catalog
from gaugeworks.session import STATE_STORE

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["dedup_ttl_stream", "dedup_handover", "dedup_stream_gc", "agg_anchored_stream", "enrich_host_stream"])
def test_query_where_the_session_names_another_state_store(spark, con, name):
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain = spark.newSession()
    plain.conf.set("spark.sql.session.timeZone", "UTC")
    plain.conf.set(STATE_STORE, other)
    assert compare(plain, con, name, QUERIES[name], ORACLES[name], SF) is None
    assert plain.conf.get(STATE_STORE) == other


SHIPPED = """
import sys
root, d, name, archive, scratch = sys.argv[1:]
sys.path[:0] = [root, root + "/tests"]
import __spark_entry__ as entry_point
from compare import compare, duck
from gaugeworks.session import local_session
spark = local_session(4, **{"spark.driver.memory": "2g", "spark.checkpoint.dir": scratch})
spark.sparkContext.setLogLevel("ERROR")
spark.sparkContext.addPyFile(archive)
problem = compare(spark, duck(d), name, entry_point.queries()[name], entry_point.oracle_sql()[name], d)
spark.stop()
sys.exit(problem)
"""


@pytest.mark.parametrize("name", ["dedup_handover", "dedup_stream_gc", "agg_anchored_stream", "enrich_host_stream"])
def test_query_where_the_code_is_shipped_to_workers(tmp_path, name):
    """Neither the folder nor PYTHONPATH leads to the library, as on a cluster that it is sent to."""
    root = Path(entry_point.__file__).resolve().parent
    archive = shutil.make_archive(str(tmp_path / "library"), "zip", root, "gaugeworks")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SHIPPED, str(root), SF, name, archive, str(tmp_path / "scratch")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert run.returncode == 0, run.stderr[-3000:]
