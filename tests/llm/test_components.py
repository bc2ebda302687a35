"""Connected components against a union-find, and what they cost."""

import random

import pytest

from cases import components
from gaugeworks.llm import common

CHAIN = [(i, i + 1) for i in range(40)]
STARS = [(0, i) for i in range(3, 30)] + [(i, 1) for i in range(30, 40)]


@pytest.fixture
def tables(monkeypatch):
    """The purposes of the tables that are written."""
    purposes, written = [], common.written

    def noted(df, purpose):
        purposes.append(purpose)
        return written(df, purpose)

    monkeypatch.setattr(common, "written", noted)
    return purposes


def found(spark, links, kind="long"):
    df = spark.createDataFrame(links, "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
    rows = common.components(df).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.component for r in rows}


def meant(links):
    n = 1 + max((max(x) for x in links), default=-1)
    linked = {x for a, b in links if a != b for x in (a, b)}
    return {i: c for i, c in enumerate(components(n, links)) if i in linked}


def dense(seed):
    rng = random.Random(seed)
    return [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]


@pytest.mark.parametrize("links", [CHAIN, CHAIN[::-2], STARS, STARS + CHAIN[5:9], [(7, 7)], [], dense(1), dense(2)])
def test_components_are_those_of_a_union_find(spark, links):
    assert found(spark, links) == meant(links)


def test_components_of_texts(spark):
    got = found(spark, [(10, 9), (9, 11), (2, 33)], "string")
    assert got == {"10": "10", "9": "10", "11": "10", "2": "2", "33": "2"}


def test_stars_are_written_once(spark, tables):
    assert found(spark, STARS) == meant(STARS)
    assert tables == ["edges"]


def test_no_round_only_confirms_the_one_before(spark, tables):
    links = [(1, 0), (2, 1)]
    assert found(spark, links) == meant(links)
    assert tables == ["edges", "large-star", "small-star"]
