"""Distances of all pairs by blocks: the values of the templates to the last bit."""

import math
import random

import pytest

from basalt.engine import Engine
from basalt.operators import vectors
from basalt.plans import catalog

TEXT = "SELECT a.id, ROUND({f}(a.x, b.x), {k}) AS d, b.id AS other, b.note FROM {{t}} AS a CROSS JOIN (SELECT id, x, note FROM {{t}} WHERE MOD(id, 2) = 0) AS b"


def plan(df):
    return df._jdf.queryExecution().toString()


def both(spark, monkeypatch, df, f, k=5):
    """A query's rows by blocks and by the templates, and its plan by blocks."""
    text, engine = TEXT.format(f=f, k=k), Engine(spark)
    got = engine.sql(text, t=df)
    with monkeypatch.context() as m:
        m.setattr(Engine, "_vector_pairs", lambda *_: None)
        want = engine.sql(text, t=df)
    assert got.dtypes == want.dtypes
    return got, want


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("f", ["COSINE_DISTANCE", "EUCLIDEAN_DISTANCE"])
def test_blocks_give_what_the_templates_give(spark, monkeypatch, f, kind):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    draw = random.Random(3)
    rows = [[draw.gauss(0, 1) for _ in range(9)] for _ in range(30)]
    rows += [[v * (1 + 1e-6 * draw.random()) for v in r] for r in rows[:10]]  # cancels
    rows += rows[:5] + [[1e6 * v for v in rows[0]], [1e-6 * v for v in rows[1]], [2.0, 1.5], [0.5, 0.25], [1.00001, 1.000015]]
    rows += [None, None, [1.0, None, 2.0], [math.nan] * 9, [math.inf] + [1.0] * 8, [1e25] * 9, [1e-25] * 9, [0.000005, 0.0], [0.00001, 0.00001]]
    rows += [] if f == "COSINE_DISTANCE" else [[], [], [0.0] * 9]
    df = spark.createDataFrame([(i, r, f"n{i}" if i % 3 else None) for i, r in enumerate(rows)], f"id long, x array<{kind}>, note string")
    got, want = both(spark, monkeypatch, df, f)
    key = lambda r: repr((r.id, r.other, r.note, r.d))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "MapInArrow" in plan(got) and "MapInArrow" not in plan(want)


def test_a_zero_vector_has_no_cosine(spark, monkeypatch):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.0, 0.0], "b")], "id long, x array<double>, note string")
    for q in both(spark, monkeypatch, df, "COSINE_DISTANCE"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            q.collect()


def test_no_rows_give_no_pairs(spark, monkeypatch):
    df = spark.createDataFrame([], "id long, x array<double>, note string")
    assert [q.count() for q in both(spark, monkeypatch, df, "COSINE_DISTANCE")] == [0, 0]


def test_whole_query_goes_by_blocks(spark):
    got = catalog.queries()["fn_vector_distance_queries"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in plan(got) and "BroadcastNestedLoopJoin" not in plan(got)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a.id, COSINE_DISTANCE(a.x, b.x) AS d FROM {t} AS a CROSS JOIN {t} AS b",
        "SELECT a.id, ROUND(COSINE_DISTANCE(a.x, a.x), 5) AS d FROM {t} AS a CROSS JOIN {t} AS b",
        "SELECT a.id, ROUND(COSINE_DISTANCE(a.x, b.x), 5) AS d FROM {t} AS a CROSS JOIN {t} AS b WHERE a.id < b.id",
        "SELECT a.id + 1 AS i, ROUND(COSINE_DISTANCE(a.x, b.x), 5) AS d FROM {t} AS a CROSS JOIN {t} AS b",
        "SELECT a.x, ROUND(COSINE_DISTANCE(a.x, b.x), 5) AS d FROM {t} AS a CROSS JOIN {t} AS b",
    ],
)
def test_other_queries_stay_as_they_are(spark, text):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "id long, x array<double>")
    got = Engine(spark).sql(text, t=df)
    assert "MapInArrow" not in plan(got) and got.count() == (1 if "WHERE" in text else 4)
