"""Joins of rows that are spread to cells: nothing spread is broadcast, and places that many rows share are tried once."""

import random

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import neighbors as N


def _points(rng, n, names):
    return [(i, *(float(rng.randrange(0, 12)) / 2 for _ in names)) for i in range(n)]


def _frames(spark, n=60):
    rng = random.Random(3)
    entities = _points(rng, n, "xyz")
    players = [(1000 - i, 7 * i % 61, *p) for i, *p in _points(rng, n, "xyz")]
    return entities, players, spark.createDataFrame(entities, "entity_id long, ex double, ey double, ez double"), spark.createDataFrame(players, "player_id long, ordinal long, px double, py double, pz double")


def _free(df):
    return df.selectExpr("*", "'survival' AS mode", "false AS show_inventory", "0L AS pickup_delay")


def _d(e, p, eye=0.0):
    return ((e[1] - p[2]) ** 2 + (e[2] - (p[3] - eye)) ** 2 + (e[3] - p[4]) ** 2) ** 0.5


def _spread(spark, name):
    """A query whose source is small enough to be broadcast."""
    e = spark.range(60).selectExpr("id AS entity_id", *(f"cast(id % {k} as double) AS e{c}" for c, k in zip("xyz", (7, 5, 3))))
    p = spark.range(60).selectExpr("id AS player_id", "id AS ordinal", *(f"cast(id % {k} as double) AS p{c}" for c, k in zip("xyz", (7, 5, 3))))
    voxels = spark.range(400).selectExpr("cast(id % 9 as int) AS x", "cast(id % 7 as int) AS y", "cast(id % 5 as int) AS z", "2 AS v", "0 AS prio", "'a' AS cls", "'b' AS block")
    blasts = spark.range(20).selectExpr("id AS blast_id", "cast(id % 9 as int) AS bx", "cast(id % 7 as int) AS by", "cast(id % 5 as int) AS bz", "2 AS radius")
    boxes = spark.range(3).selectExpr("id AS element_id", *(f"cast(id as int) AS {c}0" for c in "xyz"), *(f"cast(id + 3 as int) AS {c}1" for c in "xyz"))
    ids = e.select(F.col("entity_id").alias("id"), *(F.col(f"e{c}").alias(c) for c in "xyz"))
    return {
        "floor_probe": lambda: N.floor_probe(voxels.selectExpr("x + 10 * y AS leaf_id", "x", "y", "z", "'east' AS facing"), voxels),
        "pickups": lambda: N.pickups(e, _free(p), 10),
        "radius_join": lambda: N.radius_join(e, p, 1.5),
        "explode_radius": lambda: N.explode_radius(voxels, blasts),
        "surviving_entities": lambda: N.in_blasts(ids, blasts),
        "carve_openings": lambda: N.carve_openings(voxels, boxes),
    }[name]()


@pytest.mark.parametrize("name", ["floor_probe", "pickups", "radius_join", "explode_radius", "surviving_entities", "carve_openings"])
def test_spread_rows_are_exchanged(spark, name):
    joins = [line for line in _spread(spark, name)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "NestedLoop" not in line]
    assert any("SortMergeJoin" in line for line in joins)  # the join on cells


def test_places_that_rows_share_are_tried_once(spark):
    entities, players, e, p = _frames(spark, 200)
    near = spark.createDataFrame([(q[0], i) for i, q in enumerate(players)], "player_id long, ordinal long").join(p.drop("ordinal"), "player_id")
    order = {q[0]: i for i, q in enumerate(players)}
    want = {a[0]: min((order[q[0]], q[0]) for q in players if _d(a, q) < 1.1)[1] for a in entities if any(_d(a, q) < 1.1 for q in players)}
    assert {r.entity_id: r.player_id for r in N.radius_join(e, near, 1.1).collect()} == want
    # Each place has one row before it is joined, on both sides.
    twice = e.unionByName(e.withColumn("entity_id", F.col("entity_id") + 10_000))
    places = N._near_places(twice, p.groupBy("px", "py", "pz").agg(F.count("*").alias("n")), 1.1, 1.1)
    assert places.count() == places.select("ex", "ey", "ez", "px", "py", "pz").distinct().count()
    got = {r.entity_id: (r.player_id, r.action) for r in N.pickups(twice, _free(near), 10).collect()}
    for a in entities:
        picked = [order[q[0]] for q in players if _d(a, q, N.EYE) < 0.6]
        pulled = [order[q[0]] for q in players if _d(a, q, N.EYE) < 1.5]
        said = (players[min(picked)][0], "pick") if picked else (players[max(pulled)][0], "pull") if pulled else None
        assert got.get(a[0]) == got.get(a[0] + 10_000) == said


def test_entities_and_blasts_of_one_place_survive_together(spark):
    ids = spark.range(3000).selectExpr("id", "cast(id % 3 as double) * 20 AS x", "0.0D AS y", "0.0D AS z")
    blasts = spark.range(3000).selectExpr("id AS blast_id", "20 AS bx", "0 AS by", "0 AS bz", "cast(id % 2 as int) + 1 AS radius")
    out = N.surviving_entities(ids, blasts)
    assert {r.id % 3 for r in out.collect()} == {0, 2} and out.count() == 2000
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()  # before the join


def test_triangles_of_one_place_are_split_once(spark):
    from latticeworks.operators import voxels as V

    corners = {"a": (0, 0, 0), "b": (200, 0, 0), "c": (0, 3, 0)}
    one = spark.range(50).select(F.col("id").alias("element_id"), F.lit(0).alias("face_no"), F.lit("wall").alias("cls"), *(F.lit(float(v)).alias(f"{p}{c}") for p, at in corners.items() for c, v in zip("xyz", at)))
    many, few = (V.voxelize_surface(df, 1.0, (0.0, 0.0, 0.0)) for df in (one, one.limit(1)))
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in few.collect()} and few.count() > 201
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # rows of corners aren't exchanged with their element
    assert plan.count("Aggregate") == 2  # triangles, then cells
