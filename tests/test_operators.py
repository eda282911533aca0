"""Hand-made goldens and the comparison of every query with its SQL on the smallest tables."""

import zlib

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from latticeworks.operators import neighbors as N
from latticeworks.operators import profile as P
from latticeworks.operators import voxels as V
from latticeworks.operators import world as W
from latticeworks.plans import dims, registry
from latticeworks.plans.inputs import with_views
from latticeworks.sources import scan

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


def _plain(x):
    return None if x is None else round(x, 6) + 0.0 if isinstance(x, float) else int(x) if isinstance(x, bool) else x if isinstance(x, (int, str)) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def _hits(spark, rows):
    return spark.createDataFrame(rows, "x int, y int, z int, cls string")


def test_later_class_wins(spark):
    hits = _hits(spark, [(0, 0, 0, "glass"), (0, 0, 0, "wall"), (1, 0, 0, "glass"), (1, 0, 0, "railing"), (2, 0, 0, "other"), (2, 0, 0, "wall"), (3, 0, 0, "unknown")])
    got = {r.x: r.cls for r in V.resolve_priority(hits, dims.table(spark, "priority_dim")).collect()}
    assert got == {0: "wall", 1: "railing", 2: "other", 3: "other"}


def test_ramp_turns_east_but_for_its_top(spark):
    rows = spark.createDataFrame([(i, 0, i, dims.STAIR_CUBE) for i in range(4)], "x int, y int, z int, block string")
    got = {r.x: r.block for r in N.orient_stairs(rows).collect()}
    assert all("facing=east" in got[i] for i in range(3)) and got[3] == dims.STAIR_CUBE


def test_hinges_of_runs(spark):
    rows = spark.createDataFrame([(0, y, 0, "east") for y in (0, 2, 3, 10, 11, 12)], "x int, y int, z int, facing string")
    got = {r.y: r.hinge for r in N.mirror_double_doors(rows).collect()}
    assert got == {0: "left", 2: "right", 3: "left", 10: "right", 11: "left", 12: "left"}


@pytest.mark.parametrize("values", [[5], [1, 2, 2], [0, 0, 0, 7, 8, 7, 7], [3, 3, 3, 3], [1, 2, 3]])
def test_run_lengths_invert(spark, values):
    rows = spark.createDataFrame([(0, 0, 0, i, v) for i, v in enumerate(values) if v] or [(0, 0, 0, 0, 0)], "cx int, cy int, cz int, off int, v int")
    coded = W.rle_encode(rows, len(values))
    assert [r.v for r in W.rle_decode(coded).orderBy("off").collect()] == values
    if values == [1, 2, 2]:
        assert coded.first().rle == [-1, 1, 2, 2]


def test_hollow_box_is_filled(spark):
    shell = [(x, y, z) for x in range(4) for y in range(4) for z in range(4) if {x, y, z} & {0, 3}]
    got = {tuple(r) for r in N.fill_enclosed(spark.createDataFrame(shell, "x int, y int, z int")).collect()}
    assert got == {(x, y, z) for x in (1, 2) for y in (1, 2) for z in (1, 2)}


def test_stream_throttle_equals_batch(spark):
    q = registry.queries()
    assert {tuple(r) for r in q["stream_throttle"](spark, SF).collect()} == {(r[0], int(r[1])) for r in q["throttle"](spark, SF).collect()}


def test_numbers_by_ranges_have_no_gaps(spark, tmp_path):
    """Large enough for sampled range bounds; other columns must not deal the counts by other bounds."""
    spark.range(400_000).select(F.xxhash64("id").alias("k"), F.lit("x").alias("w")).write.parquet(f"{tmp_path}/t")
    numbered = P.row_numbers(spark.read.parquet(f"{tmp_path}/t"), "k", "n")
    rows = numbered.select("k", "n", "w", (F.col("k") > F.lag("k").over(Window.orderBy("n"))).alias("rises"))
    got = rows.agg(F.countDistinct("n"), F.min("n"), F.max("n"), F.count_if(~F.col("rises")), F.max("w")).first()
    assert tuple(got) == (400_000, 1, 400_000, 0, "x")


def test_faces_of_one_large_class(spark):
    meshes = spark.range(100_000).select(F.lit("a").alias("cls"), F.col("id").alias("mesh_id"), (F.col("id") % 3).alias("n_vertices"))
    faces = meshes.select("mesh_id", F.lit(0).alias("face_no"), *(F.lit(k).alias(c) for k, c in enumerate("ijk")))
    wrong = V.reindex_faces(meshes, faces).where("i <> mesh_id div 3 * 3 + CASE mesh_id % 3 WHEN 2 THEN 1 ELSE 0 END OR j <> i + 1 OR k <> i + 2")
    assert wrong.count() == 0


def _doors(spark, width, y1):
    """A door in a wall along y over a floor at z = 0."""
    floor = spark.createDataFrame([(x, y, 0, 4, "floor", "f") for x in (4, 6) for y in range(8)], "x int, y int, z int, prio int, cls string, block string")
    box = spark.createDataFrame([(1, 5, 3, 1, 5, y1, 2, width)], "element_id long, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int, width double")
    return {(r.x, r.y, r.z): r.block for r in N.place_doors(floor, box, 1.0).where("x = 5").collect()}


def test_single_door(spark):
    state = "minecraft:oak_door[facing=east,half={},hinge=left,open=false]"
    assert _doors(spark, 0.9, 3) == {(5, 3, 0): dims.FLOOR_CUBE, (5, 3, 1): state.format("lower"), (5, 3, 2): state.format("upper")}


def test_double_door(spark):
    got = _doors(spark, 1.8, 4)
    assert len(got) == 6 and all("hinge=right" in got[5, 3, z] and "hinge=left" in got[5, 4, z] for z in (1, 2))


def test_safe_name_equals_brute_force(spark):
    for r in registry.queries()["safe_name"](spark, SF).join(spark.read.parquet(f"{SF}/supplier.parquet"), "s_suppkey").collect():
        other = f"Player{zlib.crc32(str(r.s_suppkey).encode()) % 10000:04d}"
        assert r["name"] == (r.s_name if r.s_suppkey % 3 else other)


def test_run_summary_equals_its_parts(spark, duck):
    got = registry.queries()["run_summary"](spark, SF).first().asDict(recursive=True)
    sql = registry.oracle_sql()
    for part, name in (("size", "footprint"), ("server", "server_info")):
        rel = duck.sql(sql[name].replace("*0.5", "*1.0"))
        assert got[part] == dict(zip(rel.columns, rel.fetchall()[0]))
    low = duck.sql(with_views("SELECT min(x), max(x), min(y), max(y), min(z), max(z) FROM voxels")).fetchall()[0]
    assert set(low) <= set(got["bounds"].values())


def test_inspect_model_equals_its_parts(spark, duck):
    got = registry.queries()["inspect_model"](spark, SF).first().asDict(recursive=True)
    n, shown = duck.sql(with_views("SELECT count(*), count(*) FILTER (has_representation) FROM elements")).fetchall()[0]
    assert got["elements"] == {"n": n, "n_represented": shown}
    types = duck.sql(with_views("SELECT ifc_type, count(*) AS n FROM elements GROUP BY ifc_type ORDER BY n DESC, ifc_type LIMIT 40")).fetchall()
    assert [(t["ifc_type"], t["n"]) for t in got["top"]["types"]] == types
    assert tuple(got["storeys"].values()) == duck.sql(with_views("SELECT count(*), min(elevation) FROM storeys")).fetchall()[0]
    rel = duck.sql(registry.oracle_sql()["geometry_scale"])
    assert got["scale"] == dict(zip(rel.columns, rel.fetchall()[0]))


def test_elements_without_a_column_are_refused(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "element_id").write.parquet(f"{tmp_path}/e")
    with pytest.raises(ValueError, match="ifc_type"):
        scan.scan_elements(spark, f"{tmp_path}/e")


def test_autosave_equals_saved_world(spark):
    q = registry.queries()
    assert {tuple(r) for r in q["autosave"](spark, SF).collect()} == {tuple(r) for r in q["save_world"](spark, SF).select("cx", "cy", "cz", "rle").collect()}


def test_lost_and_added_blocks_are_counted(spark, tmp_path, monkeypatch):
    blocks = spark.createDataFrame([(x, 0, 0, "minecraft:stone") for x in range(4)], "x int, y int, z int, block string")
    real = W.unpack_chunks
    monkeypatch.setattr(W, "unpack_chunks", lambda chunks: real(chunks).where("x > 0").withColumn("block", F.when(F.col("x") == 3, "b").otherwise(F.col("block"))))
    got = {r.check: (r.status, r.n) for r in W.round_trip_check(blocks, f"{tmp_path}/c").collect()}
    assert got["lost"] == ("differs", 2) and got["added"] == ("differs", 1)
