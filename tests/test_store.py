"""The store of edited cells, layers by regions, faces kept over edits, and block tables as a data source."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import cell_store as C
from latticeworks.operators import neighbors as N
from latticeworks.operators import voxels as V
from latticeworks.operators import world as W
from latticeworks.sources import scan

EDIT = "event_id long, ts timestamp, x int, y int, z int, v int"
START = dt.datetime(2024, 1, 1)


def _edit(i, minute, x, y, z, v):
    return (i, START + dt.timedelta(minutes=minute), x, y, z, v)


def _batches(rng, n=3, size=40, spread=20):
    """Edits around one corner of cells, late ones and ties of time among them, and one voxel in every batch."""
    out = []
    for b in range(n):
        rows = [_edit(b * 1000 + i, rng.randrange(60), rng.randrange(-spread, spread), rng.randrange(0, 20), rng.randrange(-spread, spread), rng.randrange(0, 4)) for i in range(size)]
        out.append(rows + [_edit(b * 1000 + 900, 100 - b, 1, 1, 1, b)])
    return out


def _world(df):
    return {(r.cx, r.cy, r.cz): list(r.rle) for r in df.collect()}


def test_store_equals_saved_world_over_batches_and_a_replay(spark, tmp_path):
    path, batches = f"{tmp_path}/store", _batches(random.Random(1))
    frames = [spark.createDataFrame(b, EDIT) for b in batches]
    for i, df in enumerate(frames):
        C.upsert_cells(df, path, i)
        everything = spark.createDataFrame(sum(batches[: i + 1], []), EDIT)
        assert _world(C.stored_cells(spark, path)) == _world(W.save_world(everything))
    for again in (2, 1, 2):  # a batch that comes again changes nothing
        C.upsert_cells(frames[again], path, again)
        assert _world(C.stored_cells(spark, path)) == _world(W.save_world(everything))
    C.compact(spark, path, f"{tmp_path}/small", 2)
    assert _world(C.stored_cells(spark, f"{tmp_path}/small")) == _world(W.save_world(everything))
    C.upsert_cells(spark.createDataFrame([_edit(5000, 500, 1, 1, 1, 9)], EDIT), f"{tmp_path}/small", 3)
    assert C.stored_voxels(spark, f"{tmp_path}/small").where("x = 1 AND y = 1 AND z = 1").first().v == 9


def _scans(plan):
    """File scans of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "FileSourceScanExec":
        return [plan]
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    if inner is not None:
        return _scans(inner)
    children = plan.children()
    return sum((_scans(children.apply(i)) for i in range(children.size())), [])


def test_requests_read_their_regions_only(spark, tmp_path):
    rows = spark.range(0, 64 * 64 * 2).select((F.col("id") % 64 * 16).cast("int").alias("x"), F.lit(1).alias("y"), ((F.col("id") / 64).cast("int") % 64 * 16).cast("int").alias("z"), F.lit(3).alias("v")).distinct()
    C.write_layer(rows, f"{tmp_path}/layer")
    asked = spark.createDataFrame([(0, 0, 0), (5, 0, 9), (500, 0, 0)], "cx int, cy int, cz int")
    got = C.read_layer(spark, f"{tmp_path}/layer", asked)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r.x, r.z) for r in got.collect()} == {(0, 0), (80, 144)}
    files = {s.metrics().apply("numFiles").value() for s in _scans(got._jdf.queryExecution().executedPlan())}
    assert max(files) <= 4  # of 16 x 16; both regions are counted each time that the scan is planned


def _faces(df):
    return {tuple(r) for r in df.select("x", "y", "z", "v", "face", "pass").collect()}


def test_faces_over_edits_equal_faces_from_scratch(spark, tmp_path):
    rng = random.Random(3)
    blocks = {(x, y, z): rng.randrange(1, 5) for x in range(-20, 20, 1) for y in range(3) for z in range(12, 20) if rng.random() < 0.6}
    layer = spark.createDataFrame([(*k, v) for k, v in blocks.items()], "x int, y int, z int, v int")
    clear, doors = spark.createDataFrame([(1,), (2,), (3,)], "v int"), spark.createDataFrame([(2, "x", False), (3, "x", True)], "v int, axis string, open boolean")
    C.write_layer(layer, f"{tmp_path}/layer")
    seen = []
    for b, edits in enumerate(_batches(rng, 3, 8)):
        df = spark.createDataFrame(edits, EDIT)
        C.upsert_cells(df, f"{tmp_path}/store", b)
        C.update_faces(df, f"{tmp_path}/layer", f"{tmp_path}/store", f"{tmp_path}/faces", b, clear, doors)
        seen += edits
        now = V.overlay_layers(layer, W.last_write_wins(spark.createDataFrame(seen, EDIT)))
        dirty = N.dirty_cells(spark.createDataFrame(seen, EDIT))
        want = N.visible_faces(now, clear, doors=doors).withColumns({f"c{c}": F.shiftright(c, 4) for c in "xyz"}).join(dirty, ["cx", "cy", "cz"], "left_semi")
        assert _faces(C.stored_faces(spark, f"{tmp_path}/faces")) == _faces(want)


def test_a_batch_is_read_once_for_the_store_and_once_for_faces(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(x):
        reads.add(1)
        return x

    batch = _batches(random.Random(5), 1)[0]
    df = spark.createDataFrame(batch, EDIT).withColumn("x", F.udf(counted, "int").asNondeterministic()("x"))
    C.write_layer(spark.createDataFrame([(0, 0, 0, 1)], "x int, y int, z int, v int"), f"{tmp_path}/layer")
    C.upsert_cells(df, f"{tmp_path}/store", 0)
    assert reads.value == len(batch)
    C.update_faces(df, f"{tmp_path}/layer", f"{tmp_path}/store", f"{tmp_path}/faces", 0, spark.createDataFrame([(1,)], "v int"))
    assert reads.value == 2 * len(batch)


def test_door_panels(spark):
    rows = spark.createDataFrame([(0, 0, 0, 2), (1, 0, 0, 1), (0, 0, 5, 3), (0, 0, 9, 4)], "x int, y int, z int, v int")
    clear, doors = spark.createDataFrame([(2,), (3,), (4,)], "v int"), spark.createDataFrame([(2, "x", False), (3, "x", True), (4, "z", False)], "v int, axis string, open boolean")
    got = _faces(N.visible_faces(rows, clear, doors=doors))
    assert {t for t in got if t[3] != 1} == {(0, 0, 0, 2, f, "opaque") for f in ("east", "west")} | {(0, 0, 5, 3, f, "transparent") for f in ("north", "south")} | {(0, 0, 9, 4, f, "opaque") for f in ("north", "south")}
    assert len([t for t in got if t[3] == 1]) == 6  # a door beside it is seen through


def test_faces_beside_cells_that_are_not_loaded(spark):
    rows = spark.createDataFrame([(0, 0, 0, 9), (0, 0, 5, 1)], "x int, y int, z int, v int")
    cells = spark.createDataFrame([(0, 0, 0)], "cx int, cy int, cz int")
    got = {(t[3], t[4]) for t in _faces(N.visible_faces(rows, spark.createDataFrame([(1,)], "v int"), cells))}
    assert got == {(9, f) for f in N.FACES} | {(1, f) for f in ("east", "up", "north", "south")}


def _rows(df):
    return sorted((r.x, r.y, r.z, r.block) for r in df.collect())


@pytest.mark.parametrize("split", [None, 7, 40])
def test_block_tables(spark, tmp_path, split):
    door = "minecraft:oak_door[facing=east,half=lower]"
    files = {
        "a.csv": f"x,y,z,block\n1,2,3,{door}\n4,5,6,\n\n-7,8,9,stone\n",
        "b.csv": f'Block, z ,y,x\r\n"{door}",3,2,1\r\n"say ""hi""",0,0,-1\r\n',
        "c.csv": f"z,note,block,x,y\n3,n,{door},1,2\n3,n, b ,2,2",
        "d.csv": "z,y,x\n1,2,3",
        "_SUCCESS": "",
        "e.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    df = scan.scan_blocks(spark, str(tmp_path), "dirt")
    if split:
        df = spark.read.format("block_table").option("default", "dirt").option("split", split).load(f"file://{tmp_path}")
    want = [(1, 2, 3, door), (4, 5, 6, "dirt"), (-7, 8, 9, "stone"), (1, 2, 3, door), (-1, 0, 0, 'say "hi"'), (1, 2, 3, door), (2, 2, 3, "b"), (3, 2, 1, "dirt")]
    assert _rows(df) == sorted(want)


@pytest.mark.parametrize("text, error", [("", "no block rows"), ("x,y,z\n", "no block rows"), ("x,y,block\n1,2,a\n", "must have columns")])
def test_block_tables_without_rows_or_columns_are_refused(spark, tmp_path, text, error):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(Exception, match=error):
        scan.scan_blocks(spark, f"{tmp_path}/t.csv").collect()


def test_run_lengths_of_long_and_broken_cells(spark):
    rows = spark.createDataFrame([(0, 0, 0, [4096, 7]), (1, 0, 0, [-2, 5, 6, 0, 3, 1]), (2, 0, 0, []), (3, 0, 0, [2]), (4, 0, 0, None)], "cx int, cy int, cz int, rle array<int>")
    got = {}
    for r in W.rle_decode(rows).orderBy("cx", "off").collect():
        got.setdefault(r.cx, []).append(r.v)
    assert got == {0: [7] * 4096, 1: [5, 6, 1, 1, 1]}
