"""Layers of voxels laid out by regions, and a store of edited cells that batches of edits are merged into.

A region is a square of cell columns.  Both layouts are partitioned by it (rx, rz), so a request reads the regions that it
names and no others.  The store keeps versions: a batch writes the whole state of the cells that it touches to a folder of its
own, and a cell's latest version holds.  A batch that is run again replaces its folder and merges with the versions before it,
so it leaves the same state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.storage import written
from .neighbors import FACES, dirty_cells, visible_faces
from .voxels import overlay_layers
from .world import rle_encode, to_cells

#: Cells of a region's side, as a power of two.
REGION_BITS = 2
#: Up to so many regions a request is sent to every task, which lets the scan skip the others; beyond, it is exchanged.
SEND_REGIONS = 100_000
CELL = ["cx", "cy", "cz"]
_WRITE = "off int, ts timestamp, event_id long, v int"
_VERSION = f"cx int, cy int, cz int, writes array<struct<{_WRITE}>>, rle array<int>, batch long, rx int, rz int"
_FACES = "cx int, cy int, cz int, x int, y int, z int, v int, face string, pass string, batch long, rx int, rz int"


def _region(cell: str) -> Column:
    return F.shiftright(F.col(cell), REGION_BITS)


def _with_regions(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"rx": _region("cx"), "rz": _region("cz")})


def in_regions(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (cx, cy, cz, rx, rz, ...) of the given cells; where rows are files partitioned by (rx, rz), only the files of
    these cells' regions are read."""
    # The comparison holds for every region of 32-bit places; only a filtered side may prune the other one's partitions.
    asked = _with_regions(cells.select(*CELL)).where(F.col("rx") >= -(1 << 29)).distinct()
    regions = asked.select("rx", "rz").distinct()
    few = regions.limit(SEND_REGIONS + 1).count() <= SEND_REGIONS
    found = rows.join(F.broadcast(regions) if few else regions, ["rx", "rz"], "left_semi")
    return found.join(asked.select(*CELL), CELL, "left_semi")


def write_layer(blocks: DataFrame, path: str) -> None:
    """Rows x, y, z, v by region, in order of their cells."""
    cells = blocks.select("x", "y", "z", "v", *(S.cell_of(c).alias(f"c{c}") for c in "xyz"))
    laid = _with_regions(cells).repartition("rx", "rz").sortWithinPartitions("rx", "rz", *CELL)
    laid.write.mode("overwrite").partitionBy("rx", "rz").parquet(path)


def read_layer(spark: SparkSession, path: str, cells: DataFrame | None = None) -> DataFrame:
    """x, y, z, v of a layer, within the given cells (cx, cy, cz) if there are any."""
    rows = spark.read.schema("x int, y int, z int, v int, cx int, cy int, cz int, rx int, rz int").parquet(path)
    return (rows if cells is None else in_regions(rows, cells)).select("x", "y", "z", "v")


def _versions(spark: SparkSession, path: str, schema: str, before: int | None, cells: DataFrame | None) -> DataFrame:
    """Rows of the versions before a batch; none where no batch has been written yet."""
    try:
        rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows if cells is None else in_regions(rows, cells)


def stored_cells(spark: SparkSession, path: str, before: int | None = None, cells: DataFrame | None = None) -> DataFrame:
    """cx, cy, cz, writes (the latest write of each voxel), rle (value + 1, 0 untouched) of the store's cells."""
    last = _versions(spark, path, _VERSION, before, cells).groupBy(*CELL).agg(F.max_by(F.struct("writes", "rle"), "batch").alias("last"))
    return last.select(*CELL, "last.*")


def stored_voxels(spark: SparkSession, path: str, before: int | None = None, cells: DataFrame | None = None) -> DataFrame:
    """x, y, z, v of the latest writes; v = 0 is a removed block."""
    return _placed(stored_cells(spark, path, before, cells).select(*CELL, F.explode("writes").alias("w")), F.col("w.off"), F.col("w.v"))


def _placed(rows: DataFrame, off: Column, v: Column) -> DataFrame:
    inside = {"x": off.bitwiseAND(15), "y": F.shiftright(off, 8), "z": F.shiftright(off, 4).bitwiseAND(15)}
    return rows.select(*((F.col(f"c{c}") * S.CELL + k).alias(c) for c, k in inside.items()), v.alias("v"))


def upsert_cells(edits: DataFrame, path: str, batch: int) -> None:
    """Merge edits (ts, event_id, x, y, z, v) into the store as the version ``batch``.

    The write of greatest (ts, event_id) holds for each voxel, in whatever order batches bring them.  Only the regions of the
    touched cells are read; a cell's row holds at most as many writes as a cell has voxels.  The edits are read once: their last
    writes are written first, and all that follows goes by these.
    """
    new = to_cells(edits.withColumn("v", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("v").cast("int").alias("v")))).select(*CELL, "off", "v.*")
    last = lambda rows: rows.groupBy(*CELL, "off").agg(F.max(F.struct("ts", "event_id", "v")).alias("w")).select(*CELL, "off", "w.*")
    new = written(last(new))
    old = stored_cells(edits.sparkSession, path, batch, new.select(*CELL).distinct())
    merged = last(old.select(*CELL, F.explode("writes").alias("w")).select(*CELL, "w.*").unionByName(new))
    writes = merged.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("off", "ts", "event_id", "v"))).alias("writes"))
    coded = rle_encode(merged.select(*CELL, "off", (F.col("v") + 1).alias("v")))
    _with_regions(writes.join(coded, CELL)).write.mode("overwrite").partitionBy("rx", "rz").parquet(f"{path}/batch={batch}")


def compact(spark: SparkSession, path: str, target: str, batch: int) -> None:
    """Write the state after ``batch`` to the new store ``target`` as that one version; later batches go there."""
    _with_regions(stored_cells(spark, path, batch + 1)).write.mode("overwrite").partitionBy("rx", "rz").parquet(f"{target}/batch={batch}")


def _and_beside(cells: DataFrame) -> DataFrame:
    around = F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(CELL, o))) for o in ((0, 0, 0), *FACES.values())))
    return cells.select(F.explode(around).alias("c")).select("c.*").distinct()


def update_faces(edits: DataFrame, layer: str, store: str, faces: str, batch: int, transparent: DataFrame, doors: DataFrame | None = None) -> None:
    """Faces of the cells that a batch of edits or their neighbours lie in, after ``upsert_cells`` of that batch, as the
    version ``batch`` of the table ``faces``.

    Voxels are read from the layer and the store within these cells and those beside them.  A dirty cell has a row without a
    face too, so that a version without faces replaces earlier ones.
    """
    spark = edits.sparkSession
    dirty = written(dirty_cells(edits))
    needed = _and_beside(dirty)
    voxels = overlay_layers(read_layer(spark, layer, needed), stored_voxels(spark, store, batch + 1, needed))
    seen = visible_faces(voxels, transparent, doors=doors, within=dirty)
    rows = seen.select(*(S.cell_of(c).alias(f"c{c}") for c in "xyz"), "x", "y", "z", "v", "face", "pass").unionByName(dirty, allowMissingColumns=True)
    _with_regions(rows).write.mode("overwrite").partitionBy("rx", "rz").parquet(f"{faces}/batch={batch}")


def stored_faces(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, v, face, pass of each cell's latest version."""
    rows = _versions(spark, path, _FACES, None, None)
    latest = rows.where("face IS NULL").groupBy(*CELL).agg(F.max("batch").alias("batch"))
    return rows.where("face IS NOT NULL").join(latest, [*CELL, "batch"], "left_semi").select("x", "y", "z", "v", "face", "pass")
