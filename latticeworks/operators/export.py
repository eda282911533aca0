"""Writers and exports of block tables, grouped points, stamps, samples, catalogues and saves; the composite pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.storage import written
from . import neighbors as N
from . import profile as P
from . import voxels as V
from . import world as W


def write_blocks(blocks: DataFrame, path: str, fmt: str = "csv") -> None:
    rows = blocks.select("x", "y", "z", "block")
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    else:
        rows.withColumns({"rx": F.shiftright("x", 9), "rz": F.shiftright("z", 9)}).write.mode("overwrite").partitionBy("rx", "rz").parquet(path)


def export_grouped_points(blocks: DataFrame, styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (block, category, colour, n, offset), the largest first, and points with their group's offset."""
    groups = V.group_offsets(V.block_counts(blocks))
    points = blocks.withColumn("block", F.substring_index("block", "[", 1)).join(groups.select("block", "offset"), "block")
    return V.style_blocks(groups, styles).drop("base"), points.select("offset", "x", "y", "z")


def export_world_stamp(blocks: DataFrame, mapping: DataFrame, base_y: int = 5) -> DataFrame:
    """name, x, y, z under the target names, centred on the ground."""
    return V.center_offset(V.remap_blocks(blocks, mapping), base_y).select(F.col("target").alias("name"), "x", "y", "z")


def write_world_stamp(stamp: DataFrame, path: str, points: int = 4096) -> None:
    """Lines of JSON, each with some points of one name, so that no name's points meet in one row."""
    part = stamp.withColumn("k", F.pmod(F.xxhash64("x", "y", "z"), F.lit(points)))
    rows = part.groupBy("name", "k").agg(F.collect_list(F.array("x", "y", "z")).alias("p"))
    rows.select(F.to_json(F.struct(F.create_map("name", "p").alias("blocks"))).alias("value")).write.mode("overwrite").text(path)


def export_sample_json(blocks: DataFrame, n: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The first n records by position (a sampling operator) and one row: count, truncated."""
    return blocks.orderBy("x", "y", "z").limit(n), blocks.agg(F.count("*").alias("count"), (F.count("*") > n).alias("truncated"))


def write_dataset_catalog(catalog: DataFrame, path: str) -> None:
    P.datasets_by_size(catalog).write.mode("overwrite").json(path)


def write_saved_deltas(saved: DataFrame, path: str) -> None:
    """Lines of JSON, each with one cell's run lengths."""
    cell = F.concat_ws(",", "cx", "cy", "cz")
    saved.select(F.to_json(F.struct(F.create_map(cell, "rle").alias("deltas"))).alias("value")).write.mode("overwrite").text(path)


@dataclass
class Model:
    """A building: elements (element_id, ifc_type, has_representation), their triangles (element_id, face_no, ax .. cz), and the
    boxes of its doors (element_id, x0 .. z1, width), in one unit of length."""

    elements: DataFrame
    triangles: DataFrame
    doors: DataFrame


@dataclass
class Made:
    """What ``run_pipeline`` made by name, the counts of what it has written, and one row that sums it up."""

    tables: dict[str, DataFrame]
    counts: dict[str, int]
    summary: DataFrame


def counted_write(df: DataFrame, save: Callable[[DataFrame], None]) -> int:
    """Save df and return how many rows that wrote, counted on the way; save must not sort by ranges, which runs df twice."""
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def lattice_origin(model: Model) -> tuple[float, float, float]:
    """The lowest corner of all triangles and doors (one row)."""
    corners = model.triangles.agg(*(F.min(F.least(*(f"{p}{c}" for p in "abc"))).alias(c) for c in "xyz")).unionByName(model.doors.agg(*(F.min(f"{c}0").cast("double").alias(c) for c in "xyz")))
    low = corners.agg(*(F.min(c).alias(c) for c in "xyz")).first()
    return tuple(low[c] or 0.0 for c in "xyz")


def door_cells(doors: DataFrame, pitch: float, origin: tuple[float, float, float]) -> DataFrame:
    """Doors' boxes in lattice cells, inclusive, with the facing that their sizes before snapping give."""
    snapped = {f"{c}{k}": F.greatest(F.lit(0), F.rint((F.col(f"{c}{k}") - o) / pitch)).cast("int") for c, o in zip("xyz", origin) for k in "01"}
    facing = S.door_facing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("facing")
    return doors.select("element_id", "width", facing, *(v.alias(k) for k, v in snapped.items()))


def run_pipeline(model: Model, class_dim: DataFrame, exclude_dim: DataFrame, priority_dim: DataFrame, style_dim: DataFrame, pitch: float, out: str, door_mode: str = "functional", slabs: bool = False, web: bool = True, preview: bool = True, metre: float = 1.0) -> Made:
    """Triangles of solid elements to voxels, with doors and stairs, written once and fanned out to exports.

    Excluded elements and doors aren't voxelized; all lie on one lattice from the model's lowest corner.  ``pitch`` is in the
    model's unit, of which ``metre`` make a metre.
    """
    solid, doors, excluded = V.drop_non_solid(V.classify(model.elements, class_dim), exclude_dim)
    origin = lattice_origin(model)
    triangles = model.triangles.drop("cls").join(solid.select("element_id", "cls"), "element_id")
    hits = written(V.voxelize_surface(triangles, pitch, origin))
    boxes = door_cells(model.doors.join(doors.select("element_id"), "element_id", "left_semi").withColumn("width", F.col("width") / metre), pitch, origin)
    # Doors, stairs and slabs each name their voxels several times, so what they start from is made once.
    voxels = written(V.resolve_priority(hits, priority_dim))
    shaped = N.orient_stairs(written(N.place_doors(voxels, boxes, pitch / metre, door_mode)))
    shaped = N.thin_floor_slabs(shaped) if slabs else shaped
    n = counted_write(V.to_y_up(shaped.select("x", "y", "z", "block")), lambda df: write_blocks(df, f"{out}/blocks", "parquet"))
    blocks = hits.sparkSession.read.parquet(f"{out}/blocks").select("x", "y", "z", "block")
    tables = {"counts": V.block_counts(blocks), "chunks": W.export_chunks(blocks)}
    if web:
        tables["groups"], tables["points"] = export_grouped_points(blocks, style_dim)
    if preview:
        styled = V.style_blocks(blocks, style_dim).select("x", "y", "z", "r", "g", "b")
        tables |= {v: W.raster_ortho(styled, v) for v in ("plan", "front", "side")} | {"iso": W.raster_iso(styled, 2)}
    flags = {"pitch": pitch, "door_mode": door_mode, "slabs": slabs, "web": web, "preview": preview}
    summary = P.run_summary(
        flags, elements=P.listed(solid.unionByName(doors), "ifc_type"), excluded=P.listed(excluded, "ifc_type"), faces=P.listed(triangles, "cls"), voxels=P.listed(hits, "cls"),
        blocks=P.listed(blocks.withColumn("block", S.strip_state("block")), "block"), bounds=V.bounds(blocks, "x", "y", "z"), doors=boxes.agg(F.count("*").alias("n")),
    )
    return Made({"blocks": blocks} | tables, {"blocks": n}, summary)


def write_outputs(made: Made, out: str, pitch: float, name: str = "run") -> DataFrame:
    """Write all that ``run_pipeline`` made but hasn't written, the catalogue, the summary and the manifest of the outputs: output,
    format, count of its rows.  Rows are counted while they are written and never read again."""
    spark, counts = made.summary.sparkSession, dict(made.counts)
    for output, df in made.tables.items():
        if output not in counts:
            counts[output] = counted_write(df, lambda rows, output=output: rows.write.mode("overwrite").parquet(f"{out}/{output}"))
    catalog = spark.createDataFrame([(name, name, counts["blocks"], pitch)], "name string, label string, count long, pitch double")
    counts["catalog"] = counted_write(P.datasets_by_size(catalog), lambda rows: rows.write.mode("overwrite").json(f"{out}/catalog"))
    made.summary.write.mode("overwrite").json(f"{out}/summary")
    manifest = spark.createDataFrame([(k, "json" if k == "catalog" else "parquet", n) for k, n in counts.items()], "output string, format string, count long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return manifest


def stamp_summary(blocks: DataFrame, mapping: DataFrame, base_y: int = 5, skip_prefixes: list[str] | None = None) -> DataFrame:
    """One row about ``export_world_stamp``: offset, dims, total, skipped (blocks of the prefixes), counts by target name, the
    greatest first, and the names that have no target."""
    skipped = F.lit(False)
    for p in skip_prefixes or []:
        skipped = skipped | F.startswith("block", F.lit(p))
    size = blocks.agg(*((F.max(c) + 1).alias(f"dim_{c}") for c in "xyz"), F.count_if(~skipped).alias("total"), F.count_if(skipped).alias("skipped"))
    size = size.withColumns({"offset_x": -F.floor((F.col("dim_x") - 1) / 2), "offset_y": F.lit(base_y), "offset_z": -F.floor((F.col("dim_z") - 1) / 2)})
    named = V.remap_blocks(blocks.where(~skipped), mapping)
    counts = P.listed(named, "target").select(F.col("target").alias("counts"))  # a dictionary's names
    unmapped = V.unmapped_names(named).agg(F.sort_array(F.collect_list("base")).alias("unmapped"))
    return size.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(unmapped))
