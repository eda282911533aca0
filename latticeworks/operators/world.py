"""Cells, run lengths, edits, ground, chunks and rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

CELL_SIZE = 4096


def last_write_wins(edits: DataFrame) -> DataFrame:
    return edits.groupBy("x", "y", "z").agg(F.max_by("v", F.struct("ts", "event_id")).alias("v"))


def valid_edits(edits: DataFrame, sessions: DataFrame) -> DataFrame:
    return edits.where("y <> 0").join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def to_cells(blocks: DataFrame) -> DataFrame:
    """cx, cy, cz, off, v of rows x, y, z, v."""
    return blocks.select(*(S.cell_of(c).alias(f"c{c}") for c in "xyz"), S.voxel_offset("x", "y", "z").alias("off"), "v")


def rle_encode(cells: DataFrame, size: int = CELL_SIZE) -> DataFrame:
    """Run lengths of dense cells from sparse rows (cx, cy, cz, off, v): runs of two or more as (n, v), singles as (-n, v1..vn).

    Only present offsets are rows; the gaps of zeros between them are runs of their own, so nothing is filled in.
    """
    key = ["cx", "cy", "cz"]
    w = Window.partitionBy(*key).orderBy("off")
    rows = cells.withColumn("next", F.coalesce(F.lead("off").over(w), F.lit(size))).withColumn("rn", F.row_number().over(w))
    gap = lambda a, n: F.struct(a.alias("off"), n.alias("n"), F.lit(0).alias("v"))
    parts = F.array(F.when((F.col("rn") == 1) & (F.col("off") > 0), gap(F.lit(0), F.col("off"))), F.struct("off", F.lit(1).alias("n"), F.col("v").cast("int").alias("v")), F.when(F.col("next") > F.col("off") + 1, gap(F.col("off") + 1, F.col("next") - F.col("off") - 1)))
    pieces = rows.select(*key, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select(*key, "p.*")
    runs = _islands(pieces, key, F.col("v") != F.lag("v").over(Window.partitionBy(*key).orderBy("off"))).groupBy(*key, "island").agg(F.min("off").alias("off"), F.sum("n").cast("int").alias("n"), F.first("v").alias("v"))
    single = F.col("n") == 1
    before = F.lag("n").over(Window.partitionBy(*key).orderBy("off")) == 1
    groups = _islands(runs.drop("island"), key, ~(single & before)).groupBy(*key, "island").agg(F.array_sort(F.collect_list(F.struct("off", "n", "v"))).alias("g"))
    code = F.when(F.get("g", 0)["n"] > 1, F.array(F.get("g", 0)["n"], F.get("g", 0)["v"])).otherwise(F.concat(F.array(-F.size("g")), F.col("g.v")))
    return groups.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("island", code.alias("code")))), lambda x: x["code"])).alias("rle"))


def _islands(rows: DataFrame, key: list[str], changes: Column) -> DataFrame:
    marked = rows.withColumn("new", F.coalesce(changes, F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("new").over(Window.partitionBy(*key).orderBy("off").rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _decoded(batches):
    """Rows of each value of run-length arrays, some 65,536 at a time."""
    for batch in batches:
        cells, rle = [batch.column(i).to_numpy() for i in range(3)], batch.column(3)
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        first = 0

        def rows(end: int) -> pa.RecordBatch:
            n = np.array(lengths)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.repeat(c[first:end], n) for c in cells] + [off, np.concatenate(parts) if parts else off]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=["cx", "cy", "cz", "off", "v"])

        for k in range(len(rle)):
            x, i, n = np.array(rle[k].as_py() or [], np.int64), 0, 0
            while i < len(x):
                head = int(x[i])
                part = np.repeat(x[i + 1 : i + 2], head) if head > 0 else x[i + 1 : i + 1 - head]
                i += 2 if head > 0 else 1 - head
                parts.append(part)
                n += len(part)
            lengths.append(n)
            if sum(lengths) >= 1 << 16 or k + 1 == len(rle):
                yield rows(k + 1)
                parts, lengths, first = [], [], k + 1


def rle_decode(cells: DataFrame) -> DataFrame:
    """cx, cy, cz, off, v for every value of ``rle``; a header of 0 is skipped.  Work follows the length of what it gives."""
    ints = cells.select(*(F.col(c).cast("int").alias(c) for c in ("cx", "cy", "cz")), F.col("rle").cast("array<int>").alias("rle"))
    return ints.mapInArrow(_decoded, "cx int, cy int, cz int, off int, v int")


def flat_ground(extent: DataFrame, ground_y: int = 4) -> DataFrame:
    """Bedrock (1) at 0, dirt (3) below ground_y and grass (2) at it, for extent rows (x0, x1, z0, z1)."""
    area = extent.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("z", F.explode(F.sequence("z0", "z1"))).select("x", "z").distinct()
    layers = area.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ground_y))))
    return layers.select("x", "y", "z", F.when(F.col("y") == 0, 1).when(F.col("y") == ground_y, 2).otherwise(3).alias("v"))


def footprint_ground(blocks: DataFrame, base_y: int = 4, margin: int = 4) -> DataFrame:
    """Grass under and around the building, two layers of dirt below its footprint's box."""
    box = blocks.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    # The rows along x are dealt to all tasks before each is spread along z.
    layer = lambda m, y, name: box.withColumn("x", F.explode(F.sequence(F.col("x0") - m, F.col("x1") + m))).repartition("x").withColumn("z", F.explode(F.sequence(F.col("z0") - m, F.col("z1") + m))).select("x", F.lit(y).alias("y"), "z", F.lit(name).alias("block"))
    return layer(margin, base_y - 1, "minecraft:grass_block").unionByName(layer(0, base_y - 2, "minecraft:dirt")).unionByName(layer(0, base_y - 3, "minecraft:dirt"))


def materialize_cells(cells: DataFrame, *layers: DataFrame) -> DataFrame:
    """The overlay of layers (x, y, z, v) within the requested cells (cx, cy, cz) only."""
    from .voxels import overlay_layers

    asked = cells.select("cx", "cy", "cz").distinct()
    inside = [df.withColumns({f"c{c}": S.cell_of(c) for c in "xyz"}).join(asked, ["cx", "cy", "cz"], "left_semi").select("x", "y", "z", "v") for df in layers]
    return overlay_layers(*inside)


def moved_up(blocks: DataFrame, base_y: int = 4) -> DataFrame:
    """Blocks moved to x, z >= 0 and y >= base_y."""
    low = blocks.agg(*(F.min(c).alias(f"m{c}") for c in "xyz"))
    return blocks.crossJoin(F.broadcast(low)).select((F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my") + base_y).alias("y"), (F.col("z") - F.col("mz")).alias("z"), "block")


def export_chunks(blocks: DataFrame, base_y: int = 4, ground: bool = True, section: int = 16) -> DataFrame:
    """rx, rz, cx, cz, section_y, palette, n, indices (offset and palette place) of blocks moved to x, z >= 0 and y >= base_y."""
    moved = moved_up(blocks, base_y)
    if ground:
        moved = moved.unionByName(footprint_ground(moved, base_y).where("x >= 0 AND z >= 0"))
    keyed = moved.select(S.chunk_of("x").alias("cx"), S.chunk_of("z").alias("cz"), F.floor(F.col("y") / section).cast("int").alias("section_y"), S.voxel_offset("x", "y", "z").alias("off"), "block")
    packed = keyed.groupBy("cx", "cz", "section_y").agg(F.array_sort(F.collect_set("block")).alias("palette"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("off", "block"))).alias("cells"))  # at most section * 256 blocks a group
    index = F.transform("cells", lambda c: F.struct(c["off"].alias("off"), (F.array_position("palette", c["block"]) - 1).cast("int").alias("p")))
    return packed.select(F.shiftright("cx", 5).alias("rx"), F.shiftright("cz", 5).alias("rz"), "cx", "cz", "section_y", "palette", "n", index.alias("indices"))


def unpack_chunks(chunks: DataFrame, section: int = 16) -> DataFrame:
    cell = chunks.select("cx", "cz", "section_y", "palette", F.explode("indices").alias("i"))
    off = F.col("i.off")
    return cell.select((F.col("cx") * 16 + off.bitwiseAND(15)).alias("x"), (F.col("section_y") * section + F.shiftright(off, 8)).alias("y"), (F.col("cz") * 16 + F.shiftright(off, 4).bitwiseAND(15)).alias("z"), F.get("palette", F.col("i.p")).alias("block"))


def save_world(edits: DataFrame, size: int = CELL_SIZE) -> DataFrame:
    """Run lengths of the edited cells' deltas (value + 1, 0 untouched); cells without any edit are absent."""
    return rle_encode(to_cells(last_write_wins(edits).withColumn("v", F.col("v") + 1)), size)


def state_signatures(blocks: DataFrame, props: list[str]) -> DataFrame:
    """Observed combinations of the given properties for each block name."""
    parsed = blocks.withColumn("base", S.strip_state("block")).withColumn("p", S.state_props("block"))
    sig = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.try_element_at("p", F.lit(k))) for k in props))
    return parsed.groupBy("base", sig.alias("signature")).agg(F.count("*").alias("n"))


def capability_checks(blocks: DataFrame, y_range: tuple[int, int] | None = None) -> DataFrame:
    """check, status, n: doors need both halves and a facing; shapes need their states."""
    rows = blocks.where(F.col("y").between(y_range[0], y_range[1] - 1)) if y_range else blocks
    rows = rows.select(S.strip_state("block").alias("base"), S.state_props("block").alias("p"))
    has = lambda k: F.try_element_at("p", F.lit(k))
    door, stair, slab = (F.col("base").endswith(e) for e in ("_door", "_stairs", "_slab"))
    one = rows.agg(
        F.count_if(door).alias("doors"), F.count_if(door & (has("half") == "lower")).alias("lower"), F.count_if(door & (has("half") == "upper")).alias("upper"), F.count_if(door & has("facing").isNotNull()).alias("faced"),
        F.count_if(stair).alias("stairs"), F.count_if(stair & has("facing").isNotNull()).alias("stairs_ok"), F.count_if(slab).alias("slabs"), F.count_if(slab & has("type").isNotNull()).alias("slabs_ok"),
    )
    shape = lambda n, ok: F.when(F.col(n) == 0, "absent").when(F.col(ok) == F.col(n), "present-valid").otherwise("present-broken")
    doors = F.when(F.col("doors") == 0, "absent").when((F.col("lower") > 0) & (F.col("upper") > 0) & (F.col("faced") > 0), "present-valid").otherwise("present-broken")
    entry = lambda name, status, n: F.struct(F.lit(name).alias("check"), status.alias("status"), F.col(n).alias("n"))
    return one.select(F.explode(F.array(entry("doors", doors, "doors"), entry("stairs", shape("stairs", "stairs_ok"), "stairs"), entry("slabs", shape("slabs", "slabs_ok"), "slabs"))).alias("c")).select("c.*")


def round_trip_check(blocks: DataFrame, path: str) -> DataFrame:
    """Capability checks of blocks that were exported to chunks, written, read and unpacked again, and how many of them were
    lost or added on the way."""
    export_chunks(blocks, ground=False).write.mode("overwrite").partitionBy("rx", "rz").parquet(path)
    sent, back = moved_up(blocks), unpack_chunks(blocks.sparkSession.read.parquet(path))
    both = sent.withColumn("n", F.lit(1)).unionByName(back.withColumn("n", F.lit(-1))).groupBy("x", "y", "z", "block").agg(F.sum("n").alias("n"))
    differ = both.agg(*(F.coalesce(F.sum(F.greatest(sign * F.col("n"), F.lit(0))), F.lit(0)).alias(name) for name, sign in (("lost", 1), ("added", -1))))
    entry = lambda name: F.struct(F.lit(name).alias("check"), F.when(F.col(name) == 0, "same").otherwise("differs").alias("status"), F.col(name).alias("n"))
    return capability_checks(back).unionByName(differ.select(F.explode(F.array(entry("lost"), entry("added"))).alias("c")).select("c.*"))


def z_buffer(points: DataFrame, value: str = "value") -> DataFrame:
    """Per pixel (px, py) the value of greatest (depth, y, x, z)."""
    return points.groupBy("px", "py").agg(F.max_by(value, F.struct("depth", "y", "x", "z")).alias(value))


def raster_ortho(blocks: DataFrame, view: str, pad: int = 2) -> DataFrame:
    """px, py, r, g, b of rows x, y (up), z, r, g, b seen from above (plan), the front or the side."""
    h, v, depth = {"plan": ("x", "z", F.col("y")), "front": ("x", "y", -F.col("z")), "side": ("z", "y", -F.col("x"))}[view]
    p = blocks.withColumn("depth", depth)
    box = p.agg(F.min(h).alias("h0"), F.min(v).alias("v0"), F.max(v).alias("v1"), F.min("depth").alias("d0"), F.max("depth").alias("d1"))
    p = p.crossJoin(F.broadcast(box)).withColumns({"px": F.col(h) - F.col("h0") + pad, "py": F.col("v1") - F.col(v) + pad})
    s = S.shade("depth", F.col("d0"), F.col("d1"))
    return z_buffer(p.withColumn("value", F.struct(*(F.floor(F.col(c) * s).cast("int").alias(c) for c in "rgb")))).select("px", "py", "value.*")


def raster_iso(blocks: DataFrame, scale: int = 1, pad: int = 4) -> DataFrame:
    sx, sy = F.col("x") - F.col("z"), (F.col("x") + F.col("z")) / 2 - F.col("y")
    p = blocks.withColumns({"sx": sx, "sy": sy, "depth": F.col("x") + F.col("y") + F.col("z")})
    box = p.agg(F.min("sx").alias("x0"), F.min("sy").alias("y0"), F.min("depth").alias("d0"), F.max("depth").alias("d1"))
    p = p.crossJoin(F.broadcast(box)).withColumns({"px": F.rint(F.col("sx") - F.col("x0")).cast("int") + pad, "py": F.rint(F.col("sy") - F.col("y0")).cast("int") + pad})
    s = S.shade("depth", F.col("d0"), F.col("d1"), 0.5)
    out = z_buffer(p.withColumn("value", F.struct(*(F.floor(F.col(c) * s).cast("int").alias(c) for c in "rgb")))).select("px", "py", "value.*")
    if scale == 1:
        return out
    for c in ("px", "py"):
        out = out.withColumn(c, F.explode(F.sequence(F.col(c) * scale, F.col(c) * scale + scale - 1)))
    return out
