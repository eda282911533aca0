"""Voxel tables: overlap, bounds, coordinates, names, styles, surface lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import dims


def classify(elements: DataFrame, class_dim: DataFrame, default: str = "other") -> DataFrame:
    return elements.join(F.broadcast(class_dim), "ifc_type", "left").withColumn("cls", F.coalesce("cls", F.lit(default)))


def drop_non_solid(elements: DataFrame, exclude_dim: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Solids, doors and excluded elements; elements without geometry are in none."""
    shaped = elements.where("has_representation")
    excluded = shaped.join(F.broadcast(exclude_dim), "ifc_type", "left_semi")
    kept = shaped.join(F.broadcast(exclude_dim), "ifc_type", "left_anti")
    is_door = F.col("ifc_type").isin(dims.DOOR_TYPES)
    return kept.where(~is_door), kept.where(is_door), excluded


def resolve_priority(hits: DataFrame, priority_dim: DataFrame) -> DataFrame:
    """Per cell the class latest in the priority list; an unknown class ranks as 'other'."""
    known = hits.drop("prio").join(F.broadcast(priority_dim.select("cls", "prio")), "cls", "left")
    last = F.coalesce("prio", F.lit(len(dims.CLASS_PRIORITY) - 1))
    top = known.groupBy("x", "y", "z").agg(F.max(last).alias("prio"))
    return top.join(F.broadcast(priority_dim), "prio").select("x", "y", "z", "prio", "cls", "block")


def class_voxel_counts(hits: DataFrame, priority_dim: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct cells of each class before overlaps are resolved; 0 for classes without any."""
    cells = hits.select("cls", "x", "y", "z")
    counts = cells.groupBy("cls").agg(F.approx_count_distinct(F.struct("x", "y", "z")).alias("n")) if approx else cells.distinct().groupBy("cls").agg(F.count("*").alias("n"))
    return priority_dim.select("cls").join(F.broadcast(counts), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n_voxels"))


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(S.strip_state("block").alias("block")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "block")


def bounds(df: DataFrame, *cols: str) -> DataFrame:
    aggs = [f(c).alias(f"{name}_{c}") for c in cols for name, f in (("min", F.min), ("max", F.max))]
    return df.agg(*aggs).select("*", *((F.col(f"max_{c}") + 1).alias(f"dim_{c}") for c in cols))


def _shift(df: DataFrame, cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    offset = df.agg(*(F.min(c).alias(f"offset_{c}") for c in cols))
    return df.crossJoin(F.broadcast(offset)), offset  # one row


def to_y_up(voxels: DataFrame) -> DataFrame:
    """(x, y, z up) to (x, z, -y), shifted to start at 0."""
    turned = voxels.withColumns({"y": F.col("z"), "z": -F.col("y")})
    moved, _ = _shift(turned, ("x", "y", "z"))
    return moved.withColumns({c: F.col(c) - F.col(f"offset_{c}") for c in "xyz"}).drop("offset_x", "offset_y", "offset_z")


def to_y_up_swap(voxels: DataFrame) -> DataFrame:
    """(x, y, z) to (x, z, y): a mirror image."""
    return voxels.withColumns({"y": F.col("z"), "z": F.col("y")})


def normalize_origin(blocks: DataFrame, preserve: bool = False) -> tuple[DataFrame, DataFrame]:
    moved, offset = _shift(blocks, ("x", "y", "z"))
    if preserve:
        return blocks, offset.select(*(F.lit(0).alias(f"offset_{c}") for c in "xyz"))
    return moved.withColumns({c: F.col(c) - F.col(f"offset_{c}") for c in "xyz"}).drop("offset_x", "offset_y", "offset_z"), offset


def center_offset(blocks: DataFrame, base_y: int = 5) -> DataFrame:
    most = blocks.agg(F.max("x").alias("mx"), F.max("z").alias("mz"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    return blocks.crossJoin(F.broadcast(most)).withColumns({"x": F.col("x") - half("mx"), "z": F.col("z") - half("mz"), "y": F.col("y") + base_y}).drop("mx", "mz")


def height_slice(blocks: DataFrame, v: int) -> DataFrame:
    return blocks.where(F.col("y") < v)


def visible_categories(blocks: DataFrame, styles: DataFrame, hidden: list[str]) -> DataFrame:
    return style_blocks(blocks, styles).where(~F.col("category").isin(hidden))


def style_blocks(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    named = blocks.withColumn("base", S.strip_state("block"))
    out = named.join(F.broadcast(styles.withColumnRenamed("block", "base")), "base", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(("category", "r", "g", "b", "opacity"), dims.DEFAULT_STYLE)})


def remap_blocks(blocks: DataFrame, mapping: DataFrame, default: str = "stone") -> DataFrame:
    """Target name of each block; doors turn into door_x or door_z by their facing; ``mapped`` tells known names."""
    named = blocks.withColumn("base", S.strip_state("block")).join(F.broadcast(mapping.withColumnRenamed("block", "base")), "base", "left")
    is_door = F.col("base").endswith("_door")
    return named.withColumn("mapped", is_door | F.col("target").isNotNull()).withColumn("target", F.when(is_door, S.door_axis("block")).otherwise(F.coalesce("target", F.lit(default))))


def unmapped_names(remapped: DataFrame) -> DataFrame:
    return remapped.where("NOT mapped").groupBy("base").agg(F.count("*").alias("n")).orderBy("base")


def registry_ids(blocks: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known rows with the numeric id of their target, and the number of skipped rows for each unknown name."""
    joined = blocks.join(F.broadcast(registry), blocks.target == registry.name, "left")
    return joined.where("id IS NOT NULL").drop("name"), joined.where("id IS NULL").groupBy("target").agg(F.count("*").alias("n"))


def merge_default_state(blocks: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry default properties overlaid by explicit ones, and unknown names; registry: base, defaults map."""
    parsed = blocks.withColumn("base", S.strip_state("block")).withColumn("own", S.state_props("block"))
    joined = parsed.join(F.broadcast(registry), "base", "left")
    kept = F.map_filter("defaults", lambda k, _: ~F.array_contains(F.map_keys("own"), k))
    known = joined.where("defaults IS NOT NULL").withColumn("props", F.map_concat(kept, "own"))
    return known.drop("own", "defaults"), joined.where("defaults IS NULL").groupBy("base").agg(F.count("*").alias("n"))


def nearest_palette(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """For each colour the palette block of least squared Lab distance, within its glass or opaque part; ties: the earlier entry.

    Distinct colours are matched first.  The palette has some forty rows, so its product with the colours is linear.
    """
    lab = lambda df, c: df.withColumn("lab", S.srgb_to_lab(*c))
    seen = lab(colors.select("r", "g", "b", "glass").distinct(), ("r", "g", "b"))
    entries = lab(palette, ("pr", "pg", "pb")).select("glass", "block", "ordinal", F.col("lab").alias("plab"))
    d2 = sum(F.pow(F.col(f"lab.{c}") - F.col(f"plab.{c}"), 2) for c in "lab")
    near = seen.join(F.broadcast(entries), "glass").groupBy("r", "g", "b", "glass").agg(F.min_by("block", F.struct(F.round(d2, 6), "ordinal")).alias("block"))
    return colors.join(near, ["r", "g", "b", "glass"])


def chunk_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(S.chunk_of("x").alias("cx"), S.chunk_of("z").alias("cz")).agg(F.count("*").alias("n")).select("cx", "cz", S.region_of(F.col("cx") * 16).alias("rx"), S.region_of(F.col("cz") * 16).alias("rz"), "n")


def footprint(blocks: DataFrame, pitch: float) -> DataFrame:
    size = blocks.agg(*((F.max(c) + 1).alias(c) for c in "xyz"), F.count("*").alias("total"))
    return size.select(*(S.half_up(F.col(c) * pitch).alias(f"size_{c}") for c in "xyz"), "total")


def column_top(blocks: DataFrame, y_max: int) -> DataFrame:
    return blocks.where(F.col("y").between(1, y_max)).groupBy("x", "z").agg(F.max("y").alias("top"))


def voxelize_surface(triangles: DataFrame, pitch: float, origin: tuple[float, float, float], k_max: int = 12) -> DataFrame:
    """Distinct lattice cells that the surfaces of triangles touch, for each class.

    A triangle is split into n x n parts, n the power of two that brings its longest edge to half a pitch; the corners of
    the parts are snapped.  Where n is over 2**k_max, the triangle is first split into pieces of 2**k_max x 2**k_max parts.
    Blocks of rows with some 4,096 corners are dealt out, so a large triangle is shared and a small one is one row; triangles
    of one class and place are split once.
    """
    def edge(p, q):
        return S.distance(*((f"{p}{c}", f"{q}{c}") for c in "xyz"))

    k = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(edge("a", "b"), edge("b", "c"), edge("a", "c"), F.lit(1e-12)) * 2 / pitch)))
    corners = triangles.select("cls", *(f"{p}{c}" for p in "abc" for c in "xyz"))
    sized = corners.withColumn("k", k).withColumns({"n": F.pow(2, F.least(F.lit(k_max), "k")).cast("int"), "pieces": F.pow(2, F.greatest(F.lit(0), F.col("k") - k_max)).cast("int")})
    # Piece (p, q) has its corners at p and q pieces along both edges; a turned one is the other half of that parallelogram.
    lines = sized.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    pieces = lines.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1 - F.col("p"))))
    pieces = pieces.withColumn("turned", F.explode(F.when(F.col("p") + F.col("q") < F.col("pieces") - 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    step = F.greatest(F.lit(1), (4096 / F.col("n")).cast("int"))
    blocks = pieces.withColumn("i0", F.explode(F.sequence(F.lit(0), "n", step))).distinct()
    rows = blocks.withColumn("i", F.explode(F.sequence("i0", F.least(F.col("n"), F.col("i0") + step - 1))))
    points = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("i"))))

    def share(piece: str, step: str) -> Column:
        """Along an edge, of its whole length."""
        n, at = F.col("n").cast("long"), F.col(piece).cast("long")
        return F.when(F.col("turned"), (at + 1) * n - F.col(step)).otherwise(at * n + F.col(step)) / (n * F.col("pieces"))

    def cell(c: str, o: float) -> Column:
        v = F.col(f"a{c}") + share("p", "i") * (F.col(f"b{c}") - F.col(f"a{c}")) + share("q", "j") * (F.col(f"c{c}") - F.col(f"a{c}"))
        return F.greatest(F.lit(0), F.rint((F.rint(v / pitch) * pitch - o) / pitch)).cast("int").alias(c)

    return points.select("cls", *(cell(c, o) for c, o in zip("xyz", origin))).distinct()


def group_offsets(groups: DataFrame) -> DataFrame:
    """Exclusive running sum of counts, largest group first; one row for each block name."""
    w = Window.orderBy(F.desc("n"), "block").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def overlay_layers(*layers: DataFrame) -> DataFrame:
    """Per cell the value of the last layer that has one; empty (0) cells are dropped.  Layers: x, y, z, v."""
    ranked = [df.select("x", "y", "z", F.col("v").cast("int").alias("v"), F.lit(i).alias("layer")) for i, df in enumerate(layers)]
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy("x", "y", "z").agg(F.max_by("v", F.struct("layer", "v")).alias("v")).where("v <> 0")


def concat_meshes(*meshes: DataFrame) -> DataFrame:
    out = meshes[0]
    for m in meshes[1:]:
        out = out.unionByName(m)
    return out


def reindex_faces(meshes: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertex numbers moved by the vertex counts of the meshes before, within a class.  meshes: cls, mesh_id, n_vertices.

    Meshes are dealt by ranges of class and id; a class adds the sums of its ranges before (one row a range and class).
    """
    ranged = meshes.select("cls", "mesh_id", "n_vertices").repartitionByRange("cls", "mesh_id").withColumn("part", F.spark_partition_id()).checkpoint()
    within = Window.partitionBy("cls", "part").orderBy("mesh_id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("cls", "part").agg(F.sum("n_vertices").alias("n")).select("cls", "part", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("before"))
    base = ranged.withColumn("own", F.coalesce(F.sum("n_vertices").over(within), F.lit(0))).join(before, ["cls", "part"]).select("mesh_id", "cls", (F.col("own") + F.col("before")).alias("base"))
    return faces.join(base, "mesh_id").select("cls", "mesh_id", "face_no", *((F.col(c) + F.col("base")).alias(c) for c in "ijk"))


def palette_colours(blocks: DataFrame, palette: DataFrame) -> DataFrame:
    """blocks with is_glass (the name is in the glass palette) and r, g, b (of either palette, else the default colour).

    palette: block, glass, pr, pg, pb, some dozen rows; a name with a state is in no palette.
    """
    of = palette.groupBy("block").agg(F.bool_or("glass").alias("is_glass"), *(F.min_by(f"p{c}", "glass").alias(c) for c in "rgb"))
    out = blocks.join(F.broadcast(of), "block", "left").withColumn("is_glass", F.coalesce("is_glass", F.lit(False)))
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip("rgb", dims.DEFAULT_STYLE[1:4])})
