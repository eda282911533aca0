"""Profiles of models: types, scale, materials, meshes, storeys, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import dims
from .voxels import classify, drop_non_solid


def type_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("ifc_type").agg(F.count("*").alias("n"), F.count_if("has_representation").alias("n_represented"), F.count_if(F.col("ifc_type").isin(dims.EXCLUDED_TYPES)).alias("n_excluded"), F.count_if(F.col("ifc_type").isin(dims.DOOR_TYPES)).alias("n_doors"))


def top_types(counts: DataFrame, k: int = 40) -> DataFrame:
    return counts.orderBy(F.desc("n"), "ifc_type").limit(k)


def row_numbers(df: DataFrame, order: str, name: str) -> DataFrame:
    """df and each row's number by order, from 1.  The rows are sorted by ranges, and the ranges' counts (one row a partition)
    are summed, so no single task sorts all rows.  The ranged rows are cut off with checkpoint(): range bounds are sampled, and
    two exchanges of one table may draw them differently."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = local.groupBy("_part").agg(F.count("*").alias("_size")).withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0))).select("_part", "_base")
    return local.join(F.broadcast(base), "_part").withColumn(name, F.col("_rn") + F.col("_base")).drop("_part", "_rn", "_base")


def systematic_sample(df: DataFrame, order: str, max_samples: int = 40) -> DataFrame:
    """Every step-th row by order, step = max(1, n // (4 * max)), those with geometry, the first max; a sampling operator."""
    step = max(1, df.count() // (4 * max_samples))
    chosen = row_numbers(df, order, "_number").where((F.col("_number") - 1) % step == 0)
    return chosen.where("has_representation").drop("_number").orderBy(order).limit(max_samples)


def geometry_scale(sample: DataFrame, value: str) -> DataFrame:
    """Count, greatest and exact median of the largest coordinate of sampled elements, and the unit they suggest."""
    one = sample.agg(F.count(value).alias("n"), F.max(value).cast("double").alias("greatest"), F.percentile(value, F.lit(0.5)).alias("median"))
    return one.withColumn("unit", F.when(F.col("median") < 5000, "METRES").otherwise("MILLIMETRES"))


def dominant_material(faces: DataFrame) -> DataFrame:
    """Per element the material of most faces (ids from 0 on); ties: the one seen first."""
    counts = faces.where("material_id >= 0").groupBy("element_id", "material_id").agg(F.count("*").alias("n"), F.min("face_no").alias("first"))
    return counts.groupBy("element_id").agg(F.max_by("material_id", F.struct("n", -F.col("first"), -F.col("material_id"))).alias("material_id"))


def material_name_counts(named: DataFrame, k_names: int = 25, k_type: int = 3) -> DataFrame:
    """The most common names overall, and of each type; rows scope, key, name, n."""
    overall = named.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k_names).select(F.lit("all").alias("scope"), F.lit("").alias("key"), "name", "n")
    by_type = named.groupBy("ifc_type", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("ifc_type").orderBy(F.desc("n"), "name"))
    top = by_type.withColumn("rn", rank).where(F.col("rn") <= k_type).select(F.lit("type").alias("scope"), F.col("ifc_type").alias("key"), "name", "n")
    return overall.unionByName(top)


def mesh_summary(meshes: DataFrame) -> DataFrame:
    """meshes: mesh_id, n_vertices, n_faces, and low and high of x, y, z; a mesh without vertices or faces is skipped, and
    doesn't count in the bounds."""
    ok = F.coalesce((F.col("n_vertices") > 0) & (F.col("n_faces") > 0), F.lit(False))
    ends = [f(F.when(ok, F.col(f"{end}_{c}"))).alias(f"{name}_{c}") for c in "xyz" for name, f, end in (("min", F.min, "low"), ("max", F.max, "high")) if f"{end}_{c}" in meshes.columns]
    return meshes.agg(F.count("*").alias("total"), F.count_if(ok).alias("converted"), F.count_if(~ok).alias("skipped"), F.sum(F.when(ok, F.col("n_vertices"))).alias("vertices"), F.sum(F.when(ok, F.col("n_faces"))).alias("faces"), *ends)


def storeys_by_elevation(storeys: DataFrame) -> DataFrame:
    return storeys.orderBy(F.asc_nulls_last("elevation"), "name")


def datasets_by_size(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("count", "name")


def listed(rows: DataFrame, key: str) -> DataFrame:
    """One row, ``key``: the values (of a bounded set) and their numbers of rows as (name, n), the most frequent first."""
    counts = rows.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"))
    return counts.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["k"]).alias("n"))).alias(key))


def run_summary(flags: dict[str, object] | None = None, **aggregates: DataFrame) -> DataFrame:
    """One nested record: flags as they are, and of each one-row aggregate a struct, or its only column if that is a list."""
    out = None
    for name, df in aggregates.items():
        alone = len(df.columns) == 1 and df.dtypes[0][1].startswith("array")
        one = df.select((F.col(f"`{df.columns[0]}`") if alone else F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.select(*(F.lit(v).alias(k) for k, v in (flags or {}).items()), "*")


def inspect_model(elements: DataFrame, storeys: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """elements, the commonest types, storeys, the scale of sampled elements, and the metres of the model's unit (its prefix)."""
    counts = type_counts(elements)
    one = lambda df, *aggs: df.agg(*aggs)
    top = one(top_types(counts), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "ifc_type", "n"))).alias("types"))
    scale, unit = geometry_scale(systematic_sample(elements, "element_id"), value), one(elements, F.max(S.unit_factor(F.lit(prefix))).alias("metres"))
    return run_summary(elements=one(elements, F.count("*").alias("n"), F.count_if("has_representation").alias("n_represented")), top=top.withColumn("n", F.size("types")), storeys=one(storeys, F.count("*").alias("n"), F.min("elevation").alias("lowest")), scale=scale, unit=unit)


def solid_faces(elements: DataFrame, faces: DataFrame, class_dim: DataFrame, exclude_dim: DataFrame) -> DataFrame:
    """cls, n_faces of the solid elements; doors, excluded elements and those without geometry have none."""
    solid = drop_non_solid(classify(elements, class_dim), exclude_dim)[0]
    return faces.select("element_id").join(solid.select("element_id", "cls"), "element_id").groupBy("cls").agg(F.count("*").alias("n_faces"))


def material_colours(elements: DataFrame, faces: DataFrame, materials: DataFrame, k_names: int = 25, k_type: int = 3) -> DataFrame:
    """scope, key, name, r, g, b, n: the names of most elements' dominant materials overall (no colour), the (name, colour) of
    most elements of each type, and one row 'with' of how many elements have materials.

    materials: element_id, material_id, name, r, g, b (0 to 1, null without a colour); colours are rounded to two places.
    """
    of = dominant_material(faces).join(materials, ["element_id", "material_id"]).join(elements.select("element_id", "ifc_type"), "element_id")
    of = of.withColumns({c: F.round(c, 2) for c in "rgb"})
    plain = [F.lit(None).cast("double").alias(c) for c in "rgb"]
    overall = of.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k_names).select(F.lit("all").alias("scope"), F.lit("").alias("key"), "name", *plain, "n")
    rank = Window.partitionBy("ifc_type").orderBy(F.desc("n"), "name", *"rgb")
    by_type = of.groupBy("ifc_type", "name", *"rgb").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k_type)
    having = materials.agg(F.count_distinct("element_id").alias("n")).select(F.lit("with").alias("scope"), F.lit("").alias("key"), F.lit("").alias("name"), *plain, "n")
    return overall.unionByName(by_type.select(F.lit("type").alias("scope"), F.col("ifc_type").alias("key"), "name", *"rgb", "n")).unionByName(having)


def rejected_meshes(meshes: DataFrame, k: int = 50) -> DataFrame:
    """The first k meshes (by mesh_id) that ``mesh_summary`` skips, with the reason: a report of a stated length."""
    none = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    error = F.when(none("n_vertices"), "no vertices").when(none("n_faces"), "no faces")
    return meshes.withColumn("error", error).where("error IS NOT NULL").orderBy("mesh_id").limit(k)
