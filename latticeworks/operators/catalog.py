"""Recipes over crafting grids, and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import row_numbers


def recipe_bom(recipes: DataFrame) -> DataFrame:
    return recipes.where("item IS NOT NULL").groupBy("ordinal", "output", "item").agg(F.count("*").alias("n"))


def _signature(cells: DataFrame, key: list[str], mirrored: bool = False) -> DataFrame:
    """One text for a grid's filled cells, relative to their bounding box; mirrored: columns reversed."""
    box = cells.where("item IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", "c", "item"))).alias("s"), F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    column = (lambda x: F.col("c1") - x["c"]) if mirrored else (lambda x: x["c"] - F.col("c0"))
    parts = F.array_sort(F.transform("s", lambda x: F.concat_ws(":", (x["r"] - F.col("r0")).cast("string"), column(x).cast("string"), x["item"])))
    return box.select(*key, F.array_join(parts, "|").alias("signature"))


def match_shaped(slots: DataFrame, recipes: DataFrame) -> DataFrame:
    """grid_id, output: the first shaped recipe (or its mirror image) that equals the grid's filled cells."""
    shaped, key = recipes.where("NOT shapeless"), ["ordinal", "output"]
    known = _signature(shaped, key).unionByName(_signature(shaped.where("mirrored"), key, True)).distinct()
    return _signature(slots, ["grid_id"]).join(F.broadcast(known), "signature").groupBy("grid_id").agg(F.min_by("output", "ordinal").alias("output"))


def match_shapeless(slots: DataFrame, recipes: DataFrame) -> DataFrame:
    """grid_id, output: the first shapeless recipe with as many ingredients as filled slots, each of them in the grid."""
    needs = recipes.where("shapeless AND item IS NOT NULL")
    total = needs.groupBy("ordinal", "output").agg(F.count("*").alias("size"), F.countDistinct("item").alias("kinds"))
    filled = slots.where("item IS NOT NULL")
    found = filled.select("grid_id", "item").distinct().join(F.broadcast(needs.select("ordinal", "output", "item").distinct()), "item").groupBy("grid_id", "ordinal", "output").agg(F.count("*").alias("hits"))
    sizes = filled.groupBy("grid_id").agg(F.count("*").alias("filled"))
    ok = found.join(F.broadcast(total), ["ordinal", "output"]).where("hits = kinds").join(sizes, "grid_id").where("size = filled")
    return ok.groupBy("grid_id").agg(F.min_by("output", "ordinal").alias("output"))


def assign_ids(names: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Dense ids from 1 in the order given."""
    return row_numbers(names, ordinal, "id")


def search_registry(registry: DataFrame, pattern: str) -> DataFrame:
    """registry: ordinal, name, kind (block or item).  Without a pattern: all items, and blocks but for the first two."""
    if not pattern:
        return registry.where((F.col("kind") == "item") | (F.col("ordinal") > 2))
    return registry.where(F.col("name").rlike(pattern))
