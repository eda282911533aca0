"""Fixed dictionaries as small DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What each element type, class and block stands for, in the order that decides ties.
SEMANTIC_CLASSES = {"IfcWindow": "glass", "IfcPlate": "glass", "IfcCurtainWall": "glass", "IfcMember": "frame", "IfcRailing": "railing", "IfcWall": "wall", "IfcWallStandardCase": "wall", "IfcColumn": "structure", "IfcBeam": "structure", "IfcSlab": "floor", "IfcCovering": "floor", "IfcRoof": "roof", "IfcStair": "stair", "IfcStairFlight": "stair", "IfcRamp": "stair", "IfcRampFlight": "stair"}
EXCLUDED_TYPES = ["IfcOpeningElement", "IfcSpace", "IfcAnnotation", "IfcGrid", "IfcSite"]
DOOR_TYPES = ["IfcDoor"]
CLASS_PRIORITY = ["glass", "railing", "frame", "roof", "floor", "stair", "structure", "wall", "other"]
CLASS_BLOCKS = {"glass": "minecraft:light_blue_stained_glass", "frame": "minecraft:gray_concrete", "railing": "minecraft:oak_fence", "wall": "minecraft:white_concrete", "structure": "minecraft:stone", "floor": "minecraft:smooth_stone", "roof": "minecraft:deepslate_tiles", "stair": "minecraft:stone_bricks", "other": "minecraft:light_gray_concrete"}
TARGET_NAMES = {"minecraft:white_concrete": "hardened_clay_stained_white", "minecraft:smooth_stone": "stone", "minecraft:stone": "stone", "minecraft:gray_concrete": "hardened_clay_stained_gray", "minecraft:light_blue_stained_glass": "glass_light_blue", "minecraft:iron_bars": "iron_block", "minecraft:stone_bricks": "stonebrick", "minecraft:deepslate_tiles": "stone_andesite", "minecraft:light_gray_concrete": "hardened_clay_stained_silver", "minecraft:oak_planks": "planks_oak"}
BLOCK_STYLES = {"minecraft:white_concrete": ("Walls", 207, 213, 214, 1.0), "minecraft:smooth_stone": ("Floors / slabs", 159, 159, 159, 1.0), "minecraft:stone": ("Columns / structure", 127, 127, 127, 1.0), "minecraft:gray_concrete": ("Curtain-wall framing", 70, 74, 80, 1.0), "minecraft:light_blue_stained_glass": ("Glazing", 96, 196, 226, 0.45), "minecraft:oak_door": ("Doors (functional)", 168, 120, 60, 1.0), "minecraft:oak_planks": ("Doors", 168, 134, 80, 1.0), "minecraft:iron_bars": ("Railings", 170, 175, 182, 0.85), "minecraft:stone_bricks": ("Stairs / ramps", 128, 127, 128, 1.0), "minecraft:deepslate_tiles": ("Roof", 64, 64, 72, 1.0), "minecraft:light_gray_concrete": ("Other", 150, 150, 140, 1.0)}
DEFAULT_STYLE = ("Other", 190, 120, 120, 1.0)
OPAQUE_PALETTE = {"white_concrete": (207, 213, 214), "light_gray_concrete": (125, 125, 115), "gray_concrete": (54, 57, 61), "black_concrete": (8, 10, 15), "cyan_concrete": (21, 119, 136), "light_blue_concrete": (35, 137, 198), "blue_concrete": (44, 46, 143), "brown_concrete": (96, 60, 32), "red_concrete": (142, 33, 33), "orange_concrete": (224, 97, 1), "yellow_concrete": (240, 175, 21), "lime_concrete": (94, 169, 24), "green_concrete": (73, 91, 36), "pink_concrete": (213, 101, 143), "smooth_stone": (159, 159, 159), "stone": (127, 127, 127), "stone_bricks": (122, 122, 122), "deepslate_tiles": (60, 60, 66), "polished_andesite": (132, 134, 133), "polished_diorite": (188, 188, 189), "smooth_quartz": (235, 229, 222), "sandstone": (216, 203, 156), "bricks": (150, 97, 83), "terracotta": (152, 94, 67), "white_terracotta": (209, 178, 161), "light_gray_terracotta": (135, 107, 98), "oak_planks": (162, 130, 78), "spruce_planks": (114, 84, 48), "dark_oak_planks": (66, 43, 20), "iron_block": (220, 220, 220)}
GLASS_PALETTE = {"glass": (200, 220, 230), "white_stained_glass": (236, 240, 240), "light_gray_stained_glass": (153, 153, 153), "gray_stained_glass": (76, 76, 76), "light_blue_stained_glass": (102, 153, 216), "cyan_stained_glass": (76, 127, 153), "blue_stained_glass": (51, 51, 178), "green_stained_glass": (102, 127, 51), "lime_stained_glass": (127, 204, 25), "brown_stained_glass": (102, 76, 51), "black_stained_glass": (25, 25, 25)}
STAIR_CUBE, FLOOR_CUBE, DOOR_BLOCK = "minecraft:stone_bricks", "minecraft:smooth_stone", "minecraft:oak_door"
STAIR_SHAPED, SLAB_SHAPED = "minecraft:stone_brick_stairs", "minecraft:smooth_stone_slab[type=bottom]"
DEFAULT_BLOCK = "minecraft:stone"

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "class_dim": ("ifc_type string, cls string", list(SEMANTIC_CLASSES.items())),
    "exclude_dim": ("ifc_type string", [(t,) for t in EXCLUDED_TYPES]),
    "priority_dim": ("cls string, prio int, block string", [(c, i, CLASS_BLOCKS[c]) for i, c in enumerate(CLASS_PRIORITY)]),
    "name_dim": ("block string, target string", list(TARGET_NAMES.items())),
    "style_dim": ("block string, category string, r int, g int, b int, opacity double", [(k, *v) for k, v in BLOCK_STYLES.items()]),
    "palette_dim": ("block string, glass boolean, ordinal int, pr int, pg int, pb int", [(f"minecraft:{k}", g, i, *v) for g, p in ((False, OPAQUE_PALETTE), (True, GLASS_PALETTE)) for i, (k, v) in enumerate(p.items())]),
    # A few recipes over the items of the craft_slots view: shaped ones by rows (null: empty), shapeless ones by ingredients.
    "recipe_dim": ("ordinal int, output string, shapeless boolean, mirrored boolean, r int, c int, item string", [(o, out, sl, mi, r, c, item) for o, (out, sl, mi, grid) in enumerate([("stick", False, False, [["planks_oak"], ["planks_oak"]]), ("planks_pair", False, False, [["planks_oak", "planks_oak"]]), ("stone_row", False, False, [["cobblestone", "cobblestone", "cobblestone"]]), ("iron_row", False, False, [["iron_ingot", "iron_ingot"]]), ("kit", True, False, [["stick", "iron_ingot"]]), ("blend", True, False, [["cobblestone", "planks_oak"]]), ("hook", False, True, [["stick", "iron_ingot"]])]) for r, row in enumerate(grid) for c, item in enumerate(row)]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)


def sql(name: str) -> str:
    """A common table expression with the same rows."""
    schema, rows = TABLES[name]
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"{name}({names}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"
