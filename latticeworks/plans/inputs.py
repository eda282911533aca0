"""Views over the given tables that serve as elements, voxels, edits, sessions and grids; one text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import dims

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
VIEWS = {
    "elements": """SELECT p_partkey AS element_id,
  CASE p_partkey % 18 WHEN 0 THEN 'IfcWindow' WHEN 1 THEN 'IfcPlate' WHEN 2 THEN 'IfcCurtainWall' WHEN 3 THEN 'IfcMember' WHEN 4 THEN 'IfcRailing'
    WHEN 5 THEN 'IfcWall' WHEN 6 THEN 'IfcWallStandardCase' WHEN 7 THEN 'IfcColumn' WHEN 8 THEN 'IfcBeam' WHEN 9 THEN 'IfcSlab' WHEN 10 THEN 'IfcCovering'
    WHEN 11 THEN 'IfcRoof' WHEN 12 THEN 'IfcStair' WHEN 13 THEN 'IfcRamp' WHEN 14 THEN 'IfcDoor' WHEN 15 THEN 'IfcSpace' WHEN 16 THEN 'IfcOpeningElement' ELSE 'IfcFurniture' END AS ifc_type,
  p_name AS name, p_brand AS material, p_partkey % 10 <> 3 AS has_representation,
  (p_partkey*37)%480 AS x0, (p_partkey*53)%400 AS y0, (p_partkey*11)%120 AS z0, 1+p_size%12 AS dx, 1+(p_partkey*7)%30 AS dy, 2+(p_partkey*5)%28 AS dz FROM part""",
    "voxel_hits": """SELECT CAST(l_partkey % 512 AS INT) - 256 AS x, CAST(l_suppkey % 256 AS INT) AS y, CAST(l_linenumber AS INT) AS z, CAST(l_quantity AS INT) % 9 AS prio,
  CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN 'glass' WHEN 1 THEN 'railing' WHEN 2 THEN 'frame' WHEN 3 THEN 'roof' WHEN 4 THEN 'floor' WHEN 5 THEN 'stair'
    WHEN 6 THEN 'structure' WHEN 7 THEN 'wall' ELSE 'other' END AS cls FROM lineitem""",
    "edits": """SELECT event_id, ts, user_id AS session_id, CAST((event_id*7) % 512 AS INT) - 256 AS x, CAST(event_id % 8 AS INT) AS y,
  CAST(user_id % 256 AS INT) AS z, CASE WHEN event_type='purchase' THEN 0 ELSE CAST(1+event_id%20 AS INT) END AS v FROM events""",
    "session_events": """SELECT user_id AS session_id, event_id, ts, CASE event_type WHEN 'click' THEN 'bp' WHEN 'error' THEN 'leave' WHEN 'purchase' THEN 'bm' WHEN 'signup' THEN 'join' ELSE 'cr' END AS kind,
  value AS latency_ms FROM events""",
    "session_log": """SELECT user_id AS session_id, event_id, ts, CASE event_type WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'ms' WHEN 1 THEN 'r' WHEN 2 THEN 'd' ELSE 'bp' END WHEN 'error' THEN 'leave' WHEN 'purchase' THEN 'bm' WHEN 'signup' THEN 'join' ELSE 'cr' END AS kind,
  concat('ip', event_id % 7) AS ip, CASE WHEN event_id % 2 = 0 THEN concat('t', event_id) END AS token, CASE WHEN event_id % 3 > 0 THEN concat('p', user_id % 50) END AS name FROM events""",
    "blasts": "SELECT event_id AS blast_id, x AS bx, y AS by, z AS bz, CAST(2 + event_id % 3 AS INT) AS radius FROM edits WHERE v = 0",
    "entities": "SELECT p_partkey AS id, CAST((p_partkey*7)%512-256 AS DOUBLE) + 0.5 AS x, CAST(p_partkey%8 AS DOUBLE) + 0.25 AS y, CAST((p_partkey*3)%256 AS DOUBLE) + 0.5 AS z, CASE p_partkey % 3 WHEN 0 THEN 'creative' WHEN 1 THEN 'survival' ELSE 'spectator' END AS mode, p_partkey % 5 = 0 AS show_inventory, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 200 END AS pickup_delay FROM part",
    "drops": "SELECT event_id AS entity_id, CAST(x AS DOUBLE) + 0.5 AS ex, CAST(y AS DOUBLE) AS ey, CAST(z AS DOUBLE) + 0.25 AS ez FROM edits",
    "materials": "SELECT DISTINCT element_id, material_id, concat('m', material_id % 3) AS name, CASE WHEN material_id < 4 THEN CAST((r + 40 * material_id) % 256 AS DOUBLE) / 255 END AS r, CASE WHEN material_id < 4 THEN CAST(g AS DOUBLE) / 255 END AS g, CASE WHEN material_id < 4 THEN CAST(b AS DOUBLE) / 255 END AS b FROM face_materials f JOIN colors c ON c.color_id = f.element_id WHERE material_id >= 0",
    "meshes": "SELECT p_partkey AS mesh_id, p_size AS n_vertices, p_size % 7 AS n_faces, (p_partkey*37)%480 AS low_x, (p_partkey*53)%400 AS low_y, (p_partkey*11)%120 AS low_z, (p_partkey*37)%480 + 1+p_size%12 AS high_x, (p_partkey*53)%400 + 1+(p_partkey*7)%30 AS high_y, (p_partkey*11)%120 + 2+(p_partkey*5)%28 AS high_z FROM part",
    "craft_slots": """SELECT l_orderkey AS grid_id, CAST(floor((l_linenumber-1)/3) AS INT) AS r, CAST((l_linenumber-1)%3 AS INT) AS c,
  CASE min(l_partkey)%4 WHEN 0 THEN 'planks_oak' WHEN 1 THEN 'stick' WHEN 2 THEN 'cobblestone' ELSE 'iron_ingot' END AS item FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "face_materials": "SELECT l_partkey AS element_id, l_orderkey*8+l_linenumber AS face_no, CAST(l_suppkey%6 AS INT)-1 AS material_id FROM lineitem",
    "colors": "SELECT p_partkey AS color_id, CAST((p_partkey*31)%256 AS INT) AS r, CAST((p_partkey*57)%256 AS INT) AS g, CAST((p_partkey*101)%256 AS INT) AS b, p_size%2=0 AS glass FROM part",
    "doors": """SELECT element_id, x0, y0, z0, x0+dx AS x1, y0+dy AS y1, z0+dz AS z1, CASE WHEN element_id % 4 = 0 THEN NULL ELSE greatest(dx, dy) END AS width_dm FROM elements WHERE ifc_type = 'IfcDoor'""",
    "storeys": "SELECT s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS elevation FROM supplier",
    "deny": "SELECT c_custkey AS token, c_custkey % 16 AS ip_bucket FROM customer WHERE c_custkey % 97 = 5",
    "block_states": """SELECT p_partkey AS id, CAST(p_partkey % 64 AS INT) AS x, CAST(p_size % 32 AS INT) AS y, CAST((p_partkey*7) % 64 AS INT) - 20 AS z,
  CASE p_partkey % 8 WHEN 0 THEN 'minecraft:oak_door[facing=east,half=lower,hinge=left,open=false]' WHEN 1 THEN 'minecraft:oak_door[facing=north, half=upper]'
    WHEN 2 THEN 'minecraft:stone_brick_stairs[facing=west,half=bottom]' WHEN 3 THEN 'minecraft:white_concrete' WHEN 4 THEN 'minecraft:smooth_stone_slab[type=top]'
    WHEN 5 THEN 'minecraft:light_blue_stained_glass' WHEN 6 THEN 'minecraft:iron_bars' ELSE 'minecraft:oak_fence' END AS block FROM part""",
    "voxels": "SELECT x, y, z, h.prio, p.cls, p.block FROM (SELECT x, y, z, max(prio) AS prio FROM voxel_hits GROUP BY x, y, z) h JOIN priority_dim p ON h.prio = p.prio",
    "blocks": "SELECT x, z AS y, y AS z, block FROM voxels",
    "messages": "SELECT conv_id, turn, role, text FROM conversations",
}


def _needs(text: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN)\s+\(?(\w+)", text))


def _all(names) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            out += [x for x in _all(sorted(_needs(VIEWS[n]))) if x not in out]
        if (n in VIEWS or n in dims.TABLES) and n not in out:
            out.append(n)
    return out


def with_views(query: str) -> str:
    """The query after common table expressions of all views and dictionaries that it names."""
    parts = [f"{n} AS ({VIEWS[n]})" if n in VIEWS else dims.sql(n) for n in _all(sorted(_needs(query)))]
    own = query.strip()
    if own[:5].upper() == "WITH ":
        own = own[5:].lstrip()
        loops = own.startswith("RECURSIVE ")
        return ("WITH RECURSIVE " if loops else "WITH ") + ",\n".join([*parts, own.removeprefix("RECURSIVE ")])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + own


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a given table) as a DataFrame, lazily."""
    if name in dims.TABLES:
        return dims.table(spark, name)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {n: view(spark, sf_dir, n) for n in _needs(VIEWS[name])}
    text = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in used else m[0], VIEWS[name])
    return spark.sql(text, **used)
