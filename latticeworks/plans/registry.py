"""Every query of the library over the given tables, with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog as C
from ..operators import neighbors as N
from ..operators import profile as P
from ..operators import sessions as E
from ..operators import voxels as V
from ..operators import world as W
from . import dims
from .inputs import view, with_views

View = Callable[[str], DataFrame]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[View], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files, streams  # they add their own

    return dict(_QUERIES) | files.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import files, streams

    return {k: with_views(s) for k, s in (_SQL | files.SQL | streams.SQL).items()}


def voxels(v: View) -> DataFrame:
    return V.resolve_priority(v("voxel_hits"), v("priority_dim"))


def blocks(v: View) -> DataFrame:
    """x, y (up), z, block."""
    return voxels(v).select("x", F.col("z").alias("y"), F.col("y").alias("z"), "block")


def valued(v: View) -> DataFrame:
    """x, y (up), z, v: the class number plus one."""
    return voxels(v).select("x", F.col("z").alias("y"), F.col("y").alias("z"), (F.col("prio") + 1).alias("v"))


# -- voxels ----------------------------------------------------------------------------------------------------------
query("resolve_priority", "SELECT x, y, z, prio, cls, block FROM voxels")(voxels)
query("class_voxel_counts", "SELECT p.cls, count(h.x) AS n_voxels FROM priority_dim p LEFT JOIN (SELECT DISTINCT cls, x, y, z FROM voxel_hits) h ON h.cls = p.cls GROUP BY p.cls")(lambda v: V.class_voxel_counts(v("voxel_hits"), v("priority_dim")))
query("block_counts", "SELECT block, count(*) AS n FROM voxels GROUP BY block")(lambda v: V.block_counts(voxels(v)))
query("classify", "SELECT e.element_id, e.ifc_type, coalesce(c.cls, 'other') AS cls FROM elements e LEFT JOIN class_dim c ON c.ifc_type = e.ifc_type")(lambda v: V.classify(v("elements"), v("class_dim")).select("element_id", "ifc_type", "cls"))


@query("drop_non_solid", "SELECT element_id, CASE WHEN ifc_type IN (SELECT ifc_type FROM exclude_dim) THEN 'excluded' WHEN ifc_type = 'IfcDoor' THEN 'door' ELSE 'solid' END AS part FROM elements WHERE has_representation")
def _(v):
    parts = zip(V.drop_non_solid(v("elements"), v("exclude_dim")), ("solid", "door", "excluded"))
    return V.concat_meshes(*(df.select("element_id", F.lit(n).alias("part")) for df, n in parts))


query("bounds", "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, max(x) + 1 AS dim_x, max(y) + 1 AS dim_y, max(z) + 1 AS dim_z FROM voxel_hits")(lambda v: V.bounds(v("voxel_hits"), "x", "y", "z"))
query("strip_state", "SELECT id, split_part(block, '[', 1) AS base FROM block_states")(lambda v: v("block_states").select("id", S.strip_state("block").alias("base")))
query("to_y_up", "SELECT x - min(x) OVER () AS x, z - min(z) OVER () AS y, -y - min(-y) OVER () AS z, block FROM voxels")(lambda v: V.to_y_up(voxels(v).select("x", "y", "z", "block")))
query("to_y_up_swap", "SELECT x, z AS y, y AS z, block FROM voxels")(lambda v: V.to_y_up_swap(voxels(v).select("x", "y", "z", "block")))
query("normalize_origin", "SELECT x - (SELECT min(x) FROM blocks) AS x, y - (SELECT min(y) FROM blocks) AS y, z - (SELECT min(z) FROM blocks) AS z, block FROM blocks")(lambda v: V.normalize_origin(blocks(v))[0])
query("center_offset", "SELECT x - CAST(floor((SELECT max(x) FROM blocks) / 2) AS INT) AS x, y + 5 AS y, z - CAST(floor((SELECT max(z) FROM blocks) / 2) AS INT) AS z, block FROM blocks")(lambda v: V.center_offset(blocks(v)))
query("height_slice", "SELECT * FROM blocks WHERE y < 4")(lambda v: V.height_slice(blocks(v), 4))
query("visible_categories", "SELECT b.x, b.y, b.z, coalesce(s.category, 'Other') AS category FROM blocks b LEFT JOIN style_dim s ON s.block = b.block WHERE coalesce(s.category, 'Other') NOT IN ('Walls', 'Roof')")(lambda v: V.visible_categories(blocks(v), v("style_dim"), ["Walls", "Roof"]).select("x", "y", "z", "category"))
query("style_blocks", "SELECT b.x, b.y, b.z, coalesce(category, 'Other') AS category, coalesce(r, 190) AS r, coalesce(g, 120) AS g, coalesce(s.b, 120) AS b, CAST(coalesce(opacity, 1.0) AS DOUBLE) AS opacity FROM blocks b LEFT JOIN style_dim s ON s.block = b.block")(lambda v: V.style_blocks(blocks(v), v("style_dim")).select("x", "y", "z", "category", "r", "g", "b", "opacity"))
REMAP = "SELECT id, CASE WHEN split_part(b.block, '[', 1) LIKE '%\\_door' ESCAPE '\\' THEN CASE WHEN b.block LIKE '%facing=east%' OR b.block LIKE '%facing=west%' THEN 'door_x' ELSE 'door_z' END ELSE coalesce(n.target, 'stone') END AS target FROM block_states b LEFT JOIN name_dim n ON n.block = split_part(b.block, '[', 1)"
query("remap_blocks", REMAP)(lambda v: V.remap_blocks(v("block_states"), v("name_dim")).select("id", "target"))
query("unmapped_names", "SELECT split_part(b.block, '[', 1) AS base, count(*) AS n FROM block_states b LEFT JOIN name_dim n ON n.block = split_part(b.block, '[', 1) WHERE n.target IS NULL AND split_part(b.block, '[', 1) NOT LIKE '%\\_door' ESCAPE '\\' GROUP BY 1")(lambda v: V.unmapped_names(V.remap_blocks(v("block_states"), v("name_dim"))))


@query("registry_ids", f"SELECT r.id, count(*) AS n FROM ({REMAP}) t JOIN (SELECT target, row_number() OVER (ORDER BY target) AS id FROM (SELECT DISTINCT target FROM name_dim)) r ON r.target = t.target GROUP BY r.id")
def _(v):
    names = v("name_dim").select(F.col("target").alias("name")).distinct().withColumn("ordinal", F.col("name"))
    remapped = V.remap_blocks(v("block_states"), v("name_dim")).drop("id")
    return V.registry_ids(remapped, C.assign_ids(names).select("name", "id"))[0].groupBy("id").agg(F.count("*").alias("n"))


@query("merge_default_state", "SELECT id, CASE WHEN block LIKE '%open=%' THEN regexp_extract(block, 'open=(\\w+)', 1) ELSE 'closed' END AS open, CASE WHEN block LIKE '%half=%' THEN regexp_extract(block, 'half=(\\w+)', 1) ELSE 'lower' END AS half FROM block_states WHERE block LIKE '%door%'")
def _(v):
    registry = v("name_dim").sparkSession.createDataFrame([("minecraft:oak_door", {"open": "closed", "half": "lower"})], "base string, defaults map<string,string>")
    return V.merge_default_state(v("block_states"), registry)[0].select("id", F.col("props")["open"].alias("open"), F.col("props")["half"].alias("half"))


LAB = """lin AS (SELECT *, CASE WHEN r/255.0 > 0.04045 THEN pow((r/255.0+0.055)/1.055, 2.4) ELSE r/255.0/12.92 END AS lr, CASE WHEN g/255.0 > 0.04045 THEN pow((g/255.0+0.055)/1.055, 2.4) ELSE g/255.0/12.92 END AS lg,
  CASE WHEN b/255.0 > 0.04045 THEN pow((b/255.0+0.055)/1.055, 2.4) ELSE b/255.0/12.92 END AS lb FROM pts),
xyz AS (SELECT *, (0.4124*lr+0.3576*lg+0.1805*lb)/0.95047 AS tx, (0.2126*lr+0.7152*lg+0.0722*lb) AS ty, (0.0193*lr+0.1192*lg+0.9505*lb)/1.08883 AS tz FROM lin),
fs AS (SELECT *, CASE WHEN tx > 0.008856 THEN pow(tx, 1.0/3) ELSE 7.787*tx+16.0/116 END AS fx, CASE WHEN ty > 0.008856 THEN pow(ty, 1.0/3) ELSE 7.787*ty+16.0/116 END AS fy, CASE WHEN tz > 0.008856 THEN pow(tz, 1.0/3) ELSE 7.787*tz+16.0/116 END AS fz FROM xyz),
lab AS (SELECT *, 116*fy-16 AS l, 500*(fx-fy) AS a2, 200*(fy-fz) AS b2 FROM fs)"""
query("srgb_to_lab", f"WITH pts AS (SELECT color_id, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM colors), {LAB} SELECT color_id, round(l, 6) AS l, round(a2, 6) AS a, round(b2, 6) AS b FROM lab")(
    lambda v: v("colors").select("color_id", S.srgb_to_lab("r", "g", "b").alias("lab")).select("color_id", *(F.round(f"lab.{c}", 6).alias(c) for c in "lab"))
)
query("nearest_palette", f"""WITH pts AS (SELECT 0 AS kind, color_id, '' AS block, glass, 0 AS ordinal, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM colors
  UNION ALL SELECT 1, 0, block, glass, ordinal, pr, pg, pb FROM palette_dim), {LAB},
k AS (SELECT c.color_id, p.block, row_number() OVER (PARTITION BY c.color_id ORDER BY round(pow(c.l-p.l,2)+pow(c.a2-p.a2,2)+pow(c.b2-p.b2,2), 6), p.ordinal) AS rn FROM lab c JOIN lab p ON c.kind = 0 AND p.kind = 1 AND c.glass = p.glass)
SELECT color_id, block FROM k WHERE rn = 1""")(lambda v: V.nearest_palette(v("colors"), v("palette_dim")).select("color_id", "block"))
query("palette_colours", "SELECT b.*, coalesce(glass, false) AS is_glass, coalesce(pr, 190) AS r, coalesce(pg, 120) AS g, coalesce(pb, 120) AS b FROM blocks b LEFT JOIN palette_dim p ON p.block = b.block")(lambda v: V.palette_colours(blocks(v), v("palette_dim")))
query("chunk_counts", "SELECT x >> 4 AS cx, z >> 4 AS cz, x >> 9 AS rx, z >> 9 AS rz, count(*) AS n FROM blocks GROUP BY ALL")(lambda v: V.chunk_counts(blocks(v)))
query("footprint", "SELECT CAST(floor((max(x)+1)*0.5+0.5) AS BIGINT) AS size_x, CAST(floor((max(y)+1)*0.5+0.5) AS BIGINT) AS size_y, CAST(floor((max(z)+1)*0.5+0.5) AS BIGINT) AS size_z, count(*) AS total FROM blocks")(lambda v: V.footprint(blocks(v), 0.5))
query("column_top", "SELECT x, z, max(y) AS top FROM blocks WHERE y BETWEEN 1 AND 6 GROUP BY x, z")(lambda v: V.column_top(blocks(v), 6))
query("group_offsets", "SELECT block, n, CAST(coalesce(sum(n) OVER (ORDER BY n DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT block, count(*) AS n FROM voxels GROUP BY block)")(lambda v: V.group_offsets(V.block_counts(voxels(v))))


SIDES = [("z", "x", "y"), ("x", "y", "z"), ("y", "z", "x")]  # the axis across, and the two along


def _box_triangles(v: View) -> DataFrame:
    """Two triangles of each side of each element's cuboid."""
    e = V.classify(v("elements").where("has_representation"), v("class_dim"))
    at = lambda far: {c: (F.col(f"{c}0") + (F.col(f"d{c}") if c in far else 0)).cast("double") for c in "xyz"}
    faces = [face for n, u, w in SIDES for far in ("", n) for face in ((far, u + far, w + far), (u + w + far, w + far, u + far))]
    corners = lambda face: F.struct(F.lit(faces.index(face)).alias("face_no"), *(x.alias(f"{p}{c}") for p, far in zip("abc", face) for c, x in at(far).items()))
    return e.select("element_id", "cls", F.explode(F.array(*map(corners, faces))).alias("t")).select("element_id", "cls", "t.*")


query("voxelize_surface", """WITH e AS (SELECT e.*, coalesce(c.cls, 'other') AS cls FROM elements e LEFT JOIN class_dim c ON c.ifc_type = e.ifc_type WHERE has_representation),
f(fx, fy, fz, ux, uy, uz, vx, vy, vz) AS (VALUES (0,0,0, 1,0,0, 0,1,0), (1,1,0, -1,0,0, 0,-1,0), (0,0,1, 1,0,0, 0,1,0), (1,1,1, -1,0,0, 0,-1,0), (0,0,0, 0,1,0, 0,0,1), (0,1,1, 0,-1,0, 0,0,-1),
  (1,0,0, 0,1,0, 0,0,1), (1,1,1, 0,-1,0, 0,0,-1), (0,0,0, 0,0,1, 1,0,0), (1,0,1, 0,0,-1, -1,0,0), (0,1,0, 0,0,1, 1,0,0), (1,1,1, 0,0,-1, -1,0,0)),
t AS (SELECT cls, x0+fx*dx AS ax, y0+fy*dy AS ay, z0+fz*dz AS az, ux*dx AS ux, uy*dy AS uy, uz*dz AS uz, vx*dx AS vx, vy*dy AS vy, vz*dz AS vz FROM e CROSS JOIN f),
n AS (SELECT *, CAST(pow(2, greatest(0, ceil(log2(sqrt(ux*ux+uy*uy+uz*uz+vx*vx+vy*vy+vz*vz)*2/4.0)))) AS INT) AS n FROM t),
i AS (SELECT *, unnest(range(n+1)) AS i FROM n), j AS (SELECT *, unnest(range(n-i+1)) AS j FROM i)
SELECT DISTINCT cls, CAST(greatest(0, round_even((ax + i/n*ux + j/n*vx)/4.0, 0)) AS INT) AS x, CAST(greatest(0, round_even((ay + i/n*uy + j/n*vy)/4.0, 0)) AS INT) AS y, CAST(greatest(0, round_even((az + i/n*uz + j/n*vz)/4.0, 0)) AS INT) AS z FROM j""")(lambda v: V.voxelize_surface(_box_triangles(v), 4.0, (0.0, 0.0, 0.0)))
query("overlay_layers", """WITH l AS (SELECT x, y, z, prio + 1 AS v, 0 AS k, 0 AS t FROM (SELECT x, z AS y, y AS z, prio FROM voxels) UNION ALL SELECT x, y, z, arg_max(v, (ts, event_id)), 1, 0 FROM edits GROUP BY x, y, z)
SELECT x, y, z, arg_max(v, k) AS v FROM l GROUP BY x, y, z HAVING arg_max(v, k) <> 0""")(lambda v: V.overlay_layers(valued(v), W.last_write_wins(v("edits"))))


@query("reindex_faces", """WITH m AS (SELECT p_partkey AS mesh_id, p_brand AS cls, p_size AS n FROM part), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cls ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM m)
SELECT cls, mesh_id, l_linenumber AS face_no, CAST(l_linenumber % n + base AS BIGINT) AS i, CAST((l_linenumber+1) % n + base AS BIGINT) AS j, CAST((l_linenumber+2) % n + base AS BIGINT) AS k FROM lineitem JOIN b ON l_partkey = mesh_id""")
def _(v):
    m = v("part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_brand").alias("cls"), F.col("p_size").alias("n_vertices"))
    faces = v("lineitem").join(m, F.col("l_partkey") == m.mesh_id).select("mesh_id", F.col("l_linenumber").alias("face_no"), *(((F.col("l_linenumber") + k) % F.col("n_vertices")).alias(c) for k, c in enumerate("ijk")))
    return V.reindex_faces(m, faces)


# -- neighbours ------------------------------------------------------------------------------------------------------
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
_near = lambda offs, src="voxels": ", ".join(f"EXISTS (SELECT 1 FROM {src} n WHERE n.x = v.x + ({dx}) AND n.y = v.y + ({dy}) AND n.z = v.z + ({dz})) AS o{i}" for i, (dx, dy, dz) in enumerate(offs))
query("neighbor_mask", f"SELECT x, y, z, {' + '.join(f'CAST(o{i} AS INT) * {1 << i}' for i in range(6))} AS mask FROM (SELECT v.x, v.y, v.z, {_near(SIX)} FROM voxels v)")(lambda v: N.neighbor_mask(voxels(v), SIX))
STAIR = [(0, 0, 1), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)]
query("orient_stairs", f"""WITH m AS (SELECT v.x, v.y, v.z, v.block, {_near(STAIR)} FROM voxels v), r AS (SELECT *, CAST(o1 AS INT)+CAST(o2 AS INT)+CAST(o3 AS INT)+CAST(o4 AS INT) AS k,
  CASE WHEN o1 AND NOT o5 THEN 'east' WHEN o2 AND NOT o6 THEN 'west' WHEN o3 AND NOT o7 THEN 'north' WHEN o4 AND NOT o8 THEN 'south' WHEN o1 THEN 'east' WHEN o2 THEN 'west' WHEN o3 THEN 'north' WHEN o4 THEN 'south' END AS f FROM m)
SELECT x, y, z, CASE WHEN block = 'minecraft:stone_bricks' AND NOT o0 AND k IN (1, 2) THEN 'minecraft:stone_brick_stairs[facing=' || f || ',half=bottom,shape=straight]' ELSE block END AS block FROM r""")(lambda v: N.orient_stairs(voxels(v)).select("x", "y", "z", "block"))
query("thin_floor_slabs", f"SELECT x, y, z, CASE WHEN block = 'minecraft:smooth_stone' AND NOT o0 AND NOT o1 THEN 'minecraft:smooth_stone_slab[type=bottom]' ELSE block END AS block FROM (SELECT v.x, v.y, v.z, v.block, {_near([(0, 0, 1), (0, 0, -1)])} FROM voxels v)")(lambda v: N.thin_floor_slabs(voxels(v)).select("x", "y", "z", "block"))


def _boxes(v: View) -> DataFrame:
    """Doors as boxes of voxel cells."""
    return v("doors").select("element_id", *((F.col(f"{c}{k}") % m - b).cast("int").alias(f"{c}{k}") for c, m, b in (("x", 256, 128), ("y", 256, 0), ("z", 8, 0)) for k in (0,)), (F.col("x1") - F.col("x0")).alias("wx"), (F.col("y1") - F.col("y0")).alias("wy"), F.col("width_dm").alias("width")).select("element_id", "x0", "y0", "z0", (F.col("x0") + F.col("wx")).alias("x1"), (F.col("y0") + F.col("wy")).alias("y1"), (F.col("z0") + 3).alias("z1"), "width")


BOXES = "SELECT x0 % 256 - 128 AS x0, y0 % 256 AS y0, z0 % 8 AS z0, x0 % 256 - 128 + (x1 - x0) AS x1, y0 % 256 + (y1 - y0) AS y1, z0 % 8 + 3 AS z1 FROM doors"
CARVE = f"SELECT x, y, z, block FROM voxels v WHERE NOT EXISTS (SELECT 1 FROM ({BOXES}) b WHERE v.x BETWEEN b.x0 AND b.x1 AND v.y BETWEEN b.y0 AND b.y1 AND v.z BETWEEN b.z0 AND b.z1)"
query("carve_openings", CARVE)(lambda v: N.carve_openings(voxels(v), _boxes(v)).select("x", "y", "z", "block"))
query("occupied_minus_carved", "SELECT x, y, z FROM voxels EXCEPT SELECT x, z, y FROM edits")(lambda v: N.occupied_minus_carved(voxels(v), v("edits").select("x", F.col("z").alias("y"), F.col("y").alias("z"))).select("x", "y", "z"))
query("place_doors_air", CARVE)(lambda v: N.place_doors(voxels(v), _boxes(v), 10.0, "air").select("x", "y", "z", "block"))
query("place_doors_solid", f"{CARVE} UNION ALL SELECT x, y, z, 'minecraft:oak_planks' FROM (SELECT DISTINCT x, y, unnest(range(z0, z1 + 1)) AS z FROM (SELECT x, unnest(range(y0, y1 + 1)) AS y, z0, z1 FROM (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1, z0, z1 FROM ({BOXES}))))")(lambda v: N.place_doors(voxels(v), _boxes(v), 10.0, "solid").select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"), "block"))
query("place_doors", """WITH b AS (SELECT element_id, x0 % 256 - 128 AS x0, y0 % 256 AS y0, z0 % 8 AS z0, x0 % 256 - 128 + (x1 - x0) AS x1, y0 % 256 + (y1 - y0) AS y1, z0 % 8 + 3 AS z1, width_dm AS width FROM doors),
carved AS (SELECT x, y, z, block FROM voxels v WHERE NOT EXISTS (SELECT 1 FROM b WHERE v.x BETWEEN b.x0 AND b.x1 AND v.y BETWEEN b.y0 AND b.y1 AND v.z BETWEEN b.z0 AND b.z1)),
d AS (SELECT element_id, z0 AS z, width, x1 - x0 <= y1 - y0 AS east, CASE WHEN east THEN y0 ELSE x0 END AS lo, CASE WHEN east THEN y1 ELSE x1 END AS hi, CAST(floor(CASE WHEN east THEN x0 + x1 ELSE y0 + y1 END / 2.0) AS BIGINT) AS fixed FROM b),
n AS (SELECT *, CAST(coalesce(least(greatest(1, round_even(width / 10.0, 0)), hi - lo + 1), 1) AS BIGINT) AS n FROM d),
s AS (SELECT *, greatest(lo, CAST(floor((lo + hi) / 2.0) AS BIGINT) - (n - 1) // 2) AS start FROM n),
w AS (SELECT DISTINCT element_id, east, fixed, z, least(start + i, hi) AS w FROM (SELECT *, unnest(range(n)) AS i FROM s)),
l AS (SELECT element_id, w, east, CASE WHEN east THEN fixed ELSE w END AS x, CASE WHEN east THEN w ELSE fixed END AS y, z FROM w),
p AS (SELECT l.element_id, l.w, max(c.z) AS floor_z FROM l JOIN carved c ON c.z BETWEEN l.z - 3 AND l.z + 1 AND ((l.east AND c.y = l.y AND c.x IN (l.x - 1, l.x + 1)) OR (NOT l.east AND c.x = l.x AND c.y IN (l.y - 1, l.y + 1))) GROUP BY l.element_id, l.w),
g AS (SELECT x, y, coalesce(floor_z + 1, z) AS z, arg_max(east, l.element_id) AS east FROM l LEFT JOIN p ON p.element_id = l.element_id AND p.w = l.w GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN east THEN y ELSE x END AS wide, CASE WHEN east THEN x ELSE y END AS across FROM g), i AS (SELECT *, wide - row_number() OVER (PARTITION BY east, across, z ORDER BY wide) AS island FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY east, across, z, island ORDER BY wide) - 1 AS place, count(*) OVER (PARTITION BY east, across, z, island) AS size FROM i),
h AS (SELECT x, y, z, CASE WHEN east THEN 'east' ELSE 'south' END AS facing, CASE WHEN size >= 2 AND place < size // 2 THEN 'right' ELSE 'left' END AS hinge FROM o),
halves AS (SELECT x, y, z + j AS z, arg_min('minecraft:oak_door[facing=' || facing || ',half=' || CASE j WHEN 0 THEN 'lower' ELSE 'upper' END || ',hinge=' || hinge || ',open=false]', j) AS block FROM h CROSS JOIN range(2) t(j) GROUP BY 1, 2, 3),
sills AS (SELECT DISTINCT x, y, z - 1 AS z FROM h)
SELECT x, y, z, block FROM carved c WHERE NOT EXISTS (SELECT 1 FROM halves h WHERE h.x = c.x AND h.y = c.y AND h.z = c.z) UNION ALL SELECT CAST(x AS INT), CAST(y AS INT), CAST(z AS INT), block FROM halves
UNION ALL SELECT CAST(x AS INT), CAST(y AS INT), CAST(z AS INT), 'minecraft:smooth_stone' FROM sills s WHERE NOT EXISTS (SELECT 1 FROM carved c WHERE s.x = c.x AND s.y = c.y AND s.z = c.z) AND NOT EXISTS (SELECT 1 FROM halves h WHERE h.x = s.x AND h.y = s.y AND h.z = s.z)""")(lambda v: N.place_doors(voxels(v), _boxes(v), 10.0).select("x", "y", "z", "block"))
LEAVES = "SELECT element_id AS leaf_id, CAST(x0 % 256 - 128 AS INT) AS x, CAST(y0 % 256 AS INT) AS y, CAST(z0 % 8 AS INT) AS z, CASE WHEN dx <= dy THEN 'east' ELSE 'south' END AS facing FROM elements"


def _leaves(v: View) -> DataFrame:
    return v("elements").select(F.col("element_id").alias("leaf_id"), (F.col("x0") % 256 - 128).cast("int").alias("x"), (F.col("y0") % 256).cast("int").alias("y"), (F.col("z0") % 8).cast("int").alias("z"), S.door_facing("dx", "dy").alias("facing"))


query("floor_probe", f"""WITH l AS ({LEAVES}) SELECT l.leaf_id, max(v.z) AS floor_z FROM l LEFT JOIN voxels v ON v.z BETWEEN l.z - 3 AND l.z + 1
  AND ((l.facing = 'east' AND v.y = l.y AND v.x IN (l.x - 1, l.x + 1)) OR (l.facing = 'south' AND v.x = l.x AND v.y IN (l.y - 1, l.y + 1))) GROUP BY l.leaf_id""")(lambda v: N.floor_probe(_leaves(v), voxels(v)))
query("mirror_double_doors", """WITH c AS (SELECT DISTINCT x, y, z, CASE WHEN prio % 2 = 0 THEN 'east' ELSE 'south' END AS facing FROM voxels), w AS (SELECT *, CASE WHEN facing = 'east' THEN y ELSE x END AS wide, CASE WHEN facing = 'east' THEN x ELSE y END AS across FROM c),
i AS (SELECT *, wide - row_number() OVER (PARTITION BY facing, across, z ORDER BY wide) AS island FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY facing, across, z, island ORDER BY wide) - 1 AS place, count(*) OVER (PARTITION BY facing, across, z, island) AS size FROM i)
SELECT x, y, z, facing, size, CASE WHEN size >= 2 AND place < size // 2 THEN 'right' ELSE 'left' END AS hinge FROM p""")(lambda v: N.mirror_double_doors(voxels(v).select("x", "y", "z", F.when(F.col("prio") % 2 == 0, "east").otherwise("south").alias("facing"))))
query("explode_radius", "SELECT b.event_id AS blast_id, v.x, v.y, v.z, 0 AS v FROM edits b JOIN (SELECT x, z AS y, y AS z, prio + 1 AS v FROM voxels) v ON (v.x-b.x)*(v.x-b.x)+(v.y-b.y)*(v.y-b.y)+(v.z-b.z)*(v.z-b.z) <= 4 AND v.x BETWEEN b.x - 2 AND b.x + 2 WHERE b.v = 0 AND v.v > 1")(
    lambda v: N.explode_radius(valued(v), v("edits").where("v = 0").select(F.col("event_id").alias("blast_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), F.lit(2).alias("radius")))
)
_dirs = ", ".join(f"('{n}', {x}, {y}, {z})" for n, (x, y, z) in N.FACES.items())


def clear_values(v: View) -> DataFrame:
    """Classes that are seen through (glass, railings, frames and roofs stand for glass and doors)."""
    return v("priority_dim").where("prio IN (0, 1, 2, 3)").select((F.col("prio") + 1).alias("v"))


def door_values(v: View) -> DataFrame:
    """Railings stand for closed doors across x, roofs for such that are open."""
    return v("priority_dim").where("prio IN (1, 3)").select((F.col("prio") + 1).alias("v"), F.lit("x").alias("axis"), (F.col("prio") == 3).alias("open"))


FACE_SQL = f"""d(face, dx, dy, dz) AS (VALUES {_dirs}), b AS (SELECT x, y, z, v, v IN (1, 2, 3, 4) AS c, v IN (2, 4) AS door FROM {{src}}),
f AS (SELECT b.x, b.y, b.z, b.v, face, CASE WHEN b.door THEN CASE b.v WHEN 2 THEN 'opaque' ELSE 'transparent' END WHEN b.c THEN 'transparent' ELSE 'opaque' END AS pass FROM b CROSS JOIN d LEFT JOIN b n ON n.x = b.x + dx AND n.y = b.y + dy AND n.z = b.z + dz
  WHERE CASE b.v WHEN 2 THEN face IN ('east', 'west') WHEN 4 THEN face IN ('south', 'north') ELSE n.v IS NULL OR (n.c AND n.v <> b.v) END)"""
query("visible_faces", f"WITH {FACE_SQL.format(src='(SELECT x, z AS y, y AS z, prio + 1 AS v FROM voxels)')} SELECT x, y, z, v, face, pass FROM f")(lambda v: N.visible_faces(valued(v), clear_values(v), doors=door_values(v)))
_SQL["stream_faces"] = f"""WITH l AS (SELECT x, z AS y, y AS z, prio + 1 AS v, 0 AS k FROM voxels UNION ALL SELECT x, y, z, arg_max(v, (ts, event_id)), 1 FROM edits GROUP BY x, y, z), o AS (SELECT x, y, z, arg_max(v, k) AS v FROM l GROUP BY x, y, z HAVING arg_max(v, k) <> 0),
{FACE_SQL.format(src='o')}, s AS (SELECT DISTINCT (x + dx) >> 4 AS cx, (y + dy) >> 4 AS cy, (z + dz) >> 4 AS cz FROM edits CROSS JOIN (SELECT dx, dy, dz FROM d UNION ALL SELECT 0, 0, 0)) SELECT x, y, z, v, face, pass FROM f JOIN s ON x >> 4 = cx AND y >> 4 = cy AND z >> 4 = cz"""
query("preview_boxes", f"WITH d(face, dx, dy, dz) AS (VALUES {_dirs}) SELECT x, y, z, face FROM voxels CROSS JOIN d")(lambda v: N.preview_boxes(voxels(v).select("x", "y", "z")))
query("dirty_cells", f"WITH d(face, dx, dy, dz) AS (VALUES {_dirs}, ('self', 0, 0, 0)) SELECT DISTINCT CAST(floor((x+dx)/16) AS INT) AS cx, CAST(floor((y+dy)/16) AS INT) AS cy, CAST(floor((z+dz)/16) AS INT) AS cz FROM edits CROSS JOIN d")(lambda v: N.dirty_cells(v("edits")))
CELLS = "SELECT DISTINCT x >> 4 AS cx, z >> 4 AS cz FROM blocks"
query("cells_beyond_radius", f"SELECT cx, cz, viewer_id FROM ({CELLS}) CROSS JOIN (SELECT n_nationkey AS viewer_id, n_nationkey - 12 AS vx, n_regionkey AS vz FROM nation) WHERE (cx-vx)*(cx-vx)+(cz-vz)*(cz-vz) > 81")(
    lambda v: N.cells_beyond_radius(V.chunk_counts(blocks(v)).select("cx", "cz"), v("nation").select(F.col("n_nationkey").alias("viewer_id"), (F.col("n_nationkey") - 12).alias("vx"), F.col("n_regionkey").alias("vz")), 12).select("cx", "cz", "viewer_id")
)
query("within_reach", "SELECT event_id FROM edits WHERE sqrt((x-z)*(x-z) + (y*8-4)*(y*8-4) + (z-40)*(z-40)) / 16.0 <= 5")(
    lambda v: N.within_reach(v("edits").select("event_id", F.col("x").alias("ax"), F.col("z").alias("bx"), (F.col("y") * 8).alias("ay"), F.lit(4).alias("by"), F.col("z").alias("az"), F.lit(40).alias("bz"))).select("event_id")
)
query("radius_join", """WITH e AS (SELECT event_id AS entity_id, x AS ex, y AS ey, z AS ez FROM edits), p AS (SELECT p_partkey AS player_id, (p_partkey*7)%512-256 AS px, p_partkey%8 AS py, (p_partkey*3)%256 AS pz FROM part)
SELECT entity_id, min(player_id) AS player_id FROM e JOIN p ON (ex-px)*(ex-px)+(ey-py)*(ey-py)+(ez-pz)*(ez-pz) < 20.25 AND px BETWEEN ex - 5 AND ex + 5 GROUP BY entity_id""")(
    lambda v: N.radius_join(v("edits").select(F.col("event_id").alias("entity_id"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez")), v("part").select(F.col("p_partkey").alias("player_id"), F.col("p_partkey").alias("ordinal"), ((F.col("p_partkey") * 7) % 512 - 256).alias("px"), (F.col("p_partkey") % 8).alias("py"), ((F.col("p_partkey") * 3) % 256).alias("pz")), 4.5)
)
_D2 = "(e.x-b.bx)*(e.x-b.bx)+(e.y-b.by)*(e.y-b.by)+(e.z-b.bz)*(e.z-b.bz)"
_NEAR = f"FROM entities e JOIN blasts b ON e.x BETWEEN b.bx - radius - 1 AND b.bx + radius + 1 AND {_D2} <= radius * radius"
query("surviving_entities", f"SELECT id FROM entities EXCEPT SELECT e.id {_NEAR}")(lambda v: N.surviving_entities(v("entities"), v("blasts")).select("id"))
query("blast_damage", f"SELECT e.id, b.blast_id, CAST(floor((radius*radius - ({_D2})) / (radius*radius) * 15) AS INT) AS damage {_NEAR} WHERE e.mode = 'survival'")(lambda v: N.blast_damage(v("entities"), v("blasts")))
query("pickups", """WITH p AS (SELECT id AS player_id, x AS px, y - CAST(0.6 AS DOUBLE) AS py, z AS pz FROM entities WHERE NOT show_inventory AND coalesce(pickup_delay <= 100, true) AND mode <> 'spectator'),
n AS (SELECT entity_id, player_id, sqrt((ex-px)*(ex-px)+(ey-py)*(ey-py)+(ez-pz)*(ez-pz)) AS d FROM drops JOIN p ON px BETWEEN ex - 2 AND ex + 2 AND sqrt((ex-px)*(ex-px)+(ey-py)*(ey-py)+(ez-pz)*(ez-pz)) < 1.5)
SELECT entity_id, coalesce(min(player_id) FILTER (d < 0.6), max(player_id)) AS player_id, CASE WHEN min(d) < 0.6 THEN 'pick' ELSE 'pull' END AS action FROM n GROUP BY entity_id""")(
    lambda v: N.pickups(v("drops"), v("entities").select(F.col("id").alias("player_id"), F.col("id").alias("ordinal"), *(F.col(c).alias(f"p{c}") for c in "xyz"), "mode", "show_inventory", "pickup_delay"), 100)
)
query("fill_enclosed", """WITH RECURSIVE b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM voxels),
w AS (SELECT x, y, z FROM voxels UNION ALL SELECT x, y, unnest([z0-1, z1+1]) FROM (SELECT x, unnest(range(y0, y1+1)) AS y, z0, z1 FROM (SELECT unnest(range(x0, x1+1)) AS x, y0, y1, z0, z1 FROM b))),
r AS (SELECT x, y, z + 1 AS a, n - 1 AS e FROM (SELECT x, y, z, lead(z) OVER (PARTITION BY x, y ORDER BY z) AS n FROM w) WHERE n > z + 1), s(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
o AS (SELECT r.* FROM r CROSS JOIN b WHERE x IN (x0, x1) OR y IN (y0, y1) OR a = z0 OR e = z1
  UNION SELECT r.x, r.y, r.a, r.e FROM (SELECT x + dx AS x, y + dy AS y, a, e FROM o CROSS JOIN s) p JOIN r ON r.x = p.x AND r.y = p.y AND r.a <= p.e AND p.a <= r.e)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(unnest(range(a, e+1)) AS INT) AS z FROM (SELECT * FROM r EXCEPT SELECT * FROM o)""")(lambda v: N.fill_enclosed(voxels(v)))

# -- world -----------------------------------------------------------------------------------------------------------
query("last_write_wins", "SELECT x, y, z, arg_max(v, (ts, event_id)) AS v FROM edits GROUP BY x, y, z")(lambda v: W.last_write_wins(v("edits")))
query("valid_edits", "SELECT event_id FROM edits WHERE y <> 0 AND session_id IN (SELECT session_id FROM session_events WHERE kind = 'join')")(lambda v: W.valid_edits(v("edits"), v("session_events").where("kind = 'join'")).select("event_id"))
RUNS = """WITH c AS ({cells}), g AS (SELECT DISTINCT cx, cy, cz FROM c), d AS (SELECT g.*, o AS off FROM g CROSS JOIN range(4096) t(o)), f AS (SELECT d.*, coalesce(c.v, 0) AS v FROM d LEFT JOIN c USING (cx, cy, cz, off)),
a AS (SELECT *, CAST(coalesce(v <> lag(v) OVER k, true) AS INT) AS n FROM f WINDOW k AS (PARTITION BY cx, cy, cz ORDER BY off)), b AS (SELECT *, sum(n) OVER (PARTITION BY cx, cy, cz ORDER BY off) AS i FROM a),
r AS (SELECT cx, cy, cz, min(off) AS off, count(*) AS n, min(v) AS v FROM b GROUP BY cx, cy, cz, i), s AS (SELECT *, CAST(NOT (n = 1 AND coalesce(lag(n) OVER (PARTITION BY cx, cy, cz ORDER BY off), 0) = 1) AS INT) AS m FROM r),
t AS (SELECT *, sum(m) OVER (PARTITION BY cx, cy, cz ORDER BY off) AS j FROM s), u AS (SELECT cx, cy, cz, min(off) AS off, CASE WHEN max(n) > 1 THEN [CAST(max(n) AS INT), CAST(min(v) AS INT)] ELSE list_concat([CAST(-count(*) AS INT)], list(CAST(v AS INT) ORDER BY off)) END AS code FROM t GROUP BY cx, cy, cz, j)
SELECT cx, cy, cz, array_to_string(flatten(list(code ORDER BY off)), ' ') AS rle FROM u GROUP BY cx, cy, cz"""
CELL_ROWS = "SELECT x >> 4 AS cx, y >> 4 AS cy, z >> 4 AS cz, (y & 15) * 256 + (z & 15) * 16 + (x & 15) AS off, {v} AS v FROM {src}"
_text = lambda df: df.withColumn("rle", F.array_join(F.transform("rle", lambda x: x.cast("string")), " "))
query("rle_encode", RUNS.format(cells=CELL_ROWS.format(v="prio + 1", src="(SELECT x, z AS y, y AS z, prio FROM voxels)")))(lambda v: _text(W.rle_encode(W.to_cells(valued(v)))))
query("save_world", RUNS.format(cells=CELL_ROWS.format(v="v + 1", src="(SELECT x, y, z, arg_max(v, (ts, event_id)) AS v FROM edits GROUP BY x, y, z)")))(lambda v: _text(W.save_world(v("edits"))))
_SQL["autosave"] = _SQL["save_world"]
query("rle_decode", CELL_ROWS.format(v="CAST(prio + 1 AS INT)", src="(SELECT x, z AS y, y AS z, prio FROM voxels)"))(lambda v: W.rle_decode(W.rle_encode(W.to_cells(valued(v)))).where("v <> 0"))
query("flat_ground", "SELECT x, y, z, CASE y WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS v FROM (SELECT DISTINCT x, unnest(range(z0, z1 + 1)) AS z FROM (SELECT unnest(range(x0, x1 + 1)) AS x, z0, z1 FROM (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM blocks GROUP BY x >> 4, z >> 4))) CROSS JOIN range(5) t(y)")(
    lambda v: W.flat_ground(blocks(v).groupBy(S.chunk_of("x"), S.chunk_of("z")).agg(*(f(c).cast("long").alias(f"{c}{k}") for c in "xz" for k, f in enumerate((F.min, F.max))))).select(F.col("x"), F.col("y").cast("long").alias("y"), F.col("z"), "v")
)
_SQL["materialize_cells"] = """WITH l AS (SELECT x, z AS y, y AS z, prio + 1 AS v, 0 AS k FROM voxels UNION ALL SELECT x, y, z, arg_max(v, (ts, event_id)), 1 FROM edits GROUP BY x, y, z), a AS (SELECT DISTINCT x >> 4 AS cx, y >> 4 AS cy, z >> 4 AS cz FROM edits WHERE v = 0)
SELECT x, y, z, arg_max(v, k) AS v FROM l JOIN a ON l.x >> 4 = cx AND l.y >> 4 = cy AND l.z >> 4 = cz GROUP BY x, y, z HAVING arg_max(v, k) <> 0"""
query("export_chunks", "WITH b AS (SELECT x - min(x) OVER () AS x, y - min(y) OVER () + 4 AS y, z - min(z) OVER () AS z, block FROM blocks) SELECT x >> 9 AS rx, z >> 9 AS rz, x >> 4 AS cx, z >> 4 AS cz, CAST(floor(y / 16) AS INT) AS section_y, array_to_string(list_sort(list(DISTINCT block)), ' ') AS palette, count(*) AS n FROM b GROUP BY ALL")(
    lambda v: W.export_chunks(blocks(v), ground=False).select("rx", "rz", "cx", "cz", "section_y", F.array_join("palette", " ").alias("palette"), "n")
)
query("unpack_chunks", "SELECT x - min(x) OVER () AS x, y - min(y) OVER () + 4 AS y, z - min(z) OVER () AS z, block FROM blocks")(lambda v: W.unpack_chunks(W.export_chunks(blocks(v), ground=False)))
query("state_signatures", "SELECT split_part(block, '[', 1) AS base, concat_ws(';', CASE WHEN block LIKE '%facing=%' THEN 'facing=' || regexp_extract(block, 'facing=(\\w+)', 1) END, CASE WHEN block LIKE '%half=%' THEN 'half=' || regexp_extract(block, 'half=(\\w+)', 1) END) AS signature, count(*) AS n FROM block_states GROUP BY 1, 2")(lambda v: W.state_signatures(v("block_states"), ["facing", "half"]))
_found = lambda name, n, ok: f"SELECT '{name}' AS \"check\", CASE WHEN {n} = 0 THEN 'absent' WHEN {ok} THEN 'present-valid' ELSE 'present-broken' END AS status, {n} AS n FROM c"
query("capability_checks", """WITH s AS (SELECT split_part(block, '[', 1) AS base, block LIKE '%facing=%' AS faced, block LIKE '%half=lower%' AS lower, block LIKE '%half=upper%' AS upper, block LIKE '%type=%' AS typed FROM block_states),
c AS (SELECT count(*) FILTER (base LIKE '%\\_door' ESCAPE '\\') AS doors, count(*) FILTER (base LIKE '%\\_door' ESCAPE '\\' AND lower) AS lowers, count(*) FILTER (base LIKE '%\\_door' ESCAPE '\\' AND upper) AS uppers, count(*) FILTER (base LIKE '%\\_door' ESCAPE '\\' AND faced) AS faces,
  count(*) FILTER (base LIKE '%\\_stairs' ESCAPE '\\') AS stairs, count(*) FILTER (base LIKE '%\\_stairs' ESCAPE '\\' AND faced) AS stairs_ok, count(*) FILTER (base LIKE '%\\_slab' ESCAPE '\\') AS slabs, count(*) FILTER (base LIKE '%\\_slab' ESCAPE '\\' AND typed) AS slabs_ok FROM s)
""" + " UNION ALL ".join((_found("doors", "doors", "lowers > 0 AND uppers > 0 AND faces > 0"), _found("stairs", "stairs", "stairs_ok = stairs"), _found("slabs", "slabs", "slabs_ok = slabs"))))(lambda v: W.capability_checks(v("block_states")))

_SQL["round_trip_check"] = _SQL["capability_checks"].replace("FROM block_states)", "FROM (SELECT DISTINCT x, y, z, block FROM block_states))") + " UNION ALL SELECT 'lost', 'same', 0 UNION ALL SELECT 'added', 'same', 0"


def _coloured(v: View) -> DataFrame:
    return V.style_blocks(blocks(v), v("style_dim")).select("x", "y", "z", "r", "g", "b")


STYLED = "SELECT b.x, b.y, b.z, coalesce(r, 190) AS r, coalesce(g, 120) AS g, coalesce(s.b, 120) AS b FROM blocks b LEFT JOIN style_dim s ON s.block = b.block"
for _view, _h, _v, _d in (("plan", "x", "z", "y"), ("front", "x", "y", "-z"), ("side", "z", "y", "-x")):
    query(f"raster_ortho_{_view}", f"""WITH s AS ({STYLED}), d AS (SELECT *, {_d} AS depth FROM s), m AS (SELECT min({_h}) AS h0, max({_v}) AS v1, min(depth) AS d0, max(depth) AS d1 FROM d),
k AS (SELECT {_h} - h0 + 2 AS px, v1 - {_v} + 2 AS py, d.*, CAST(0.55 AS DOUBLE) + (1 - CAST(0.55 AS DOUBLE)) * (depth - d0) / greatest(1, d1 - d0) AS sh FROM d CROSS JOIN m), q AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth DESC, y DESC, x DESC, z DESC) AS rn FROM k)
SELECT px, py, CAST(floor(r*sh) AS INT) AS r, CAST(floor(g*sh) AS INT) AS g, CAST(floor(b*sh) AS INT) AS b FROM q WHERE rn = 1""")(lambda v, _view=_view: W.raster_ortho(_coloured(v), _view))
query("raster_iso", f"""WITH s AS ({STYLED}), d AS (SELECT *, x + y + z AS depth, x - z AS sx, (x + z) / 2 - y AS sy FROM s), m AS (SELECT min(sx) AS x0, min(sy) AS y0, min(depth) AS d0, max(depth) AS d1 FROM d),
k AS (SELECT sx - x0 + 4 AS px, CAST(round_even(sy - y0, 0) AS INT) + 4 AS py, d.*, 0.5::DOUBLE + 0.5::DOUBLE * (depth - d0) / greatest(1, d1 - d0) AS sh FROM d CROSS JOIN m), q AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth DESC, y DESC, x DESC, z DESC) AS rn FROM k)
SELECT px, py, CAST(floor(r*sh) AS INT) AS r, CAST(floor(g*sh) AS INT) AS g, CAST(floor(b*sh) AS INT) AS b FROM q WHERE rn = 1""")(lambda v: W.raster_iso(_coloured(v)))

# -- sessions --------------------------------------------------------------------------------------------------------
_FIRSTS = ("kind", "ip", "token", "name")
query("session_rollup", f"""SELECT session_id, min(ts) AS connected, max(ts) AS last_seen, {", ".join(f"arg_min({c}, (ts, event_id)) FILTER ({c} IS NOT NULL) AS first_{c}" for c in _FIRSTS)},
  {", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for k, n in E.COUNTERS.items())} FROM session_log GROUP BY session_id""")(lambda v: E.session_rollup(v("session_log"), _FIRSTS))
query("server_report", "SELECT count(*) AS sessions, count(*) FILTER (kind <> 'leave') AS online, CAST(epoch(max(last)) AS BIGINT) - CAST(epoch(min(first)) AS BIGINT) AS uptime, 'north' AS region FROM (SELECT session_id, arg_max(kind, (ts, event_id)) AS kind, date_trunc('second', min(ts)) AS first, date_trunc('second', max(ts)) AS last FROM session_log GROUP BY session_id)")(
    lambda v: E.server_info(v("session_log"), *v("session_log").agg(F.min("ts"), F.max("ts")).first(), "north")
)
query("online_players", "SELECT session_id, name FROM (SELECT session_id, arg_max(kind, (ts, event_id)) AS kind, arg_min(name, (ts, event_id)) FILTER (name IS NOT NULL) AS name FROM session_log GROUP BY session_id) WHERE kind <> 'leave'")(lambda v: E.online_players(v("session_log")))
query("server_info", "SELECT count(*) AS sessions, count(*) FILTER (kind <> 'leave') AS online FROM (SELECT session_id, arg_max(kind, (ts, event_id)) AS kind FROM session_events GROUP BY session_id)")(lambda v: E.server_info(v("session_events")))
query("player_ping", "SELECT session_id, coalesce(CAST(CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS VARCHAR), 'disc') AS ping FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS rn FROM session_events) WHERE rn <= 30 GROUP BY session_id")(lambda v: E.player_ping(v("session_events")))
query("rolling_mean", "SELECT session_id, event_id, round(avg(latency_ms) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM session_events")(lambda v: E.rolling_mean(v("session_events"), "session_id", ["ts", "event_id"], "latency_ms", 10).select("session_id", "event_id", F.round("mean", 6).alias("mean")))
query("recent_n", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM messages) WHERE rn <= 2")(lambda v: E.recent_n(v("messages"), "conv_id", "turn", 2).select("conv_id", "turn"))
query("throttle", """WITH RECURSIVE t AS (SELECT session_id, CAST(epoch_us(ts) AS DOUBLE) AS t FROM session_events), a AS (SELECT session_id, min(t) AS t FROM t GROUP BY session_id UNION ALL
  SELECT a.session_id, (SELECT min(t.t) FROM t WHERE t.session_id = a.session_id AND t.t > a.t + 3600000000.0) AS t FROM a WHERE a.t IS NOT NULL) SELECT session_id, t FROM a WHERE t IS NOT NULL""")(
    lambda v: E.throttle(v("session_events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "session_id", "us", 3600e6)
)
_SQL["stream_throttle"] = _SQL["throttle"]
query("session_pairing", "SELECT session_id, event_id, ts, CASE WHEN nk = 'leave' THEN nt END AS left_at, CASE WHEN nk = 'leave' THEN epoch_us(nt) - epoch_us(ts) END AS micros FROM (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt FROM session_events WHERE kind IN ('join', 'leave') WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) WHERE kind = 'join'")(lambda v: E.session_pairing(v("session_events")))
query("expire_ttl", "SELECT event_id FROM session_events WHERE ts + CASE WHEN kind = 'bp' THEN INTERVAL 90 DAY ELSE INTERVAL 60 DAY END >= (SELECT max(ts) FROM session_events)")(
    lambda v: E.expire_ttl(v("session_events").withColumnRenamed("ts", "created"), v("session_events").agg(F.max("ts")).first()[0], v("name_dim").sparkSession.createDataFrame([(k, 86400 * (90 if k == "bp" else 60)) for k in ("bm", "bp", "cr", "join", "leave")], "kind string, ttl_seconds int")).select("event_id")
)
query("deny_list_anti", "SELECT DISTINCT session_id FROM session_events WHERE session_id NOT IN (SELECT token FROM deny) AND session_id % 23 NOT IN (SELECT ip_bucket FROM deny)")(
    lambda v: E.deny_list_anti(v("session_events").select("session_id", F.col("session_id").alias("token"), (F.col("session_id") % 23).alias("ip_bucket")).distinct(), v("deny")).select("session_id")
)
query("stat_metrics", "SELECT kind, count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, round(CASE WHEN avg(latency_ms) > 0 THEN 1000 / avg(latency_ms) END, 6) AS rate FROM session_events GROUP BY kind")(lambda v: E.stat_metrics(v("session_events"), "kind", "latency_ms"))

# -- recipes, registries, profiles -----------------------------------------------------------------------------------
query("recipe_bom", "SELECT grid_id AS ordinal, 'grid' AS output, item, count(*) AS n FROM craft_slots WHERE item IS NOT NULL GROUP BY grid_id, item")(lambda v: C.recipe_bom(v("craft_slots").select(F.col("grid_id").alias("ordinal"), F.lit("grid").alias("output"), "item")))
SIG = "string_agg(CAST(r - r0 AS VARCHAR) || ':' || CAST({c} AS VARCHAR) || ':' || item, '|' ORDER BY CAST(r - r0 AS VARCHAR) || ':' || CAST({c} AS VARCHAR) || ':' || item)"
query("match_shaped", f"""WITH b AS (SELECT ordinal, output, mirrored, r, c, item, min(r) OVER (PARTITION BY ordinal) AS r0, min(c) OVER (PARTITION BY ordinal) AS c0, max(c) OVER (PARTITION BY ordinal) AS c1 FROM recipe_dim WHERE NOT shapeless AND item IS NOT NULL),
k AS (SELECT ordinal, output, {SIG.format(c='c - c0')} AS s FROM b GROUP BY ordinal, output UNION SELECT ordinal, output, {SIG.format(c='c1 - c')} FROM b WHERE mirrored GROUP BY ordinal, output),
g AS (SELECT *, min(r) OVER (PARTITION BY grid_id) AS r0, min(c) OVER (PARTITION BY grid_id) AS c0 FROM craft_slots), h AS (SELECT grid_id, {SIG.format(c='c - c0')} AS s FROM g GROUP BY grid_id)
SELECT grid_id, arg_min(output, ordinal) AS output FROM h JOIN k USING (s) GROUP BY grid_id""")(lambda v: C.match_shaped(v("craft_slots"), v("recipe_dim")))
query("match_shapeless", """WITH n AS (SELECT ordinal, output, count(*) AS size FROM recipe_dim WHERE shapeless GROUP BY ALL), f AS (SELECT grid_id, count(*) AS filled FROM craft_slots GROUP BY grid_id)
SELECT f.grid_id, arg_min(output, ordinal) AS output FROM f JOIN n ON size = filled WHERE NOT EXISTS (SELECT 1 FROM recipe_dim i WHERE i.ordinal = n.ordinal AND i.item NOT IN (SELECT item FROM craft_slots s WHERE s.grid_id = f.grid_id)) GROUP BY f.grid_id""")(lambda v: C.match_shapeless(v("craft_slots"), v("recipe_dim")))
query("assign_ids", "SELECT s_name AS name, row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier")(lambda v: C.assign_ids(v("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ordinal"))).select("name", "id"))
query("search_registry", "SELECT DISTINCT p_name AS name FROM part WHERE regexp_matches(p_name, 'a.*e')")(lambda v: C.search_registry(v("part").select(F.col("p_name").alias("name"), F.lit("item").alias("kind"), F.col("p_partkey").alias("ordinal")), "a.*e").select("name").distinct())
TYPES = "SELECT ifc_type, count(*) AS n, count(*) FILTER (has_representation) AS n_represented, count(*) FILTER (ifc_type IN (SELECT ifc_type FROM exclude_dim)) AS n_excluded, count(*) FILTER (ifc_type = 'IfcDoor') AS n_doors FROM elements GROUP BY ifc_type"
query("type_counts", TYPES)(lambda v: P.type_counts(v("elements")))
query("top_types", f"{TYPES} ORDER BY n DESC, ifc_type LIMIT 5")(lambda v: P.top_types(P.type_counts(v("elements")), 5))
SAMPLE = "SELECT element_id, x0 FROM (SELECT *, row_number() OVER (ORDER BY element_id) AS rn, count(*) OVER () AS cnt FROM elements) WHERE (rn - 1) % greatest(1, cnt // 160) = 0 AND has_representation ORDER BY element_id LIMIT 40"
query("systematic_sample", SAMPLE)(lambda v: P.systematic_sample(v("elements"), "element_id").select("element_id", "x0"))
query("geometry_scale", f"SELECT count(*) AS n, CAST(max(x0) AS DOUBLE) AS greatest, quantile_cont(x0, 0.5) AS median, CASE WHEN quantile_cont(x0, 0.5) < 5000 THEN 'METRES' ELSE 'MILLIMETRES' END AS unit FROM ({SAMPLE})")(lambda v: P.geometry_scale(P.systematic_sample(v("elements"), "element_id"), "x0"))
query("dominant_material", "SELECT element_id, material_id FROM (SELECT element_id, material_id, row_number() OVER (PARTITION BY element_id ORDER BY count(*) DESC, min(face_no), material_id) AS rn FROM face_materials WHERE material_id >= 0 GROUP BY element_id, material_id) WHERE rn = 1")(lambda v: P.dominant_material(v("face_materials")))
query("material_name_counts", """WITH t AS (SELECT ifc_type, material AS name, count(*) AS n FROM elements GROUP BY ALL) (SELECT 'all' AS scope, '' AS key, material AS name, count(*) AS n FROM elements GROUP BY material ORDER BY n DESC, name LIMIT 25)
UNION ALL SELECT 'type', ifc_type, name, n FROM (SELECT *, row_number() OVER (PARTITION BY ifc_type ORDER BY n DESC, name) AS rn FROM t) WHERE rn <= 3""")(lambda v: P.material_name_counts(v("elements").select("ifc_type", F.col("material").alias("name"))))
_ENDS = ", ".join(f"{f}({e}_{c}) FILTER (n_faces > 0) AS {f}_{c}" for c in "xyz" for f, e in (("min", "low"), ("max", "high")))
query("mesh_summary", f"SELECT count(*) AS total, count(*) FILTER (n_faces > 0) AS converted, count(*) FILTER (n_faces = 0) AS skipped, CAST(sum(n_vertices) FILTER (n_faces > 0) AS BIGINT) AS vertices, CAST(sum(n_faces) FILTER (n_faces > 0) AS BIGINT) AS faces, {_ENDS} FROM meshes")(lambda v: P.mesh_summary(v("meshes")))
query("rejected_meshes", "SELECT mesh_id, 'no faces' AS error FROM meshes WHERE n_faces = 0 ORDER BY mesh_id LIMIT 50")(lambda v: P.rejected_meshes(v("meshes")).select("mesh_id", "error"))
query("solid_faces", "SELECT coalesce(c.cls, 'other') AS cls, count(*) AS n_faces FROM face_materials f JOIN elements e ON e.element_id = f.element_id LEFT JOIN class_dim c ON c.ifc_type = e.ifc_type WHERE has_representation AND e.ifc_type <> 'IfcDoor' AND e.ifc_type NOT IN (SELECT ifc_type FROM exclude_dim) GROUP BY 1")(lambda v: P.solid_faces(v("elements"), v("face_materials"), v("class_dim"), v("exclude_dim")))
query("material_colours", f"""WITH d AS ({_SQL["dominant_material"]}), o AS (SELECT e.ifc_type, m.name, round(r, 2) AS r, round(g, 2) AS g, round(b, 2) AS b FROM d JOIN materials m ON m.element_id = d.element_id AND m.material_id = d.material_id JOIN elements e ON e.element_id = d.element_id),
t AS (SELECT ifc_type, name, r, g, b, count(*) AS n FROM o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ifc_type ORDER BY n DESC, name, r NULLS FIRST, g NULLS FIRST, b NULLS FIRST) AS rn FROM t)
(SELECT 'all' AS scope, '' AS key, name, CAST(NULL AS DOUBLE) AS r, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS b, count(*) AS n FROM o GROUP BY name ORDER BY n DESC, name LIMIT 25)
UNION ALL SELECT 'type', ifc_type, name, r, g, b, n FROM k WHERE rn <= 3 UNION ALL SELECT 'with', '', '', NULL, NULL, NULL, count(DISTINCT element_id) FROM materials""")(lambda v: P.material_colours(v("elements"), v("face_materials"), v("materials")))
query("storeys_by_elevation", "SELECT name, elevation FROM storeys")(lambda v: P.storeys_by_elevation(v("storeys")))
query("datasets_by_size", "SELECT n_name AS name, count(c_custkey) AS count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")(lambda v: P.datasets_by_size(v("nation").join(v("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("count"))))
query("run_summary")(lambda v: P.run_summary(bounds=V.bounds(voxels(v), "x", "y", "z"), size=V.footprint(blocks(v), 1.0), server=E.server_info(v("session_events"))))
query("inspect_model")(lambda v: P.inspect_model(v("elements"), v("storeys"), "x0"))

_PAIRS = lambda src, key: f"(SELECT string_agg(name || '=' || n, ' ' ORDER BY n DESC, name) FROM (SELECT {key} AS name, count(*) AS n FROM {src} GROUP BY 1))"
_text_of = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["n"].cast("string"))), " ")


@query("model_summary", f"SELECT CAST(1.0 AS DOUBLE) AS pitch, 'air' AS door_mode, (SELECT min(x) FROM voxels) AS min_x, (SELECT max(z) + 1 FROM voxels) AS dim_z, {_PAIRS('voxel_hits', 'cls')} AS hits, {_PAIRS('voxels', 'block')} AS blocks, {_PAIRS('elements', 'ifc_type')} AS types")
def _(v):
    """The record of a run, with its lists as texts."""
    one = P.run_summary({"pitch": 1.0, "door_mode": "air"}, bounds=V.bounds(voxels(v), "x", "y", "z"), hits=P.listed(v("voxel_hits"), "cls"), blocks=P.listed(voxels(v), "block"), types=P.listed(v("elements"), "ifc_type"))
    return one.select("pitch", "door_mode", "bounds.min_x", "bounds.dim_z", *(_text_of(F.col(c)).alias(c) for c in ("hits", "blocks", "types")))


@query("model_report", f"""SELECT n, (SELECT count(*) FROM elements WHERE has_representation) AS n_represented, (SELECT count(*) FROM storeys) AS storeys, (SELECT min(elevation) FROM storeys) AS lowest, s.greatest, s.median, s.unit, CAST(0.1 AS DOUBLE) AS metres,
  (SELECT string_agg(ifc_type || '=' || n, ' ' ORDER BY n DESC, ifc_type) FROM (SELECT ifc_type, count(*) AS n FROM elements GROUP BY ifc_type ORDER BY n DESC, ifc_type LIMIT 40)) AS types FROM (SELECT count(*) AS n FROM elements) CROSS JOIN ({_SQL["geometry_scale"]}) s(sampled, greatest, median, unit)""")
def _(v):
    """``inspect_model`` with its list as a text."""
    one = P.inspect_model(v("elements"), v("storeys"), "x0", "deci")
    types = F.array_join(F.transform("top.types", lambda t: F.concat(t["ifc_type"], F.lit("="), t["n"].cast("string"))), " ")
    return one.select("elements.n", "elements.n_represented", F.col("storeys.n").alias("storeys"), "storeys.lowest", "scale.greatest", "scale.median", "scale.unit", "unit.metres", types.alias("types"))


@query("stamp_summary", f"""WITH t AS (SELECT coalesce(n.target, 'stone') AS target, n.target IS NULL AS bare, b.block AS base FROM blocks b LEFT JOIN name_dim n ON n.block = b.block WHERE b.block NOT LIKE 'minecraft:oak%'), s AS (SELECT count(*) FILTER (block LIKE 'minecraft:oak%') AS skipped, max(x) + 1 AS dim_x, max(y) + 1 AS dim_y, max(z) + 1 AS dim_z FROM blocks)
SELECT dim_x, dim_y, dim_z, (SELECT count(*) FROM t) AS total, skipped, CAST(-floor((dim_x - 1) / 2) AS BIGINT) AS offset_x, 5 AS offset_y, CAST(-floor((dim_z - 1) / 2) AS BIGINT) AS offset_z, {_PAIRS('t', 'target')} AS counts, coalesce((SELECT string_agg(DISTINCT base, ' ' ORDER BY base) FROM t WHERE bare), '') AS unmapped FROM s""")
def _(v):
    from ..operators import export as X

    one = X.stamp_summary(blocks(v), v("name_dim"), skip_prefixes=["minecraft:oak"])
    return one.withColumns({"counts": _text_of(F.col("counts")), "unmapped": F.array_join("unmapped", " ")})


# -- scalar functions ------------------------------------------------------------------------------------------------
query("parse_block_state", "SELECT id, split_part(block, '[', 1) AS base, CASE WHEN block LIKE '%facing=%' THEN regexp_extract(block, 'facing=(\\w+)', 1) END AS facing, CASE WHEN block LIKE '%half=%' THEN regexp_extract(block, 'half=(\\w+)', 1) END AS half FROM block_states")(
    lambda v: v("block_states").select("id", S.parse_block_state("block").alias("s")).select("id", "s.base", F.try_element_at("s.props", F.lit("facing")).alias("facing"), F.try_element_at("s.props", F.lit("half")).alias("half"))
)
query("format_block_state", "SELECT element_id, 'minecraft:oak_door[facing=' || CASE WHEN dx <= dy THEN 'east' ELSE 'south' END || ',half=lower]' AS block FROM elements")(lambda v: v("elements").select("element_id", S.format_block_state(F.lit(dims.DOOR_BLOCK), facing=S.door_facing("dx", "dy"), half=F.lit("lower")).alias("block")))
query("door_axis", "SELECT id, CASE WHEN block LIKE '%facing=east%' OR block LIKE '%facing=west%' THEN 'door_x' ELSE 'door_z' END AS axis FROM block_states")(lambda v: v("block_states").select("id", S.door_axis("block").alias("axis")))
query("snap", "SELECT element_id, CAST(greatest(0, least(round_even((x0 - 10) / 4.0, 0), 99)) AS INT) AS ix FROM elements")(lambda v: v("elements").select("element_id", S.snap("x0", 10, 4.0, F.lit(100)).alias("ix")))
query("pack_key", "SELECT x0 + y0 * 480 + z0 * 480 * 400 AS key, x0 AS x, y0 AS y, z0 AS z FROM elements")(lambda v: v("elements").select(S.pack_key("x0", "y0", "z0", 480, 400).alias("key")).withColumn("u", S.unpack_key("key", 480, 400)).select("key", "u.*"))
query("cell_id", "SELECT x, y, z, CAST(floor(x/16) AS INT) || ',' || CAST(floor(y/16) AS INT) || ',' || CAST(floor(z/16) AS INT) AS id, (y & 15) * 256 + (z & 15) * 16 + (x & 15) AS off, CAST(floor(x/16)*16 AS INT) AS ox FROM blocks")(lambda v: blocks(v).select("x", "y", "z", S.cell_id("x", "y", "z").alias("id"), S.voxel_offset("x", "y", "z").alias("off")).withColumn("ox", S.cell_origin("id")["x"]))
query("unit_factor", "SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 WHEN 2 THEN 0.1 WHEN 3 THEN 1000 WHEN 4 THEN 0.000001 ELSE 1 END AS DOUBLE) AS factor FROM part")(lambda v: v("part").select("p_partkey", S.unit_factor(F.get(F.array(*map(F.lit, ("MILLI", "CENTI", "DECI", "KILO", "MICRO", ""))), F.col("p_size") % 6)).alias("factor")))
query("door_facing", "SELECT element_id, CASE WHEN x1-x0 <= y1-y0 THEN 'east' ELSE 'south' END AS facing, CAST(coalesce(least(greatest(1, round_even(width_dm/10.0, 0)), 3), 1) AS INT) AS leaves FROM doors")(lambda v: v("doors").select("element_id", S.door_facing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("facing"), S.leaf_count("width_dm", 10.0, F.lit(3)).alias("leaves")))
query("collapse_spaces", "SELECT conv_id, turn, length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]{2,}', ' ', 'g')) AS n FROM messages")(lambda v: v("messages").select("conv_id", "turn", F.length(S.collapse_spaces("text")).cast("long").alias("n")))
# The SQL's engine can't look around, so a sign between two words needs a second pass.
_alone = lambda text: f"regexp_replace({text}, '(^|[^\\pL\\pM\\pN_])(?:the|und|les)([^\\pL\\pM\\pN_]|$)', '\\1****\\2', 'gi')"
query("mask_words", f"SELECT conv_id, turn, md5({_alone(_alone('text'))}) AS h FROM messages")(lambda v: v("messages").select("conv_id", "turn", F.md5(S.mask_words("text", ["the", "und", "les"])).alias("h")))
query("safe_name")(lambda v: v("supplier").select("s_suppkey", S.safe_name(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")), ["nobody"], "s_suppkey").alias("name")))
