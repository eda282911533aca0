"""Queries that write files to the shared folder and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as X
from ..operators import neighbors as N
from ..operators import voxels as V
from ..operators import world as W
from ..sources import scan
from .inputs import view
from .storage import new_folder


def _blocks(spark, sf_dir):
    voxels = V.resolve_priority(view(spark, sf_dir, "voxel_hits"), view(spark, sf_dir, "priority_dim"))
    return voxels.select("x", F.col("z").alias("y"), F.col("y").alias("z"), "block")


def scan_blocks(spark, sf_dir):
    path = new_folder(spark, "blocks")
    X.write_blocks(view(spark, sf_dir, "block_states"), path)
    return scan.scan_blocks(spark, path)


def scan_elements(spark, sf_dir):
    path = new_folder(spark, "elements")
    view(spark, sf_dir, "elements").write.parquet(path)
    return scan.scan_elements(spark, path)


def scan_triangles(spark, sf_dir):
    from .registry import _box_triangles

    path = new_folder(spark, "triangles")
    _box_triangles(lambda name: view(spark, sf_dir, name)).write.parquet(path)
    return scan.scan_triangles(spark, path)


def scan_recipes(spark, sf_dir):
    """A catalogue with a recipe for each brand of parts: of one row without a shape, or of two rows with one."""
    path = new_folder(spark, "recipes")
    brands = view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("output")).agg(F.count("*").alias("count"), F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    loose, none = F.col("count") % 2 == 0, F.lit(None).cast("string")
    shapeless = F.to_json(F.struct("output", "count", F.lit(True).alias("shapeless"), F.array("a", "b").alias("grid")))
    shaped = F.to_json(F.struct("output", "count", (F.col("count") % 3 == 0).alias("mirrored"), F.array(F.array("a", none), F.array(none, "b")).alias("grid")))
    entries = brands.agg(F.array_sort(F.collect_list(F.struct("output", F.when(loose, shapeless).otherwise(shaped).alias("json")))).alias("l"))
    entries.select(F.concat(F.lit("["), F.array_join("l.json", ","), F.lit("]")).alias("value")).write.text(path)
    return scan.scan_recipes(spark, path)


def write_blocks(spark, sf_dir):
    path = new_folder(spark, "blocks")
    X.write_blocks(_blocks(spark, sf_dir), path, "parquet")
    return spark.read.parquet(path)


def scan_world_stamp(spark, sf_dir):
    path = new_folder(spark, "stamp")
    X.write_world_stamp(X.export_world_stamp(_blocks(spark, sf_dir), view(spark, sf_dir, "name_dim")), path)
    return scan.scan_world_stamp(spark, path)


def scan_saved_deltas(spark, sf_dir):
    path = new_folder(spark, "deltas")
    X.write_saved_deltas(W.save_world(view(spark, sf_dir, "edits")), path)
    return scan.scan_saved_deltas(spark, path)


def scan_session_log(spark, sf_dir):
    path = new_folder(spark, "sessions")
    counts = view(spark, sf_dir, "session_events").groupBy("session_id", "kind").agg(F.count("*").cast("string").alias("n"))
    log = counts.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("s"))
    log.select(F.to_json(F.create_map(F.col("session_id").cast("string"), F.struct(F.lit("2024-01-01").alias("d"), "s"))).alias("value")).write.text(path)
    return scan.scan_session_log(spark, path)


def export_grouped_points(spark, sf_dir):
    return X.export_grouped_points(_blocks(spark, sf_dir), view(spark, sf_dir, "style_dim"))[1]


def export_sample_json(spark, sf_dir):
    return X.export_sample_json(_blocks(spark, sf_dir), 100)[0]


def scan_dataset_catalog(spark, sf_dir):
    path = new_folder(spark, "catalog")
    counts = view(spark, sf_dir, "nation").join(view(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("count"))
    X.write_dataset_catalog(counts.withColumn("pitch", F.lit(1.0)), path)
    return scan.scan_dataset_catalog(spark, path, multi_line=False)


def round_trip_check(spark, sf_dir):
    return W.round_trip_check(view(spark, sf_dir, "block_states").select("x", "y", "z", "block").dropDuplicates(["x", "y", "z"]), new_folder(spark, "chunks"))


def model(spark, sf_dir) -> X.Model:
    """Elements as boxes of triangles, and their doors, in decimetres."""
    from .registry import _box_triangles

    get = lambda name: view(spark, sf_dir, name)
    return X.Model(get("elements"), _box_triangles(get), get("doors").withColumnRenamed("width_dm", "width"))


def run_pipeline(spark, sf_dir):
    out = new_folder(spark, "run")
    made = X.run_pipeline(model(spark, sf_dir), *(view(spark, sf_dir, d) for d in ("class_dim", "exclude_dim", "priority_dim", "style_dim")), 4.0, out, metre=10.0)
    return X.write_outputs(made, out, 4.0)


# The corners of a box's twelve triangles, an axis being 1 on its far side.
_SIDES = [s for n, u, w in (("z", "x", "y"), ("x", "y", "z"), ("y", "z", "x")) for far in ("", n) for s in ((far, u + far, w + far), (u + w + far, w + far, u + far))]
_NAMES = [f"{p}{c}" for p in "abc" for c in "xyz"]
_CORNERS = ", ".join(f"f{name}" for name in _NAMES)
_FACES = ", ".join("(" + ", ".join(map(str, (k, *(int(c in far) for far in side for c in "xyz")))) + ")" for k, side in enumerate(_SIDES))
_AT = ", ".join(f"CAST({name[1]}0 + f{name} * d{name[1]} AS DOUBLE) AS {name}" for name in _NAMES)
QUERIES = {f.__name__: f for f in (scan_blocks, scan_elements, scan_triangles, scan_recipes, write_blocks, scan_world_stamp, scan_saved_deltas, scan_session_log, export_grouped_points, export_sample_json, scan_dataset_catalog, round_trip_check, run_pipeline)}
SQL = {
    "scan_elements": "SELECT * FROM elements",
    "scan_triangles": f"""WITH f(face_no, {_CORNERS}) AS (VALUES {_FACES}) SELECT element_id, coalesce(cls, 'other') AS cls, face_no, {_AT} FROM elements e LEFT JOIN class_dim c ON c.ifc_type = e.ifc_type CROSS JOIN f WHERE has_representation""",
    "scan_recipes": """WITH p AS (SELECT p_brand AS output, count(*) AS n, min(p_name) AS a, max(p_name) AS b, row_number() OVER (ORDER BY p_brand) - 1 AS ordinal FROM part GROUP BY p_brand),
i AS (SELECT *, 0 AS r, 0 AS c, a AS item FROM p UNION ALL SELECT *, CAST(n % 2 AS INT), 1, b FROM p UNION ALL SELECT *, 0, 1, NULL FROM p WHERE n % 2 = 1 UNION ALL SELECT *, 1, 0, NULL FROM p WHERE n % 2 = 1)
SELECT CAST(ordinal AS INT) AS ordinal, output, CAST(n AS INT) AS count, n % 2 = 0 AS shapeless, n % 2 = 1 AND n % 3 = 0 AS mirrored, r, c, item FROM i""",
    "scan_blocks": "SELECT x, y, z, block FROM block_states",
    "write_blocks": "SELECT x, y, z, block, x >> 9 AS rx, z >> 9 AS rz FROM blocks",
    "scan_world_stamp": "SELECT coalesce(target, 'stone') AS name, x - CAST(floor((SELECT max(x) FROM blocks) / 2) AS INT) AS x, y + 5 AS y, z - CAST(floor((SELECT max(z) FROM blocks) / 2) AS INT) AS z FROM blocks b LEFT JOIN name_dim n ON n.block = b.block",
    "scan_saved_deltas": "SELECT x >> 4 AS cx, y >> 4 AS cy, z >> 4 AS cz, (y & 15) * 256 + (z & 15) * 16 + (x & 15) AS off, v FROM (SELECT x, y, z, arg_max(v, (ts, event_id)) AS v FROM edits GROUP BY x, y, z)",
    "scan_session_log": "SELECT CAST(session_id AS VARCHAR) AS session_id, '2024-01-01' AS date, kind AS stat, CAST(count(*) AS VARCHAR) AS value FROM session_events GROUP BY session_id, kind",
    "export_grouped_points": "SELECT o.o AS \"offset\", b.x, b.y, b.z FROM blocks b JOIN (SELECT block, CAST(coalesce(sum(n) OVER (ORDER BY n DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM (SELECT block, count(*) AS n FROM blocks GROUP BY block)) o ON o.block = b.block",
    "export_sample_json": "SELECT x, y, z, block FROM blocks ORDER BY x, y, z LIMIT 100",
    "scan_dataset_catalog": "SELECT n_name AS name, n_name AS label, count(c_custkey) AS count, CAST(1.0 AS DOUBLE) AS pitch FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
}
