"""Readers of block tables, elements, world stamps, saved deltas, recipes, session logs and dataset catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.world import rle_decode
from ..plans.dims import DEFAULT_BLOCK
from .block_table import read_block_table


def scan_blocks(spark: SparkSession, path: str, default_block: str = DEFAULT_BLOCK) -> DataFrame:
    """x, y, z, block of CSV files (see ``BlockTable``): columns by name, quoted states or bare commas, a default for blanks."""
    return read_block_table(spark, path, default_block)


ELEMENTS = "element_id long, ifc_type string, name string, material string, has_representation boolean"
TRIANGLES = "element_id long, cls string, face_no int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")


def _typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table whose columns of the schema are there and take its types; other columns follow unchanged."""
    found, wanted = spark.read.parquet(path), StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in found.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found.select(*(F.col(f.name).cast(f.dataType) for f in wanted), *(f"`{c}`" for c in found.columns if c not in wanted.names))


def scan_elements(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, ELEMENTS)


def scan_triangles(spark: SparkSession, path: str) -> DataFrame:
    """Triangles with corners a, b, c in metres."""
    return _typed(spark, path, TRIANGLES)


def scan_world_stamp(spark: SparkSession, path: str) -> DataFrame:
    """name, x, y, z of stamps: lines of JSON with ``blocks``, a map of names to points."""
    rows = spark.read.text(path).select(F.from_json("value", "blocks map<string,array<array<int>>>").alias("s"))
    return rows.select(F.explode("s.blocks").alias("name", "points")).select("name", F.explode("points").alias("p")).select("name", *(F.get("p", k).alias(c) for k, c in enumerate("xyz")))


def scan_saved_deltas(spark: SparkSession, path: str) -> DataFrame:
    """cx, cy, cz, off, v of saves: lines of JSON with ``deltas``, a map of cell ids to run lengths; untouched cells (0) left out."""
    rows = spark.read.text(path).select(F.from_json("value", "deltas map<string,array<int>>").alias("s")).select(F.explode("s.deltas").alias("id", "rle"))
    part = F.split("id", ",")
    return rle_decode(rows.select(*(F.get(part, k).cast("int").alias(f"c{c}") for k, c in enumerate("xyz")), "rle")).where("v > 0").withColumn("v", F.col("v") - 1)


def scan_recipes(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, output, count, shapeless, mirrored, r, c, item of one JSON list of recipes (a bounded catalogue)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<output:string,count:int,grid:string,shapeless:boolean,mirrored:boolean>>").alias("l"))
    rows = whole.select(F.posexplode("l").alias("ordinal", "x")).select("ordinal", "x.output", "x.count", F.coalesce("x.shapeless", F.lit(False)).alias("shapeless"), F.coalesce("x.mirrored", F.lit(False)).alias("mirrored"), "x.grid")
    grid = F.when(F.col("shapeless"), F.array(F.from_json("grid", "array<string>"))).otherwise(F.from_json("grid", "array<array<string>>"))
    return rows.select("ordinal", "output", "count", "shapeless", "mirrored", F.posexplode(grid).alias("r", "row")).select("ordinal", "output", "count", "shapeless", "mirrored", "r", F.posexplode("row").alias("c", "item"))


def scan_session_log(spark: SparkSession, path: str) -> DataFrame:
    """session_id, date, stat, value of logs: lines of JSON, a map of session ids to a date and stats."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<d:string,s:map<string,string>>>")).alias("session_id", "r"))
    return rows.select("session_id", F.col("r.d").alias("date"), F.explode("r.s").alias("stat", "value"))


def scan_dataset_catalog(spark: SparkSession, glob: str, multi_line: bool = True) -> DataFrame:
    """name, label, count, pitch of one JSON record a file, or of lines of records."""
    schema = "name string, label string, count long, pitch double"
    found = spark.read.schema(schema).option("multiLine", multi_line).json(glob)
    return found.select("name", F.coalesce("label", "name").alias("label"), F.coalesce("count", F.lit(0)).alias("count"), "pitch")
