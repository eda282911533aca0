"""Queries that take the whole tables, against brute force on small fixtures."""

import hashlib
import math
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from latticeworks.operators import voxels as V
from latticeworks.plans import registry


def _outside(walls):
    """Empty cells of the walls' box that a path of empty cells joins with its border."""
    lo, hi = [min(c) for c in zip(*walls)], [max(c) for c in zip(*walls)]
    empty = {(x, y, z) for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1) for z in range(lo[2], hi[2] + 1)} - walls
    todo = [c for c in empty if any(a in (b, d) for a, b, d in zip(c, lo, hi))]
    seen = set(todo)
    while todo:
        x, y, z = todo.pop()
        for c in ((x + 1, y, z), (x - 1, y, z), (x, y + 1, z), (x, y - 1, z), (x, y, z + 1), (x, y, z - 1)):
            if c in empty and c not in seen:
                seen.add(c)
                todo.append(c)
    return empty, seen


def test_fill_takes_every_voxel(spark, tmp_path):
    rng = random.Random(4)
    shell = {(x - 246, y + 5, z) for x in range(5) for y in range(5) for z in range(1, 6) if x in (0, 4) or y in (0, 4) or z in (1, 5)}
    noise = {(x, y, z) for x in range(-20, -8) for y in range(20, 32) for z in range(1, 8) if rng.random() < 0.7}
    walls = shell | noise  # at negative x only, and of low priority
    rows = [(x + 256, y, z, float(i % 3)) for i, (x, y, z) in enumerate(sorted(walls))]
    pq.write_table(pa.table(dict(zip(("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), map(list, zip(*rows))))), tmp_path / "lineitem.parquet")
    empty, outside = _outside(walls)
    got = [tuple(r) for r in registry.queries()["fill_enclosed"](spark, str(tmp_path)).collect()]
    assert len(got) > 27 and sorted(got) == sorted(empty - outside)


def _cells(a, b, c, pitch):
    """Cells of a triangle's points half a pitch apart at most."""
    n = 2 ** max(0, math.ceil(math.log2(max(math.dist(a, b), math.dist(b, c), math.dist(a, c)) * 2 / pitch)))
    return {tuple(max(0, round((p + i / n * (q - p) + j / n * (r - p)) / pitch)) for p, q, r in zip(a, b, c)) for i in range(n + 1) for j in range(n + 1 - i)}


@pytest.mark.parametrize("k_max", [0, 2, 12])
def test_large_triangles_have_no_gaps(spark, k_max):
    triangles = [((0.0, 0.0, 0.0), (33.0, 3.0, 1.0), (5.0, 29.0, 7.0)), ((1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (1.0, 2.0, 3.0))]
    rows = [("wall", i, 0, *map(float, sum(t, ()))) for i, t in enumerate(triangles)]
    df = spark.createDataFrame(rows, "cls string, element_id long, face_no int, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    got = [(r.x, r.y, r.z) for r in V.voxelize_surface(df, 1.0, (0.0, 0.0, 0.0), k_max).collect()]
    want = set().union(*(_cells(*t, 1.0) for t in triangles))
    assert len(got) == len(set(got)) and set(got) == want


def test_every_side_of_every_element(spark, tmp_path):
    keys = [1, 2, 3, 4, 40]  # element 3 has no geometry
    pq.write_table(pa.table({"p_partkey": keys, "p_name": ["n"] * 5, "p_brand": ["b"] * 5, "p_size": pa.array([11, 5, 9, 0, 23], pa.int32())}), tmp_path / "part.parquet")
    want = set()
    for k, size in zip(keys, (11, 5, 9, 0, 23)):
        if k % 10 == 3:
            continue
        lo = ((k * 37) % 480, (k * 53) % 400, (k * 11) % 120)
        hi = tuple(a + d for a, d in zip(lo, (1 + size % 12, 1 + (k * 7) % 30, 2 + (k * 5) % 28)))
        for axis in range(3):
            for end in (lo, hi):
                u, w = [i for i in range(3) if i != axis]
                corner = lambda far: tuple(end[i] if i == axis else hi[i] if i in far else lo[i] for i in range(3))
                want |= _cells(corner(()), corner((u,)), corner((w,)), 4.0) | _cells(corner((u, w)), corner((w,)), corner((u,)), 4.0)
    got = [(r.x, r.y, r.z) for r in registry.queries()["voxelize_surface"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len({z for _, _, z in got}) > 5


def test_every_message_is_masked(spark, tmp_path):
    texts = ["The cat", "the the\nTHE the", "théâtre, les élèves", "für und über", "undé éund und_ _und und1 ²und", "Straße und Ärger: LES, Und!", "the\u0301 the", "漢the the漢 the", "", None, "bathe others bundle"]
    roles = ["user", "assistant", "system"]
    rows = [(i, j, role, t) for i, t in enumerate(texts) for j, role in enumerate(roles)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows))))), tmp_path / "conversations.parquet")

    def masked(text):
        if text is None:
            return None
        # Python's words have no combining marks, so these are told apart by a letter in their place.
        inner = re.sub("[\u0300-\u036f]", lambda m: chr(0xE000 + ord(m[0])), text)
        inner = re.sub(r"(?<![\w\ue300-\ue36f])(the|und|les)(?![\w\ue300-\ue36f])", "****", inner, flags=re.I)
        return hashlib.md5(re.sub("[\ue300-\ue36f]", lambda m: chr(ord(m[0]) - 0xE000), inner).encode()).hexdigest()

    got = sorted(tuple(r) for r in registry.queries()["mask_words"](spark, str(tmp_path)).collect())
    assert got == [(i, j, masked(t)) for i, j, _, t in rows]


def test_run_pipeline_writes_every_output(spark, monkeypatch, tmp_path):
    from latticeworks.plans import files

    monkeypatch.setattr(files, "new_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    got = {r.output: (r.format, r["count"]) for r in registry.queries()["run_pipeline"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"blocks", "counts", "chunks", "groups", "points", "plan", "front", "side", "iso", "catalog"}
    assert all(n == spark.read.format(kind).load(f"file://{tmp_path}/run/{output}").count() > 0 for output, (kind, n) in got.items())
    assert got["points"][1] == got["blocks"][1] == spark.read.parquet(f"file://{tmp_path}/run/counts").groupBy().sum("n").first()[0]
    assert {(r.output, r["count"]) for r in spark.read.json(f"file://{tmp_path}/run/manifest").collect()} == {(k, n) for k, (_, n) in got.items()}
