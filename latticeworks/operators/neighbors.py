"""Neighbourhoods: occupied neighbours, shaped stairs and slabs, visible faces, openings, blasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import dims
from ..plans.storage import written

Offset = tuple[int, int, int]
FACES: dict[str, Offset] = {"west": (-1, 0, 0), "east": (1, 0, 0), "down": (0, -1, 0), "up": (0, 1, 0), "north": (0, 0, -1), "south": (0, 0, 1)}


def _exchanged(spread: DataFrame) -> DataFrame:
    """Rows that were spread to cells, for a join: their size is estimated as before the spreading, so they would be broadcast
    through the driver while their source is small."""
    return spread.hint("merge")


def _moved(offset: Offset) -> Column:
    return F.struct(*((F.col(c) - d).alias(c) for c, d in zip("xyz", offset)))


def neighbor_mask(voxels: DataFrame, offsets: list[Offset]) -> DataFrame:
    """Each voxel's cell with ``mask``: bit i tells whether the cell at offset i is occupied.

    Every voxel tells the cells that see it, so one aggregation replaces a join for each offset.
    """
    own = 1 << len(offsets)
    told = F.array(F.struct(F.struct("x", "y", "z").alias("at"), F.lit(own).alias("bit")), *(F.struct(_moved(o).alias("at"), F.lit(1 << i).alias("bit")) for i, o in enumerate(offsets)))
    bits = voxels.select(F.explode(told).alias("t")).select("t.at.*", "t.bit").groupBy("x", "y", "z").agg(F.bit_or("bit").alias("mask"))
    return bits.where(F.col("mask").bitwiseAND(own) != 0).withColumn("mask", F.col("mask").bitwiseAND(own - 1))


def masked(asking: DataFrame, voxels: DataFrame, offsets: list[Offset]) -> DataFrame:
    """asking (distinct cells of few voxels) with ``mask`` as in ``neighbor_mask``: only their own neighbour cells are joined."""
    asked = asking.select("x", "y", "z", F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(f"n{c}") for c, d in zip("xyz", o)), F.lit(1 << i).alias("bit")) for i, o in enumerate(offsets)))).alias("q")).select("x", "y", "z", "q.*")
    there = voxels.select(*(F.col(c).alias(f"n{c}") for c in "xyz"))
    bits = asked.join(there, ["nx", "ny", "nz"], "left_semi").groupBy("x", "y", "z").agg(F.bit_or("bit").alias("mask"))
    return asking.join(bits, ["x", "y", "z"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def _bit(i: int) -> Column:
    return F.col("mask").bitwiseAND(1 << i) != 0


def orient_stairs(voxels: DataFrame) -> DataFrame:
    """Stair cubes with a free top and one or two rises become shaped stairs (z is up).

    A rise is a side whose cell one level higher is occupied, in the order east, west, north, south; the first whose opposite
    cell of the same level is free is chosen, else the first.
    """
    sides: list[tuple[str, int, int]] = [("east", 1, 0), ("west", -1, 0), ("north", 0, 1), ("south", 0, -1)]
    offsets: list[Offset] = [(0, 0, 1), *((dx, dy, 1) for _, dx, dy in sides), *((-dx, -dy, 0) for _, dx, dy in sides)]
    cube = F.col("block").eqNullSafe(dims.STAIR_CUBE)
    mask = masked(voxels.where(cube).select("x", "y", "z").distinct(), voxels, offsets)
    rises = sum(_bit(1 + i).cast("int") for i in range(4))
    facing = F.coalesce(*(F.when(_bit(1 + i) & ~_bit(5 + i), name) for i, (name, _, _) in enumerate(sides)), *(F.when(_bit(1 + i), name) for i, (name, _, _) in enumerate(sides)))
    turned = mask.where(~_bit(0) & rises.isin(1, 2)).select("x", "y", "z", facing.alias("facing"))
    shaped = S.format_block_state(F.lit(dims.STAIR_SHAPED), facing="facing", half=F.lit("bottom"), shape=F.lit("straight"))
    out = voxels.where(cube).join(turned, ["x", "y", "z"], "left")
    out = out.withColumn("block", F.when(F.col("facing").isNotNull(), shaped).otherwise(F.col("block"))).drop("facing")
    return voxels.where(~cube).unionByName(out)


def thin_floor_slabs(voxels: DataFrame) -> DataFrame:
    """Floor cubes with nothing above and below become slabs (z is up)."""
    cube = F.col("block").eqNullSafe(dims.FLOOR_CUBE)
    alone = masked(voxels.where(cube).select("x", "y", "z").distinct(), voxels, [(0, 0, 1), (0, 0, -1)]).where("mask = 0").select("x", "y", "z", F.lit(True).alias("alone"))
    out = voxels.where(cube).join(alone, ["x", "y", "z"], "left")
    out = out.withColumn("block", F.when(F.col("alone"), dims.SLAB_SHAPED).otherwise(F.col("block"))).drop("alone")
    return voxels.where(~cube).unionByName(out)


def box_cells(boxes: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Distinct cells of inclusive boxes (x0..x1, y0..y1, z0..z1), axis by axis; within the box of the cells of limits, if given.

    After the first axis the rows are dealt anew, so a large box isn't one task's work.
    """
    ends = boxes.select(*(F.col(f"{c}{k}").cast("int").alias(f"{c}{k}") for c in "xyz" for k in "01"))
    if limits is not None:
        within = limits.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))  # one row
        ends = ends.crossJoin(F.broadcast(within)).select(*(f(F.col(f"{c}{k}"), F.col(f"{n}{c}")).alias(f"{c}{k}") for c in "xyz" for k, n, f in (("0", "lo", F.greatest), ("1", "hi", F.least))))
    out = ends.where("x0 <= x1 AND y0 <= y1 AND z0 <= z1")
    out = out.select("*", F.explode(F.sequence("x0", "x1")).alias("x")).repartition("x", "y0", "z0")
    for c in "yz":
        out = out.withColumn(c, F.explode(F.sequence(f"{c}0", f"{c}1")))
    return out.select("x", "y", "z").distinct()


def carve_openings(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels outside every box: boxes are clipped to the voxels' own and spread to cells, so it is a hash anti-join and not a
    range join."""
    return voxels.join(_exchanged(box_cells(boxes, voxels)), ["x", "y", "z"], "left_anti")


def occupied_minus_carved(voxels: DataFrame, carved: DataFrame) -> DataFrame:
    return voxels.join(carved.select("x", "y", "z").distinct(), ["x", "y", "z"], "left_anti")


def explode_radius(voxels: DataFrame, blasts: DataFrame) -> DataFrame:
    """Edits (blast_id, x, y, z, v = 0) for voxels of id over 1 within the blasts' radius; the offsets of a sphere are spread."""
    reach = F.sequence(-F.col("radius"), F.col("radius"))
    cells = blasts.select("blast_id", "bx", "by", "bz", "radius")
    for c in "xyz":
        cells = cells.withColumn(f"d{c}", F.explode(reach))
    cells = cells.where("dx * dx + dy * dy + dz * dz <= radius * radius").select("blast_id", (F.col("bx") + F.col("dx")).alias("x"), (F.col("by") + F.col("dy")).alias("y"), (F.col("bz") + F.col("dz")).alias("z"))
    return _exchanged(cells).join(voxels.where("v > 1").select("x", "y", "z"), ["x", "y", "z"]).select("blast_id", "x", "y", "z", F.lit(0).alias("v"))


def in_blasts(points: DataFrame, blasts: DataFrame, block: float = 1.0) -> DataFrame:
    """points (id, x, y, z) with each blast_id that reaches them and ``d2``, the squared distance in blocks (radius**2 at most).

    Blasts are spread to the cells of 16 blocks that their box touches, so it is a hash join.
    """
    size = 16
    where = lambda x: F.floor(x / size).cast("long")
    spread = blasts.select("blast_id", "bx", "by", "bz", "radius")
    for c in "xyz":
        spread = spread.withColumn(f"k{c}", F.explode(F.sequence(where(F.col(f"b{c}") - F.col("radius")), where(F.col(f"b{c}") + F.col("radius")))))
    placed = points.withColumns({f"p{c}": F.col(c) / block for c in "xyz"}).withColumns({f"k{c}": where(F.col(f"p{c}")) for c in "xyz"})
    d2 = sum((F.col(f"p{c}") - F.col(f"b{c}")) * (F.col(f"p{c}") - F.col(f"b{c}")) for c in "xyz")
    near = placed.join(_exchanged(spread), ["kx", "ky", "kz"]).withColumn("d2", d2).where("d2 <= radius * radius")
    return near.select(*points.columns, "blast_id", "radius", "d2")


def surviving_entities(entities: DataFrame, blasts: DataFrame, block: float = 1.0) -> DataFrame:
    """Entities (id, x, y, z) that no blast reaches; each place is tried once, however many entities and blasts share it."""
    places = entities.select("x", "y", "z").distinct()
    alike = blasts.select("bx", "by", "bz", "radius").distinct().withColumn("blast_id", F.lit(None).cast("long"))
    reached = in_blasts(places, alike, block).select("x", "y", "z").distinct()
    return entities.join(entities.join(reached, ["x", "y", "z"], "left_semi").select("id"), "id", "left_anti")


def blast_damage(players: DataFrame, blasts: DataFrame, block: float = 1.0) -> DataFrame:
    """id, blast_id, damage of players (id, x, y, z, mode) in survival mode: up to 15, less by the square of the distance."""
    hit = in_blasts(players.where("mode = 'survival'").select("id", "x", "y", "z"), blasts, block)
    r2 = F.col("radius") * F.col("radius")
    return hit.select("id", "blast_id", F.floor((r2 - F.col("d2")) / r2 * 15).cast("int").alias("damage"))


def visible_faces(voxels: DataFrame, transparent: DataFrame, loaded_cells: DataFrame | None = None, doors: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """Faces (x, y, z, v, face, pass) of voxels (x, y, z, v) that can be seen; y is up, v > 0.

    An opaque voxel shows a face to air, to a cell that isn't loaded, or to another transparent voxel; a transparent one shows
    it to air of loaded cells and to other transparent voxels.  transparent: v.  A door (v, axis 'x' or 'z', open) is a panel
    of two faces whatever is beside it: across its axis and opaque if closed, swung to the other axis and transparent if open;
    beside other voxels it counts as its row in transparent says.  within: cells (cx, cy, cz) whose voxels are asked for.
    """
    t = F.broadcast(transparent.select("v").distinct().withColumn("clear", F.lit(True)))
    marked = voxels.select("x", "y", "z", "v").join(t, "v", "left").withColumn("clear", F.coalesce("clear", F.lit(False)))
    asks = F.lit(True)
    if within is not None:
        cells = {f"c{c}": S.cell_of(c) for c in "xyz"}
        marked = marked.withColumns(cells).join(within.select(*cells).distinct().withColumn("asks", F.lit(True)), list(cells), "left").drop(*cells)
        asks = F.coalesce("asks", F.lit(False))
    marked, panels = marked.withColumn("asks", asks), None
    if doors is not None:
        d = F.broadcast(doors.select("v", "axis", "open").dropDuplicates(["v"]))
        across = F.when((F.col("axis") == "x") != F.col("open"), F.array(F.lit("east"), F.lit("west"))).otherwise(F.array(F.lit("south"), F.lit("north")))
        panels = marked.where("asks").join(d, "v").select("x", "y", "z", "v", F.explode(across).alias("face"), F.when(F.col("open"), "transparent").otherwise("opaque").alias("pass"))
        marked = marked.join(d.select("v", F.lit(True).alias("door")), "v", "left").withColumn("asks", F.col("asks") & F.col("door").isNull()).drop("door")
    # Neighbours along an axis follow each other on their line: three exchanges of the voxels, and no row for each side.
    for c, others in (("x", ("y", "z")), ("y", ("x", "z")), ("z", ("x", "y"))):
        line = Window.partitionBy(*others).orderBy(c)
        for name, get, step in ((f"after_{c}", F.lead, 1), (f"before_{c}", F.lag, -1)):
            near = get(F.struct(F.col(c).alias("at"), "v", "clear")).over(line)
            marked = marked.withColumn(name, F.when(near["at"] == F.col(c) + step, near))
    beside = {n: F.col(f"{'after' if sum(o) > 0 else 'before'}_{'xyz'[[k != 0 for k in o].index(True)]}") for n, o in FACES.items()}
    sides = F.array(*(F.struct(F.lit(n).alias("face"), q["v"].alias("nv"), q["clear"].alias("nclear"), *((F.col(c) + k).alias(f"n{c}") for c, k in zip("xyz", FACES[n]))) for n, q in beside.items()))
    seen = marked.where("asks").select("x", "y", "z", "v", "clear", F.explode(sides).alias("q")).select("x", "y", "z", "v", "clear", "q.*")
    shown = lambda loaded: F.when(F.col("nv").isNull(), ~F.col("clear") | loaded).otherwise(F.col("nclear") & (F.col("nv") != F.col("v")))
    if loaded_cells is None:
        seen = seen.where(shown(F.lit(True)))
    else:
        cells = loaded_cells.select("cx", "cy", "cz").distinct().withColumn("loaded", F.lit(True))
        seen = seen.where(shown(F.lit(True))).withColumns({f"c{c}": S.cell_of(f"n{c}") for c in "xyz"}).join(cells, ["cx", "cy", "cz"], "left")
        seen = seen.where(shown(F.coalesce("loaded", F.lit(False))))
    out = seen.select("x", "y", "z", "v", "face", F.when(F.col("clear"), "transparent").otherwise("opaque").alias("pass"))
    return out if panels is None else out.unionByName(panels)


def preview_boxes(voxels: DataFrame) -> DataFrame:
    return voxels.select("x", "y", "z", F.explode(F.array(*(F.lit(n) for n in FACES))).alias("face"))


def dirty_cells(edits: DataFrame, cell: int = 16) -> DataFrame:
    """Cells that an edit or one of its six neighbours lies in."""
    around = F.array(F.struct("x", "y", "z"), *(F.struct(*((F.col(c) + d).alias(c) for c, d in zip("xyz", o))) for o in FACES.values()))
    return edits.select(F.explode(around).alias("p")).select(*(F.floor(F.col(f"p.{c}") / cell).cast("int").alias(f"c{c}") for c in "xyz")).distinct()


def cells_beyond_radius(cells: DataFrame, viewers: DataFrame, radius: float) -> DataFrame:
    """Cell columns farther than three quarters of the radius from a viewer; viewers: viewer_id, vx, vz (a few rows)."""
    limit = (0.75 * radius) ** 2
    return cells.crossJoin(F.broadcast(viewers)).where((F.col("cx") - F.col("vx")) ** 2 + (F.col("cz") - F.col("vz")) ** 2 > limit)


def within_reach(pairs: DataFrame, limit: float = 5.0, block_size: float = 16.0) -> DataFrame:
    return pairs.where(S.distance(("ax", "bx"), ("ay", "by"), ("az", "bz")) / block_size <= limit)


#: A player's point is so far above its position, in blocks.
EYE = 0.6


def eligible_players(players: DataFrame, now) -> DataFrame:
    """Players (with show_inventory, pickup_delay, mode) that may pick things up at ``now``."""
    free = ~F.coalesce("show_inventory", F.lit(False)) & ~F.coalesce(F.col("pickup_delay") > now, F.lit(False))
    return players.where(free & ~F.coalesce(F.col("mode").isin("spectator", "camera"), F.lit(False)))


def radius_join(entities: DataFrame, players: DataFrame, r: float, width: float = 1.0, eye: float = 0.0) -> DataFrame:
    """Each entity with the first player (by ordinal) nearer than r; places are joined, each once, and then their entities.

    eye: the height of an entity's aim below the player's position, as ``EYE`` times a block's size.
    """
    first = F.min(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "player_id")))
    p = players.withColumn("py", F.col("py") - eye) if eye else players
    near = _near_places(entities, p.groupBy("px", "py", "pz").agg(first.alias("first")), r, max(r, width))
    places = near.groupBy("ex", "ey", "ez").agg(F.min("first").alias("first"))
    return entities.join(places, ["ex", "ey", "ez"]).groupBy("entity_id").agg(F.min("first").alias("first")).select("entity_id", "first.player_id")


def _near_places(entities: DataFrame, players: DataFrame, r: float, size: float) -> DataFrame:
    """Distinct places (ex, ey, ez) of entities with the rows of players (px, py, pz, one a place) nearer than r and their
    distance d; players are spread to the 27 cells of a size around them."""
    cell = lambda c: F.floor(F.col(c) / size)
    e = entities.select("ex", "ey", "ez").distinct().withColumns({f"k{c}": cell(f"e{c}") for c in "xyz"})
    p = players.withColumns({f"k{c}": cell(f"p{c}") for c in "xyz"})
    for c in "xyz":
        p = p.withColumn(f"k{c}", F.explode(F.array(*(F.col(f"k{c}") + d for d in (-1, 0, 1)))))
    return e.join(_exchanged(p), ["kx", "ky", "kz"]).withColumn("d", S.distance(("ex", "px"), ("ey", "py"), ("ez", "pz"))).where(F.col("d") < r)


def pickups(entities: DataFrame, players: DataFrame, now, block: float = 1.0) -> DataFrame:
    """entity_id, player_id, action of entities (entity_id, ex, ey, ez) near players that may take them.

    The first player (by ordinal) nearer than 0.6 blocks picks an entity up; one that nobody picks up is pulled by the last
    player nearer than 1.5 blocks.
    """
    size = 1.5 * block
    free = eligible_players(players, now).withColumn("py", F.col("py") - EYE * block)
    who = F.struct("ordinal", "player_id")
    free = free.groupBy("px", "py", "pz").agg(F.min(who).alias("first"), F.max(who).alias("last"))
    near = _near_places(entities, free, size, size)
    picked = F.min(F.when(F.col("d") < 0.6 * block, F.col("first")))
    places = near.groupBy("ex", "ey", "ez").agg(picked.alias("picked"), F.max("last").alias("last"))
    each = entities.join(places, ["ex", "ey", "ez"]).groupBy("entity_id").agg(F.min("picked").alias("picked"), F.max("last").alias("last"))
    return each.select("entity_id", F.coalesce("picked.player_id", "last.player_id").alias("player_id"), F.when(F.col("picked").isNotNull(), "pick").otherwise("pull").alias("action"))


def mirror_double_doors(cells: DataFrame) -> DataFrame:
    """Hinges of lower door halves (door_id, x, y, z, facing): in a run of L >= 2 the first half right, the rest left; singles left."""
    wide = F.when(F.col("facing") == "east", F.col("y")).otherwise(F.col("x"))
    across = F.when(F.col("facing") == "east", F.col("x")).otherwise(F.col("y"))
    rows = cells.withColumns({"wide": wide, "across": across})
    line = Window.partitionBy("facing", "across", "z").orderBy("wide")
    rows = rows.withColumn("island", F.col("wide") - F.row_number().over(line))
    run = Window.partitionBy("facing", "across", "z", "island")
    rows = rows.withColumn("place", F.row_number().over(run.orderBy("wide")) - 1).withColumn("size", F.count("*").over(run))
    hinge = F.when((F.col("size") >= 2) & (F.col("place") < F.floor(F.col("size") / 2)), "right").otherwise("left")
    return rows.select("x", "y", "z", "facing", "size", hinge.alias("hinge"))


def floor_probe(leaves: DataFrame, voxels: DataFrame) -> DataFrame:
    """leaf_id, floor_z: the highest occupied cell from z + 1 down to z - 3 beside a leaf (leaf_id, x, y, z, facing), or null."""
    side = F.when(F.col("facing") == "east", F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy"))).otherwise(F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    probes = leaves.withColumn("s", side).withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("dz", F.explode(F.sequence(F.lit(-3), F.lit(1))))
    cells = probes.select("leaf_id", (F.col("x") + F.col("sign") * F.col("s.dx")).alias("x"), (F.col("y") + F.col("sign") * F.col("s.dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"))
    hit = _exchanged(cells).join(voxels.select("x", "y", "z").distinct(), ["x", "y", "z"]).groupBy("leaf_id").agg(F.max("z").alias("floor_z"))
    return leaves.select("leaf_id").join(hit, "leaf_id", "left")


def place_doors(voxels: DataFrame, doors: DataFrame, pitch: float, mode: str = "functional") -> DataFrame:
    """Doors (element_id, x0..z1 in cells, inclusive, width) put into voxels (x, y, z, prio, cls, block); z is up.

    ``solid`` fills the boxes with planks, ``air`` only carves them; ``functional`` carves all, then puts leaves of two
    halves or more on the floor found beside them, a threshold below, and mirrors pairs.  Every leaf is placed on the carved
    voxels alone, not on doors placed before it; of leaves in one cell the greatest element_id stays, and of
    halves in one cell the lower one.  A column facing of doors holds instead of the one that their sizes in cells give.
    """
    if mode == "solid":
        cells = box_cells(doors).select("x", "y", "z", F.lit(99).alias("prio"), F.lit("door").alias("cls"), F.lit("minecraft:oak_planks").alias("block"))
        return voxels.join(_exchanged(cells), ["x", "y", "z"], "left_anti").unionByName(cells)
    carved = carve_openings(voxels, doors)
    if mode == "air":
        return carved
    height = S.door_height(pitch)
    ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = doors if "facing" in doors.columns else doors.withColumn("facing", S.door_facing(ex, ey))
    east = F.col("facing") == "east"
    d = d.withColumns({"lo": F.when(east, F.col("y0")).otherwise(F.col("x0")), "hi": F.when(east, F.col("y1")).otherwise(F.col("x1")), "fixed": F.floor(F.when(east, F.col("x0") + F.col("x1")).otherwise(F.col("y0") + F.col("y1")) / 2)})
    d = d.withColumn("n", S.leaf_count("width", pitch, F.col("hi") - F.col("lo") + 1)).withColumn("start", F.greatest("lo", F.floor((F.col("lo") + F.col("hi")) / 2) - F.floor((F.col("n") - 1) / 2)))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("w", F.least(F.col("start") + F.col("i"), "hi")).dropDuplicates(["element_id", "w"])
    leaves = d.select(F.struct("element_id", "w").alias("leaf_id"), "element_id", "facing", F.when(east, F.col("fixed")).otherwise(F.col("w")).cast("int").alias("x"), F.when(east, F.col("w")).otherwise(F.col("fixed")).cast("int").alias("y"), F.col("z0").cast("int").alias("z"))
    found = leaves.join(floor_probe(leaves, carved), "leaf_id").withColumn("z", F.coalesce(F.col("floor_z") + 1, "z"))
    found = found.groupBy("x", "y", "z").agg(F.max_by("facing", "element_id").alias("facing"), F.max("element_id").alias("element_id"))
    hinged = mirror_double_doors(found)
    cells = hinged.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    state = S.format_block_state(F.lit(dims.DOOR_BLOCK), facing="facing", half=F.when(F.col("j") == 0, "lower").otherwise("upper"), hinge="hinge", open=F.lit("false"))
    leaf_cells = cells.select("x", "y", (F.col("z") + F.col("j")).alias("z"), F.lit(100).alias("prio"), F.lit("door").alias("cls"), state.alias("block"), "j")
    leaf_cells = leaf_cells.groupBy("x", "y", "z", "prio", "cls").agg(F.min_by("block", "j").alias("block"))
    sill = hinged.select("x", "y", (F.col("z") - 1).alias("z"), F.lit(50).alias("prio"), F.lit("floor").alias("cls"), F.lit(dims.FLOOR_CUBE).alias("block")).dropDuplicates(["x", "y", "z"])
    rest = carved.join(leaf_cells, ["x", "y", "z"], "left_anti")
    sill = sill.join(carved.select("x", "y", "z"), ["x", "y", "z"], "left_anti").join(leaf_cells, ["x", "y", "z"], "left_anti")
    return rest.select("x", "y", "z", "prio", "cls", "block").unionByName(leaf_cells).unionByName(sill)


def fill_enclosed(voxels: DataFrame) -> DataFrame:
    """Cells (x, y, z) that no path of empty cells joins with the outside of the bounding box.

    Empty cells between two voxels of a column are a run.  A run is open where a column beside it has no voxel, or none above
    or below it; a run that touches an open one through other runs is outside too.  Runs that touch are contracted (see
    ``flooded``), so rounds follow the logarithm of the longest path.  Columns without voxels are never made.
    """
    w = Window.partitionBy("x", "y").orderBy("z")
    cells = voxels.select(*(F.col(c).cast("int").alias(c) for c in "xyz")).distinct()
    gaps = cells.withColumn("next", F.lead("z").over(w)).where("next > z + 1").select("x", "y", (F.col("z") + 1).alias("z0"), (F.col("next") - 1).alias("z1"))
    # A hash comes first, so that ids have no order along a path.
    runs = gaps.withColumn("id", F.struct(F.hash("x", "y", "z0").alias("h"), "x", "y", "z0"))
    runs = written(runs)
    columns = cells.groupBy("x", "y").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    sides = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    asked = runs.select("id", "z0", "z1", sides.alias("p")).select("id", "z0", "z1", "p.*")
    closed = asked.join(columns, ["x", "y"]).where("low <= z0 AND z1 <= high").groupBy("id").agg(F.count("*").alias("n")).where("n = 4").select("id")
    nodes = runs.select("id").join(closed.withColumn("open", F.lit(False)), "id", "left").select("id", F.coalesce("open", F.lit(True)).alias("open"))
    beside = asked.select("x", "y", F.col("id").alias("other"), F.col("z0").alias("a0"), F.col("z1").alias("a1"))
    touch = beside.join(runs, ["x", "y"]).where("a0 <= z1 AND z0 <= a1").select("id", "other")
    inside = flooded(nodes, touch).where("NOT open").select("id")
    return runs.join(inside, "id", "left_semi").select("x", "y", F.explode(F.sequence("z0", "z1")).alias("z"))


def flooded(nodes: DataFrame, touch: DataFrame) -> DataFrame:
    """nodes (id, open) with open set for all that a path of touch (id, other; both ways) joins with an open one.

    Each round hangs every node below the smallest of its neighbours that is smaller, lets each look up its parent's parent
    until it has a root, and goes on with the roots and the links between them; open is passed up to the roots, and down again
    at the end.  Ids in random order make a round leave about a third of a path's nodes.  Levels are written.
    """
    levels = []
    nodes, touch = written(nodes), written(touch.where("id <> other").distinct())
    while not touch.isEmpty():
        up = touch.groupBy("id").agg(F.min("other").alias("least"))
        roots = written(nodes.join(up, "id", "left").select("id", "open", F.least("id", "least").alias("root")))
        while True:
            above = roots.select(F.col("id").alias("root"), F.col("root").alias("over"))
            jumped = written(roots.join(above, "root").select("id", "open", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")))
            roots = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        levels.append(roots.select("id", "root"))
        nodes = written(roots.groupBy("root").agg(F.max("open").alias("open")).withColumnRenamed("root", "id"))
        ends = touch.join(levels[-1], "id").select(F.col("root").alias("id"), "other")
        ends = ends.join(levels[-1].select(F.col("id").alias("other"), F.col("root").alias("over")), "other").select("id", F.col("over").alias("other"))
        touch = written(ends.where("id <> other").distinct())
    for level in reversed(levels):
        nodes = level.join(nodes.withColumnRenamed("id", "root"), "root").select("id", "open")
    return nodes
