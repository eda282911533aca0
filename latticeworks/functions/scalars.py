"""Column helpers: block states, snapping, cells and chunks, colours, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL, CELL_BITS = 16, 4


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c) -> Column:
    """Round half towards plus infinity."""
    return F.floor(col(c) + 0.5)


def strip_state(block) -> Column:
    return F.substring_index(col(block), "[", 1)


def state_props(block) -> Column:
    """Properties of ``name[k=v,...]`` as a map; entries without '=' are ignored, blanks trimmed."""
    inside = F.regexp_extract(col(block), r"\[(.*)\]", 1)
    entries = F.filter(F.split(inside, ","), lambda e: F.instr(e, "=") > 0)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(F.trim(F.substring_index(e, "=", 1)), F.trim(F.regexp_replace(e, "^[^=]*=", "")))))


def parse_block_state(block) -> Column:
    return F.struct(F.trim(strip_state(block)).alias("base"), state_props(block).alias("props"))


def format_block_state(base, **props) -> Column:
    """A state text with the given properties in the given order."""
    return F.concat(col(base), F.lit("["), F.concat_ws(",", *(F.concat(F.lit(f"{k}="), col(v)) for k, v in props.items())), F.lit("]"))


def door_axis(block) -> Column:
    facing = F.coalesce(F.get(F.transform(F.array(state_props(block)), lambda m: F.try_element_at(m, F.lit("facing"))), 0), F.lit("south"))
    return F.when(facing.isin("east", "west"), "door_x").otherwise("door_z")


def snap(v, origin, pitch, dim) -> Column:
    """Nearest lattice index (half to even), kept within [0, dim - 1]."""
    return F.greatest(F.lit(0), F.least(F.rint((col(v) - origin) / pitch), col(dim) - 1)).cast("int")


def pack_key(x, y, z, nx, ny) -> Column:
    return col(x) + col(y) * nx + col(z) * nx * ny


def unpack_key(key, nx, ny) -> Column:
    k = col(key)
    return F.struct((k % nx).alias("x"), (F.floor(k / nx) % ny).alias("y"), F.floor(k / (nx * ny)).alias("z"))


def cell_of(v) -> Column:
    return F.shiftright(col(v).cast("int"), CELL_BITS)


def cell_id(x, y, z) -> Column:
    return F.concat_ws(",", cell_of(x), cell_of(y), cell_of(z))


def voxel_offset(x, y, z) -> Column:
    inside = lambda v: col(v).cast("int").bitwiseAND(CELL - 1)
    return inside(y) * CELL * CELL + inside(z) * CELL + inside(x)


def cell_origin(cell) -> Column:
    part = F.split(col(cell), ",")
    return F.struct(*((F.get(part, k).cast("int") * CELL).alias(n) for k, n in enumerate("xyz")))


def chunk_of(v) -> Column:
    return F.shiftright(col(v).cast("int"), 4)


def region_of(v) -> Column:
    return F.shiftright(col(v).cast("int"), 9)


def unit_factor(prefix) -> Column:
    """Metres of a prefixed metre."""
    factors = {"MILLI": 1e-3, "CENTI": 1e-2, "DECI": 1e-1, "KILO": 1e3, "MICRO": 1e-6}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in factors.items() for x in kv)), F.upper(col(prefix))), F.lit(1.0))


def srgb_to_lab(r, g, b) -> Column:
    """CIE L*a*b* (D65) of 8-bit sRGB as struct<l, a, b>."""
    # The sRGB transfer curve, its matrix to XYZ and the D65 white point.
    def linear(c):
        c = col(c) / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92)

    lin = [linear(c) for c in (r, g, b)]
    rows = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
    white = (0.95047, 1.0, 1.08883)

    def f(t):
        return F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)

    x, y, z = (f(sum(m * c for m, c in zip(row, lin)) / w) for row, w in zip(rows, white))
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def shade(depth, least, most, base=0.55) -> Column:
    return F.lit(base) + (1 - base) * (col(depth) - least) / F.greatest(F.lit(1), most - least)


def door_facing(ex, ey) -> Column:
    return F.when(col(ex) <= col(ey), "east").otherwise("south")


def leaf_count(width, pitch, wide) -> Column:
    return F.coalesce(F.least(F.greatest(F.lit(1), F.rint(col(width) / pitch).cast("int")), col(wide).cast("int")), F.lit(1))


def door_height(pitch: float) -> int:
    return max(2, round(2 / pitch))


def distance(*pairs) -> Column:
    return F.sqrt(sum((col(a) - col(b)) * (col(a) - col(b)) for a, b in pairs))


def collapse_spaces(text) -> Column:
    return F.regexp_replace(col(text), r"[ \t\n\r\f\x0B]{2,}", " ")


def mask_words(text, words: list[str], mask: str = "****") -> Column:
    """Listed words (a bounded list) replaced, in any case, where no letter, mark, number or underscore of any script is beside them."""
    import re

    return F.regexp_replace(col(text), r"(?iu)(?<![\p{L}\p{M}\p{N}_])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{M}\p{N}_])", mask)


def safe_name(name, words: list[str], seed) -> Column:
    """A name, or Player and four digits of the seed's hash where it is empty or listed."""
    other = F.concat(F.lit("Player"), F.lpad(F.pmod(F.crc32(col(seed).cast("string").cast("binary")), F.lit(10000)).cast("string"), 4, "0"))
    bad = (F.trim(F.coalesce(col(name), F.lit(""))) == "") | F.lower(col(name)).isin([w.lower() for w in words])
    return F.when(bad, other).otherwise(col(name))
