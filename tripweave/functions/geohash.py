"""Geohash cells as integer lattice arithmetic on columns.

A cell at a given level is a pair (i, j): i counts cells northwards from the south pole, j eastwards
from the antimeridian. Everything is a built-in column expression, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions.once import compute_once

# The geohash alphabet and the pattern of a well-formed level-8 cell.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
CELL8_PATTERN = "^[0-9b-hjkmnp-z]{8}$"

# Metres per degree and the reference latitude of the local projection.
METRES_PER_DEGREE_LAT = 110540.0
METRES_PER_DEGREE_LON_EQUATOR = 111320.0
STUDY_LATITUDE = 39.973
EARTH_RADIUS_KM = 6371.0088


def axis_bits(level: int) -> tuple[int, int]:
    """(latitude bits, longitude bits) of a cell; longitude gets the odd bit."""
    return (5 * level) // 2, (5 * level + 1) // 2


def cell_size(level: int) -> tuple[float, float]:
    """(height, width) of a cell in degrees."""
    lat_bits, lon_bits = axis_bits(level)
    return 180.0 / 2**lat_bits, 360.0 / 2**lon_bits


# The digits that base conversion reads and writes, in the same order as the alphabet.
_READ_DIGITS = "0123456789abcdefghijklmnopqrstuv"
_WRITE_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _latitude_is_low(level: int) -> bool:
    """Bits alternate from longitude; the lowest one is a latitude bit when their number is even."""
    return level % 2 == 0


def _every_other_bit(index: Column) -> Column:
    """Spread the bits of an index to every second position: its binary digits read in base four."""
    return F.conv(F.bin(index), 4, 10).cast("long")


def _gather_bits(spread: Column) -> Column:
    """Undo the spreading. Multiplying by 2^s + 1 pairs neighbouring groups of bits without a second
    reference to the operand, so the expression stays linear in size."""
    packed = spread.bitwiseAND(F.lit(0x5555555555555555))
    for step, mask in (
        (1, 0x3333333333333333),
        (2, 0x0F0F0F0F0F0F0F0F),
        (4, 0x00FF00FF00FF00FF),
        (8, 0x0000FFFF0000FFFF),
        (16, 0x00000000FFFFFFFF),
    ):
        packed = F.shiftright(packed * F.lit(2**step + 1).cast("long"), step).bitwiseAND(F.lit(mask))
    return packed


def encode(i: Column, j: Column, level: int = 8) -> Column:
    """Lattice index to geohash text."""
    low, high = (i, j) if _latitude_is_low(level) else (j, i)
    bits = _every_other_bit(high) * 2 + _every_other_bit(low)
    digits = F.lpad(F.conv(bits.cast("string"), 10, 32), level, "0")
    return F.translate(digits, _WRITE_DIGITS, ALPHABET)


def interleaved(cell: Column) -> Column:
    """The bits of a geohash as one integer."""
    return F.conv(F.translate(cell, ALPHABET, _READ_DIGITS), 32, 10).cast("long")


def is_cell8(cell: Column) -> Column:
    """True for a well-formed level-8 geohash; NULL and malformed text give false."""
    return F.coalesce(cell.rlike(CELL8_PATTERN), F.lit(False))


def lat_index(cell: Column, level: int = 8) -> Column:
    """Row index i of a well-formed geohash."""
    return lat_of_bits(interleaved(cell), level)


def lon_index(cell: Column, level: int = 8) -> Column:
    """Column index j of a well-formed geohash."""
    return lon_of_bits(interleaved(cell), level)


def lat_of_bits(bits: Column, level: int = 8) -> Column:
    return _gather_bits(F.shiftright(bits, 0 if _latitude_is_low(level) else 1))


def lon_of_bits(bits: Column, level: int = 8) -> Column:
    return _gather_bits(F.shiftright(bits, 1 if _latitude_is_low(level) else 0))


def with_index(df: DataFrame, cells: dict[str, str], level: int = 8) -> DataFrame:
    """Add lattice columns <name>_i and <name>_j for each cell column, decoding each text once.

    Malformed text (checked at level 8) gives NULL.
    """
    whole = {
        f"_{name}_bits": F.when(is_cell8(F.col(cell)), interleaved(F.col(cell))) if level == 8 else interleaved(F.col(cell))
        for name, cell in cells.items()
    }
    axes = {}
    for name in cells:
        axes[f"{name}_i"] = lat_of_bits(F.col(f"_{name}_bits"), level)
        axes[f"{name}_j"] = lon_of_bits(F.col(f"_{name}_bits"), level)
    return compute_once(compute_once(df, whole), axes).drop(*whole)


def centre_lat(i: Column, level: int = 8) -> Column:
    return (i + F.lit(0.5)) * F.lit(cell_size(level)[0]) - F.lit(90.0)


def centre_lon(j: Column, level: int = 8) -> Column:
    return (j + F.lit(0.5)) * F.lit(cell_size(level)[1]) - F.lit(180.0)


def south(i: Column, level: int = 8) -> Column:
    return i * F.lit(cell_size(level)[0]) - F.lit(90.0)


def west(j: Column, level: int = 8) -> Column:
    return j * F.lit(cell_size(level)[1]) - F.lit(180.0)


def index_from_centre(lat: Column, lon: Column, level: int = 8) -> tuple[Column, Column]:
    """Lattice index of the cell holding a coordinate."""
    height, width = cell_size(level)
    return (
        F.floor((lat + 90.0) / F.lit(height)).cast("long"),
        F.floor((lon + 180.0) / F.lit(width)).cast("long"),
    )


def truncate(cell: Column, level: int) -> Column:
    """Coarser cell that contains this one."""
    return F.substring(cell, 1, level)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the haversine term is clipped to [0, 1]."""
    rise = F.radians(lat2) - F.radians(lat1)
    run = F.radians(lon2 - lon1)
    term = F.pow(F.sin(rise / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(run / 2.0), 2
    )
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(term, F.lit(0.0)), F.lit(1.0))))


def snap(i: Column, j: Column, rows: int, columns: int) -> tuple[Column, Column]:
    """South-west cell of the aligned rows x columns block a cell belongs to."""
    return i - F.pmod(i, F.lit(rows)), j - F.pmod(j, F.lit(columns))


def unit_id(cell: Column, level: int = 8, rows: int = 1, columns: int = 1) -> Column:
    """Unit of an aligned grid: the cell itself, or the geohash of its block's south-west cell."""
    if (rows, columns) == (1, 1):
        return truncate(cell, level)
    i, j = snap(lat_index(cell, level), lon_index(cell, level), rows, columns)
    return encode(i, j, level)


def member_offsets(rows: int, columns: int, aligned: bool) -> list[tuple[int, int]]:
    """Offsets from a unit's own cell to its members: north-east of it, or centred on it."""
    di = 0 if aligned else (rows - 1) // 2
    dj = 0 if aligned else (columns - 1) // 2
    return [(a - di, b - dj) for a in range(rows) for b in range(columns)]


def member_cells(unit: Column, level: int, rows: int, columns: int, aligned: bool = True) -> Column:
    """Array of the geohashes a unit covers; indices wrap at the edge of the lattice."""
    lat_bits, lon_bits = axis_bits(level)
    i, j = lat_index(unit, level), lon_index(unit, level)
    return F.array(
        *[
            encode(F.pmod(i + a, F.lit(2**lat_bits)), F.pmod(j + b, F.lit(2**lon_bits)), level)
            for a, b in member_offsets(rows, columns, aligned)
        ]
    )


def south_west_alias(cell: Column, level: int = 8) -> Column:
    """Label of a cell in the historical scheme that names it after its south-west neighbour."""
    return encode(lat_index(cell, level) - 1, lon_index(cell, level) - 1, level)


def cell_from_alias(alias: Column, level: int = 8) -> Column:
    """The true cell behind a south-west alias (one row north, one column east)."""
    return encode(lat_index(alias, level) + 1, lon_index(alias, level) + 1, level)
