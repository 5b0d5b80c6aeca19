"""Column expressions of the tile grid: projection, tile indices, Morton codes, bounds, errors, tolerances.

All are plain Catalyst expressions, so they fuse into whole-stage code and filters on them can be pushed down.
Conventions: intervals are half-open, the last tile of an axis also takes n == 1, a buffer shrinks with 2**zoom, and
a degenerate axis has a span of 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the last tile's upper bound is moved by, so that n == 1 belongs to it.
EDGE = 1e-10


def project(v: Column, low: Column | float, high: Column | float) -> Column:
    """World to [0, 1] on one axis."""
    low, high = F.lit(low), F.lit(high)
    return (v - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def unproject(n: Column, low: Column | float, high: Column | float) -> Column:
    """[0, 1] to world on one axis."""
    low, high = F.lit(low), F.lit(high)
    return n * F.when(high == low, F.lit(1.0)).otherwise(high - low) + low


def mercator_x(lon: Column) -> Column:
    return lon / 360 + 0.5


def mercator_y(lat: Column) -> Column:
    """Web Mercator latitude to [0, 1], clamped, north first."""
    s = F.sin(F.radians(lat))
    y = 0.5 - 0.25 * F.log((1 + s) / (1 - s)) / F.lit(3.141592653589793)
    return F.when(lat >= 90, F.lit(0.0)).when(lat <= -90, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def tiles_at(zoom: Column) -> Column:
    """Tiles of an axis, 2**zoom, as long."""
    return F.pow(F.lit(2.0), zoom).cast("long")


def tile_index(n: Column, zoom: Column) -> Column:
    """The tile that a point in [0, 1] falls in; null outside, as no tile below the root takes it."""
    many = tiles_at(zoom)
    at = F.floor(n * many).cast("long")
    return F.when((n >= 0) & (n < 1 + EDGE), F.least(at, many - 1))


def tile_range(low: Column, high: Column, zoom: Column, buffer: float = 0.0) -> tuple[Column, Column]:
    """First and last tile whose buffered interval [i/n - b/n, (i+1)/n + b/n) meets [low, high].

    An empty range has first > last. At zoom 0 the root takes everything, inside or not.
    """
    many = tiles_at(zoom)
    first = F.greatest(F.lit(0), F.floor(low * many - F.lit(buffer)).cast("long"))
    # (i + 1) / n + b / n must exceed low: a low on the very edge belongs to the next tile
    last = F.least(many - 1, F.floor(high * many + F.lit(buffer)).cast("long"))
    first = F.when((low >= 1) & (low < 1 + EDGE), F.least(first, many - 1)).otherwise(first)
    return F.when(zoom == 0, F.lit(0)).otherwise(first), F.when(zoom == 0, F.lit(0)).otherwise(last)


def _spread(v: Column, steps: list[tuple[int, int]]) -> Column:
    for shift, mask in steps:
        v = (v.bitwiseXOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
    return v


#: Shifts and masks that put two zero bits between bits, for 10 and for 21 bits an axis.
SPREAD10 = [(16, 0xFF0000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)]
SPREAD21 = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def morton3(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Interleaves x, y and z, x lowest. ``bits`` an axis: up to 10, or up to 21."""
    steps, most = (SPREAD10, 0x3FF) if bits <= 10 else (SPREAD21, 0x1FFFFF)
    a, b, c = (_spread(v.cast("long").bitwiseAND(F.lit(most)), steps) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def unmorton3(code: Column) -> tuple[Column, Column, Column]:
    """x, y and z of a 10-bit Morton code."""

    def part(shift: int) -> Column:
        v = F.shiftright(code, shift) if shift else code
        bits = [F.shiftright(v, 3 * i).bitwiseAND(F.lit(1)) * (1 << i) for i in range(10)]
        out = bits[0]
        for b in bits[1:]:
            out = out + b
        return out.cast("long")

    return part(0), part(1), part(2)


def tile_id3(zoom: Column, x: Column, y: Column, d: Column) -> Column:
    """(zoom << 30) | Morton code: unique over zooms."""
    return F.shiftleft(zoom.cast("long"), 30).bitwiseOR(morton3(x, y, d))


def tile_id2(zoom: Column, x: Column, y: Column) -> Column:
    """((2**zoom * y + x) * 32) + zoom."""
    return (tiles_at(zoom) * y + x) * 32 + zoom


def tile_bounds(zoom: Column, index: Column, low: Column | float, high: Column | float) -> tuple[Column, Column]:
    """World bounds of a tile on one axis."""
    many = tiles_at(zoom)
    return unproject(index / many, low, high), unproject((index + 1) / many, low, high)


def box_volume(bounds: list[tuple[Column, Column]]) -> Column:
    """The 12 floats of a 3D Tiles box: centre, then the half axes."""
    half = [(b - a) / 2 for a, b in bounds]
    zero = F.lit(0.0)
    return F.array(*[(a + b) / 2 for a, b in bounds], half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])


def geometric_error(zoom: Column, top: int, diagonal: float) -> Column:
    """diagonal / 2**zoom; 0 at the finest zoom."""
    return F.when(zoom >= top, F.lit(0.0)).otherwise(F.lit(diagonal) / F.pow(F.lit(2.0), zoom))


def zoom_tolerance(zoom: Column, top: int) -> Column:
    """2**-zoom below the finest zoom, 0 there."""
    return F.when(zoom >= top, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -zoom))


def _share(z: Column, o: dict) -> Column:
    """The tolerance in units of a tile's extent at a zoom."""
    return F.lit(float(o["tolerance"])) / (F.pow(F.lit(2.0), z) * float(o["extent"]))


#: Tolerance schedules: (zoom, options) to a Column.
SCHEDULES: dict[str, Callable[[Column, dict], Column]] = {
    "default": lambda z, o: F.pow(_share(z, o), F.lit(2.0)),
    "linear": _share,
    "constant": lambda z, o: F.lit((o["tolerance"] / o["extent"]) ** 2) + z * F.lit(0.0),
    "slow_exponential": lambda z, o: F.pow(_share(z, o), F.lit(1.5)),
    "logarithmic": lambda z, o: F.lit(o["tolerance"] / o["extent"]) / F.log(z + 2.0),
    "step": lambda z, o: F.pow(_share(z, o) * F.when(z < o["index_max_zoom"] - 1, 4.0).when(z < o["max_zoom"] - 1, 1.5).otherwise(0.5), F.lit(2.0)),
}
OPTIONS = {"tolerance": 50, "extent": 4096, "index_max_zoom": 5, "max_zoom": 8}


def tolerance(schedule: str | Callable, zoom: Column, **options) -> Column:
    """A simplification tolerance by a named schedule or any function of (zoom, options) to a Column."""
    return (SCHEDULES[schedule] if isinstance(schedule, str) else schedule)(zoom, OPTIONS | options)


def triangle_budget(current: Column, zoom: Column, top: int, base: int) -> Column:
    """Index budget of a mesh at a zoom: min(6 (base 2**z)**2 * 3, current / 3 per level from the finest), 3 at least.

    The division rounds down at each level, which equals one division by the power.
    """
    grid = F.lit(18) * F.pow(F.lit(float(base)) * F.pow(F.lit(2.0), zoom), F.lit(2.0)).cast("long")
    levels = F.floor(current / F.pow(F.lit(3.0), F.greatest(F.lit(top) - zoom, F.lit(0)))).cast("long")
    return F.when(zoom >= top, current).otherwise(F.greatest(F.lit(3), F.least(grid, levels, current)))


def face_ratio(zoom: Column, top: int) -> Column:
    """Share of faces kept at a zoom, 4**(zoom - top)."""
    return F.pow(F.lit(4.0), F.least(zoom - top, F.lit(0)))


def tile_integer(n: Column, zoom: Column, tile: Column, extent: int = 4096, half_even: bool = False) -> Column:
    """Position inside a tile in whole units: half away from zero, or half to even as in 3D tiles."""
    v = F.lit(float(extent)) * (n * tiles_at(zoom) - tile)
    return (F.rint(v) if half_even else F.when(v < 0, -F.floor(-v + 0.5)).otherwise(F.floor(v + 0.5))).cast("long")


def tile_position(value: Column, zoom: Column, tile: Column, low: Column | float, high: Column | float, extent: int = 4096) -> Column:
    """World position of a tile integer."""
    return unproject((tile + value / F.lit(float(extent))) / tiles_at(zoom), low, high)


def quantise(v: Column, low: Column, high: Column, most: int) -> Column:
    """floor((v - low) * most / range + 0.5) in [0, most]; 0 on a degenerate axis."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor((v - low) * F.lit(float(most)) / span + 0.5))).cast("long")


def ring_distance(x: Column, y: Column, cx: Column, cy: Column, d: Column | None = None, cd: Column | None = None) -> Column:
    """Chebyshev distance between tiles."""
    parts = [F.abs(x - cx), F.abs(y - cy)]
    return F.greatest(*parts, F.abs(d - cd)) if d is not None else F.greatest(*parts)


def inside(v: Column, low: Column | float, high: Column | float, closed: bool = False) -> Column:
    """Whether low <= v < high; with ``closed``, high itself is inside, too."""
    return (v >= low) & ((v <= high) if closed else (v < high))


def interval_fate(low: Column, high: Column, k1: Column | float, k2: Column | float) -> Column:
    """What clipping to [k1, k2) does to an interval: ``outside`` and ``inside`` need no work, ``across`` does."""
    return F.when((low >= k2) | (high < k1), "outside").when((low >= k1) & (high < k2), "inside").otherwise("across")


def box_fate(*fates: Column) -> Column:
    """The fate of a box from those of its axes: one axis outside is enough, inside needs all of them."""
    every = F.array(*fates)
    return F.when(F.array_contains(every, "outside"), "outside").when(F.array_contains(every, "across"), "across").otherwise("inside")


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def command(name: Column | int, count: Column) -> Column:
    """A vector-tile command integer: (name & 7) | (count << 3)."""
    return F.lit(name).bitwiseAND(F.lit(7)).bitwiseOR(F.shiftleft(count.cast("int"), 3))
