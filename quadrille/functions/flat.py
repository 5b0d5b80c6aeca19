"""Column functions of flat coordinate arrays [x0, y0, x1, y1, ...], rings and polylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis(flat: Column, k: int, dims: int = 2) -> Column:
    """The k-th coordinate of every vertex."""
    return F.filter(flat, lambda v, i: i % dims == k)


def bbox(flat: Column, dims: int = 2) -> list[tuple[Column, Column]]:
    """(min, max) of each axis."""
    return [(F.array_min(axis(flat, k, dims)), F.array_max(axis(flat, k, dims))) for k in range(dims)]


def pairs(flat: Column, dims: int = 2) -> Column:
    """[[x0, y0], [x1, y1], ...]."""
    n = F.floor(F.size(flat) / dims).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * dims + 1, dims))).otherwise(F.array().cast("array<array<double>>"))


def split_rings(vertices: Column, lengths: Column) -> Column:
    """Vertices cut into rings of the given lengths."""
    return F.transform(lengths, lambda n, i: F.slice(vertices, F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, b: a + b) + 1, n))


def closed(ring: Column) -> Column:
    """The ring with its first vertex at the end, unless it is there already."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def doubled_area(ring: Column, x: str = "x", y: str = "y") -> Column:
    """Twice the signed area of a closed ring of structs (shoelace)."""
    pair = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a[x] * b[y] - b[x] * a[y])
    return F.aggregate(pair, F.lit(0.0), lambda s, v: s + v)


def wound(ring: Column, clockwise: bool = False, x: str = "x", y: str = "y") -> Column:
    """The ring reversed if it runs the other way round."""
    area = doubled_area(ring, x, y)
    return F.when(area > 0 if clockwise else area < 0, F.reverse(ring)).otherwise(ring)


def length(line: Column, x: str = "x", y: str = "y") -> Column:
    step = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.hypot(b[x] - a[x], b[y] - a[y]))
    return F.when(F.size(line) > 1, F.aggregate(step, F.lit(0.0), lambda s, v: s + v)).otherwise(F.lit(0.0))


def is_tin(rings: Column) -> Column:
    """Whether every polygon is one closed triangle."""
    return F.forall(rings, lambda r: F.size(r) == 4)


def thinned(path: Column, most: int) -> Column:
    """At most ``most`` vertices at even steps, both ends kept."""
    n = F.size(path)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(path, (F.floor(i * (n - 1) / F.lit(most - 1) + 0.5) + 1).cast("int")))
    return F.when(n > most, at).otherwise(path)


def delta_encoded(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(v - F.element_at(values, i)))


def delta_decoded(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.aggregate(F.slice(values, 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b.cast("long")))


def affine_rows(matrix: list[float]) -> list[float]:
    """The top three rows of a 4 x 4 affine matrix, given row by row."""
    return [float(v) for v in matrix[:12]]
