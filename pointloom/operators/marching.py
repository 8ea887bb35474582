"""Isosurfaces by marching tetrahedra: cells from corners, triangles from a broadcast table, vertices welded by key.

Corner n of a cell lies at (n & 1, n >> 1 & 1, n >> 2 & 1); bit n of a cell's code says that the field is not negative there, which counts as outside. A vertex is
known by the sum of the two ends of its edge (twice its rounded position), packed into 63 bits; so vertices weld by equality, wherever they were made.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import bits

#: The six tetrahedra of a cell, all around the diagonal from corner 0 to corner 7. Fixed values.
TETRAHEDRA = ((0, 7, 1, 3), (0, 7, 3, 2), (0, 7, 2, 6), (0, 7, 6, 4), (0, 7, 4, 5), (0, 7, 5, 1))
MAX_VERTICES = (1 << 20) - 1


def edges() -> list[tuple[int, int]]:
    """All edges of the tetrahedra, by their higher, then lower corner."""
    return sorted({tuple(sorted(e)) for t in TETRAHEDRA for e in combinations(t, 2)}, key=lambda e: (e[1], e[0]))


def _middle(edge: tuple[int, int]) -> np.ndarray:
    """The middle of an edge of the cell, doubled."""
    return sum(np.array([c & 1, c >> 1 & 1, c >> 2 & 1]) for c in edge)


def _facing(triangle: list[tuple[int, int]], towards: np.ndarray) -> list[tuple[int, int]]:
    """The triangle of edge middles, turned so that its normal points the given way."""
    p, q, r = map(_middle, triangle)
    return triangle if np.linalg.det([q - p, r - p, towards]) > 0 else triangle[::-1]


def tetrahedron_triangles(corners: tuple[int, ...], outside: tuple[bool, ...]) -> list[list[tuple[int, int]]]:
    """Triangles of cube edges that divide the outside corners of one tetrahedron from the others, facing outwards.

    The surface crosses every edge between an outside and an inside corner: three around a corner that is alone, or
    four, where two corners face two; these are a ring, halved along one of its diagonals."""
    out, within = [c for c, o in zip(corners, outside, strict=True) if o], [c for c, o in zip(corners, outside, strict=True) if not o]
    if not out or not within:
        return []
    ring = [tuple(sorted((i, o))) for k, i in enumerate(within) for o in (out if k % 2 == 0 else out[::-1])]
    towards = len(within) * sum(_middle((o,)) for o in out) - len(out) * sum(_middle((i,)) for i in within)
    return [_facing([ring[0], ring[k], ring[k + 1]], towards) for k in range(1, len(ring) - 1)]


@lru_cache
def code_triangles(code: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles, as numbers of edges, of a cell with this code."""
    number = {e: i for i, e in enumerate(edges())}
    out = []
    for t in TETRAHEDRA:
        out += [tuple(number[e] for e in triangle) for triangle in tetrahedron_triangles(t, tuple(bool(code >> c & 1) for c in t))]
    return tuple(out)


def code_counts(code: int) -> tuple[int, int]:
    """(distinct vertices, indices) of a cell with this code."""
    triangles = code_triangles(code)
    return len({e for t in triangles for e in t}), 3 * len(triangles)


def triangle_table(spark: SparkSession) -> DataFrame:
    """``code``, ``n`` and, for the three edges of each triangle, their corners: at most 256 x 12 rows."""
    ends = edges()
    rows = [(code, n, *[c for e in t for c in ends[e]]) for code in range(256) for n, t in enumerate(code_triangles(code))]
    return spark.createDataFrame(rows, "code int, n int, a0 int, b0 int, a1 int, b1 int, a2 int, b2 int")


def cells(field: DataFrame) -> DataFrame:
    """Cells whose eight corners are defined and that the surface crosses: ``x``, ``y``, ``z``, ``code``, ``f`` (array of eight). Each corner is handed to its
    eight cells, so there is one aggregation and no self-join."""
    n = F.col("n")
    at = {a: (F.col(a) - F.shiftright(n, i).bitwiseAND(F.lit(1))).cast("int") for i, a in enumerate("xyz")}
    each = field.where(F.col("f").isNotNull() & ~F.isnan("f")).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = each.select(*[v.alias(f"c{a}") for a, v in at.items()], "n", F.col("f").cast("double").alias("f"))
    # a corner's value lands in its own place: no list is built or sorted
    grouped = rows.groupBy(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).agg(*[F.max(F.when(F.col("n") == i, F.col("f"))).alias(f"f{i}") for i in range(8)], F.count("*").alias("corners"))
    code = sum((F.when(F.col(f"f{i}") >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(8)), F.lit(0))
    found = grouped.where(F.col("corners") == 8).withColumn("code", code).where((F.col("code") != 0) & (F.col("code") != 255))
    return found.select("x", "y", "z", "code", F.array(*[F.col(f"f{i}") for i in range(8)]).alias("f"))


def _corner(axis: int, n: Column) -> Column:
    return F.shiftright(n, axis).bitwiseAND(F.lit(1))


def edge_key(x: Column, y: Column, z: Column, a: Column, b: Column, origin: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """Key of the vertex on the edge between corners a and b of a cell; ``origin`` makes all coordinates positive."""
    return bits.pack_key(*[2 * (c - o) + _corner(i, a) + _corner(i, b) for i, (c, o) in enumerate(zip((x, y, z), origin, strict=True))])


def interpolate(x: Column, axis: int, a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Where the field passes zero on an edge, on one axis."""
    t = fa / (fa - fb)
    return x + _corner(axis, a) + t * (_corner(axis, b) - _corner(axis, a))


def triangles(crossed: DataFrame, origin: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """A row for each triangle: its cell (``x``, ``y``, ``z``), number ``n``, keys ``k0`` .. ``k2`` and positions ``p0`` .. ``p2``."""
    table = F.broadcast(triangle_table(crossed.sparkSession))  # at most 3072 rows
    rows = crossed.join(table, "code")
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    out = []
    for v in range(3):
        a, b = F.col(f"a{v}"), F.col(f"b{v}")
        fa, fb = F.col("f")[a], F.col("f")[b]
        out.append(edge_key(*xyz, a, b, origin).alias(f"k{v}"))
        out.append(F.struct(*[interpolate(c, i, a, b, fa, fb).alias(n) for i, (c, n) in enumerate(zip(xyz, "xyz", strict=True))]).alias(f"p{v}"))
    return rows.select("x", "y", "z", "n", *out)


def weld(found: DataFrame) -> DataFrame:
    """``key``, ``x``, ``y``, ``z`` of the distinct vertices; copies agree but for rounding, and the smallest is taken."""
    each = found.select(F.explode(F.array(*[F.struct(F.col(f"k{v}").alias("key"), F.col(f"p{v}").alias("p")) for v in range(3)])).alias("v"))
    return each.groupBy(F.col("v.key").alias("key")).agg(F.min("v.p").alias("p")).select("key", "p.x", "p.y", "p.z")


def slice_counts(crossed: DataFrame) -> DataFrame:
    """Vertices and indices made in each slice of cells, before welding."""
    counts = F.lit([code_counts(c)[0] for c in range(256)]), F.lit([code_counts(c)[1] for c in range(256)])
    return crossed.groupBy("z").agg(*[F.sum(F.element_at(t, F.col("code") + 1)).cast("long").alias(n) for t, n in zip(counts, ("vertices", "indices"), strict=True)])


def isosurface(field: DataFrame, origin: tuple[int, int, int] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of a field: ``key``, ``x``, ``y``, ``z``; and ``k0``, ``k1``, ``k2`` with the cell they lie in."""
    found = triangles(cells(field), origin)
    return weld(found), found.select("x", "y", "z", "n", "k0", "k1", "k2")


def split_external(vertices: DataFrame, top: tuple[int, int, int]) -> DataFrame:
    """``external`` for each vertex of a block of cells [0, top]: those that another block may share."""
    x, y, z = bits.unpack_key(F.col("key"))
    return vertices.withColumn("external", bits.external(x, y, z, tuple(2 * t for t in top)))


def analytic_field(spark: SparkSession, size: tuple[int, int, int], value: Column) -> DataFrame:
    """A lattice [0, size) with a field given as an expression of ``x``, ``y``, ``z``."""
    nx, ny, nz = size
    at = spark.range(nx * ny * nz).select((F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"))
    return at.select("x", "y", "z", value.cast("double").alias("f"))
