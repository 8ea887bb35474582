import math

import pytest
from pyspark.sql import functions as F

from pointloom.functions import bits, mls, text
from pointloom.functions.grid import Grid, div_down, div_up, mul_div, mul_sat, round_up


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_integers(spark):
    assert (div_up(7, 3), round_up(7, 3), mul_div(2**40, 2**40, 2**41), mul_sat(2**40, 2**40)) == (3, 9, 2**39, 2**64 - 1)
    rows = spark.createDataFrame([(-7,), (-4,), (0,), (3,), (4,)], "v long").select(div_down(F.col("v"), 4).alias("q")).collect()
    assert [r.q for r in rows] == [-2, -1, 0, 0, 1]


def test_grid(spark):
    g = Grid((-10.0, 0.0, 10.0), 2.5, ((4, 20), (0, 20), (-4, 4)))
    assert (g.num_cells(0), g.num_vertices(2)) == (16, 9)
    got = one(spark, v=g.world_to_vertex(F.lit(5.0), 0), c=g.world_to_cell(F.lit(5.1), 0), w=g.vertex_to_world(F.lit(2), 0))
    assert got == {"v": 2.0, "c": 2, "w": 5.0}
    assert g.sub_grid(((1, 2), (0, 3), (2, 4))).extents == ((5, 6), (0, 3), (-2, 0))
    with pytest.raises(Exception, match="not finite"):
        one(spark, c=g.world_to_cell(F.lit(float("nan")), 0))
    with pytest.raises(Exception, match="not finite"):
        one(spark, c=g.world_to_cell(F.lit(1e300), 0))


@pytest.mark.parametrize(("xyz", "code"), [((0, 0, 0), 0), ((1, 1, 1), 7), ((2, 5, 3), 174), ((7, 7, 7), 511)])
def test_morton(spark, xyz, code):
    got = one(spark, m=bits.morton(*map(F.lit, xyz)), x=bits.unmorton(F.lit(code).cast("long"))[0], y=bits.unmorton(F.lit(code).cast("long"))[1], z=bits.unmorton(F.lit(code).cast("long"))[2])
    assert (got["m"], (got["x"], got["y"], got["z"])) == (code, xyz)


def test_bit_fields(spark):
    top = (1 << 21) - 1
    got = one(spark, big=bits.gather(bits.spread(F.lit(top))), key=bits.pack_key(F.lit(3), F.lit(4), F.lit(5)), s=bits.signed_field(F.lit(0b1110 << 5).cast("long"), 5, 4), u=bits.unsigned_field(F.lit(0b1110 << 5).cast("long"), 5, 4), lz=bits.leading_zeros(F.lit(1).cast("long")))
    assert got == {"big": top, "key": (5 << 42) + (4 << 21) + 3, "s": -2, "u": 14, "lz": 31}
    import struct

    for v in (0.0, 1.0, -2.5, 3.14159, 1e-40, 3e38, 2.0**-126):
        want = struct.unpack("<I", struct.pack("<f", v))[0]
        assert one(spark, b=bits.float_bits(F.lit(v)))["b"] == want


def test_external(spark):
    f = lambda k, top: one(spark, e=bits.external(*map(F.lit, k), top))["e"]
    assert f((5, 40, 3), (30, 40, 50)) and f((9, 5, 0), (32, 40, 50)) is False and f((1, 2, 50), (30, 40, 50)) and not f((1, 2, 40), (30, 41, 50))


@pytest.mark.parametrize(("abc", "root"), [((-1, 5, -6), 2), ((1, 1, -6), 2), ((0, 2, 3), -1.5), ((-1, 2, -2), None)])
def test_quadratic(spark, abc, root):
    assert one(spark, r=mls.solve_quadratic(*[F.lit(float(v)) for v in abc]))["r"] == root


def test_sphere_distance(spark):
    centre, r = (3.0, 4.0, 12.0), 6.0
    a, b, c = F.lit(1.0), tuple(F.lit(-2 * v) for v in centre), F.lit(sum(v * v for v in centre) - r * r)
    assert one(spark, d=mls.distance_sphere(a, b, c)[1])["d"] == pytest.approx(7)
    scaled = tuple(F.lit(5.0 * v) for v in centre)
    assert one(spark, d=mls.distance_sphere(F.lit(-2.5), scaled, F.lit(-2.5 * (169 - 36))) [1])["d"] == pytest.approx(-7)
    assert mls.HALF_DISC == pytest.approx(0.5760530479533076) and mls.boundary_factor(0) == 1


def test_box_distance_and_capacity(spark):
    zero, one_ = tuple(map(F.lit, (0.0, 0.0, 0.0))), tuple(map(F.lit, (1.0, 1.0, 1.0)))
    assert one(spark, d=mls.point_box_dist2(tuple(map(F.lit, (2.0, 0.5, -2.0))), zero, one_))["d"] == 5
    assert text.parse_capacity("64M") == 64 << 20 and text.format_capacity(3 << 30) == "3G" and text.format_capacity(1025) == "1025B"
    for bad in ("", "M", "-1", "1.5G", "1T", str(1 << 64)):
        with pytest.raises(ValueError):
            text.parse_capacity(bad)
    names = [r.n for r in spark.createDataFrame([("w.10",), ("w.2",), ("main",), ("w",)], "n string").orderBy(*text.natural_order(F.col("n"))).collect()]
    assert names == ["main", "w", "w.2", "w.10"]
    assert math.isclose(mls.boundary_factor(1.0), 1 - 0.5760530479533076**2)
