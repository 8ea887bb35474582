"""Moving-least-squares fits as column expressions over weighted sums; undefined results are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLT_EPSILON = 2.0**-23
HITS, NEAR = 4, 0.99
MAX_DISTANCE2 = 3.0
#: Distance of a half-disc's weighted centre from its straight edge, in radii: 512 sqrt(6) / (693 pi).
HALF_DISC = 512 * math.sqrt(6) / (693 * math.pi)

Vec = tuple[Column, Column, Column]


def boundary_factor(limit: float) -> float:
    """The share of the spread of the splats that must be left for a corner to be inside the boundary."""
    return 1 - (HALF_DISC * limit) ** 2


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def scaled(a: Vec, k: Column) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    size = length(a)
    return F.try_divide(a[0], size), F.try_divide(a[1], size), F.try_divide(a[2], size)


def point_box_dist2(p: Vec, lo: Vec, hi: Vec) -> Column:
    """Squared distance of a point from a box."""
    out = F.lit(0.0)
    for v, a, b in zip(p, lo, hi, strict=True):
        gap = F.greatest(a - v, v - b, F.lit(0.0))
        out = out + gap * gap
    return out


def finite(v: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def solve_quadratic(a: Column, b: Column, c: Column) -> Column:
    """The root of a x^2 + b x + c that a vanishing ``a`` leaves finite (the larger one for positive a), for b >= 0 the stable form."""
    t = b + F.when(b * b - 4 * a * c >= 0, F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0))))
    return F.coalesce(finite(F.try_divide(-2 * c, t)), finite(F.try_divide(t, -2 * a)))


def distance_sphere(a: Column, b: Vec, c: Column) -> tuple[Vec, Column]:
    """The foot of the origin on the sphere a x.x + b.x + c = 0 and its signed distance."""
    b2 = dot(b, b)
    foot = scaled(b, solve_quadratic(a * b2, b2, c))
    return foot, -F.try_divide(dot(b, foot), F.sqrt(b2))


def fit_sphere(sw: Column, swp: Vec, swn: Vec, swpp: Column, swpn: Column, hits: Column) -> tuple[Column, Vec, Column]:
    """Coefficients (a, b, c) of the algebraic sphere of the weighted sums."""
    mean = tuple(F.try_divide(v, sw) for v in swp)
    top, bottom = swpn - dot(mean, swn), swpp - dot(mean, swp)
    q = sphere_quotient(top, bottom, swpp, hits)
    b = tuple(F.try_divide(n - q * p, sw) for n, p in zip(swn, swp, strict=True))
    a = q / 2
    return a, b, -F.try_divide(a * swpp + dot(b, swp), sw)


def fit_plane(sw: Column, swp: Vec, swn: Vec) -> tuple[Vec, Vec, Column]:
    """(mean, normal, signed distance of the origin) of the plane of the weighted sums."""
    mean = tuple(F.try_divide(v, sw) for v in swp)
    normal = normalize(swn)
    return mean, normal, -dot(normal, mean)


def sphere_quotient(top: Column, bottom: Column, swpp: Column, hits: Column) -> Column:
    """Twice the quadratic coefficient of the fitted sphere; 0 where it cannot be told."""
    return F.when(F.abs(bottom) < 4 * FLT_EPSILON * hits * F.abs(swpp), F.lit(0.0)).otherwise(F.coalesce(finite(F.try_divide(top, bottom)), F.lit(0.0)))


def with_distance(sums: DataFrame, shape: str, boundary_limit: float) -> DataFrame:
    """``sums`` with ``f``: the signed distance of a corner from the fitted surface, NULL where it is undefined, too far away or beyond the boundary.

    Each step is a projection of its own: as one nested expression the formula would repeat its parts hundreds of times."""
    col = F.col
    swp, swn = (col("spx"), col("spy"), col("spz")), (col("snx"), col("sny"), col("snz"))
    mean, b, foot = ((col(f"{n}x"), col(f"{n}y"), col(f"{n}z")) for n in ("_m", "_b", "_g"))
    name = lambda n, v: dict(zip((f"{n}x", f"{n}y", f"{n}z"), v, strict=True))
    out = sums.withColumns(name("_m", (F.try_divide(v, col("sw")) for v in swp))).withColumn("_spread", col("swpp") - dot(mean, swp))
    if shape == "sphere":
        out = out.withColumn("_top", col("swpn") - dot(mean, swn)).withColumn("_q", sphere_quotient(col("_top"), col("_spread"), col("swpp"), col("hits")))
        out = out.withColumns(name("_b", (F.try_divide(n - col("_q") * p, col("sw")) for n, p in zip(swn, swp, strict=True))))
        out = out.withColumn("_b2", dot(b, b)).withColumn("_c", -F.try_divide(col("_q") / 2 * col("swpp") + dot(b, swp), col("sw"))).withColumn("_a", col("_q") / 2 * col("_b2"))
        out = out.withColumn("_s", col("_b2") * col("_b2") - 4 * col("_a") * col("_c")).withColumn("_t", col("_b2") + F.when(col("_s") >= 0, F.sqrt("_s")))
        out = out.withColumn("_l", F.coalesce(finite(F.try_divide(-2 * col("_c"), col("_t"))), finite(F.try_divide(col("_t"), -2 * col("_a")))))
        out = out.withColumns(name("_g", scaled(b, col("_l")))).withColumn("_f", -F.try_divide(dot(b, foot), F.sqrt("_b2")))
    elif shape == "plane":
        out = out.withColumn("_size", length(swn)).withColumns(name("_b", (F.try_divide(v, col("_size")) for v in swn))).withColumn("_f", -dot(b, mean)).withColumns(name("_g", scaled(b, -col("_f"))))
    else:
        raise ValueError(f"shape must be sphere or plane, not {shape!r}")
    out = out.withColumn("_g2", dot(foot, foot)).withColumn("_rest", col("swpp") - 2 * dot(swp, foot) + col("sw") * col("_g2"))
    good = (col("hits") >= HITS) & (col("_g2") < MAX_DISTANCE2) & (col("_spread") > F.lit(boundary_factor(boundary_limit)) * col("_rest"))
    return out.withColumn("f", F.when(good, finite(col("_f")))).select(*sums.columns, "f")
