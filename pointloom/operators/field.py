"""The scalar field: every grid corner's distance from the surface that the splats around it fit.

The join of corners and splats is an equi-join in disguise: each splat is expanded to the integer corners within its sphere, axis by axis, with
the part of the sphere that is left as the bound of the next axis; then one aggregation by corner, combined in each task before the shuffle,
makes all the sums. No distance predicate is ever given to the optimiser as a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import mls
from pointloom.shared import keep


def expand(splats: DataFrame) -> DataFrame:
    """A row for each corner (``i``, ``j``, ``k``) and splat with distance^2 / radius^2 < NEAR; positions are in cells. ``px`` .. ``pz`` are relative to the corner, ``d`` is the ratio."""
    reach = F.sqrt(F.lit(mls.NEAR)) * F.col("radius")
    rows = splats.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius", "nx", "ny", "nz", "quality")]).where(F.col("radius") > 0).withColumn("left", reach * reach)
    for axis, corner, p in (("x", "i", "px"), ("y", "j", "py"), ("z", "k", "pz")):
        half = F.sqrt(F.greatest(F.col("left"), F.lit(0.0)))
        lo, hi = F.ceil(F.col(axis) - half), F.floor(F.col(axis) + half)
        rows = rows.withColumn(corner, F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn(p, F.col(axis) - F.col(corner)).withColumn("left", F.col("left") - F.col(p) * F.col(p))
    d = (F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")) / (F.col("radius") * F.col("radius"))
    return rows.withColumn("d", d).where(F.col("d") < mls.NEAR).drop("left")


def weighted_sums(expanded: DataFrame) -> DataFrame:
    """The sums of each corner."""
    pp = F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")
    pn = F.col("px") * F.col("nx") + F.col("py") * F.col("ny") + F.col("pz") * F.col("nz")
    e = 1 - F.col("d")
    rows = expanded.withColumn("w", e * e * e * e * F.col("quality")).withColumn("pp", pp).withColumn("pn", pn)
    sums = {"sw": F.lit(1.0), "spx": F.col("px"), "spy": F.col("py"), "spz": F.col("pz"), "snx": F.col("nx"), "sny": F.col("ny"), "snz": F.col("nz"), "swpp": F.col("pp"), "swpn": F.col("pn")}
    return rows.groupBy("i", "j", "k").agg(*[F.sum(F.col("w") * v).alias(n) for n, v in sums.items()], F.count("*").alias("hits"))


def mls_field(splats: DataFrame, shape: str = "sphere", boundary_limit: float = 1.0) -> DataFrame:
    """``x``, ``y``, ``z`` (integer corners) and ``f``, of the corners where the surface is defined; kept in the shared folder."""
    sums = weighted_sums(expand(splats)).where(F.col("hits") >= mls.HITS)
    # kept before the undefined are filtered: pushed down, that filter would be the whole formula as one expression
    found = keep(mls.with_distance(sums, shape, boundary_limit).select(F.col("i").cast("int").alias("x"), F.col("j").cast("int").alias("y"), F.col("k").cast("int").alias("z"), "f"), "field")
    return found.where(F.col("f").isNotNull())
