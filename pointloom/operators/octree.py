"""The octree of a bin: each splat in at most eight nodes of the level at which its box spans at most two on an axis; a leaf also sees its ancestors' splats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions import bits, mls

SLACK = 1.00001


def box_level(extent: Column, top: int) -> Column:
    """The lowest level at which ``extent`` cells (the largest of a box's last minus first) fall into two nodes: the bits of the number, held at the top."""
    return F.least(F.lit(top), F.when(extent <= 1, 0).otherwise(F.ceil(F.log2(extent.cast("double"))).cast("int")))


def entries(splats: DataFrame, levels: int, shift: int = 0) -> DataFrame:
    """``splat_id``, ``level``, ``code``: the nodes (cells of size 2^(level + shift)) that a splat's sphere touches; positions are in cells."""
    scale = F.lit(2.0**-shift)
    rows = splats.select("splat_id", *[(F.col(c).cast("double") * scale).alias(c) for c in ("x", "y", "z", "radius")])
    r = F.col("radius")
    lo = {a: F.greatest(F.floor(F.col(a) - r), F.lit(0).cast("long")) for a in "xyz"}
    hi = {a: F.least(F.floor(F.col(a) + r), F.lit((1 << (levels - 1)) - 1).cast("long")) for a in "xyz"}
    rows = rows.withColumns({f"l{a}": lo[a] for a in "xyz"} | {f"h{a}": hi[a] for a in "xyz"}).where((F.col("lx") <= F.col("hx")) & (F.col("ly") <= F.col("hy")) & (F.col("lz") <= F.col("hz")))
    extent = F.greatest(*[F.col(f"h{a}") - F.col(f"l{a}") for a in "xyz"])
    rows = rows.withColumn("level", box_level(extent, levels - 1))
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    for a in "xyz":
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(up(f"l{a}"), F.least(up(f"h{a}"), up(f"l{a}") + 1))))
    edge = F.pow(F.lit(2.0), F.col("level"))
    low = tuple(F.col(f"b{a}") * edge for a in "xyz")
    near = mls.point_box_dist2((F.col("x"), F.col("y"), F.col("z")), low, tuple(v + edge for v in low)) < r * r * F.lit(SLACK)
    return rows.where(near).select("splat_id", "level", bits.morton(F.col("bx"), F.col("by"), F.col("bz")).alias("code"))


def nodes(found: DataFrame) -> DataFrame:
    """``level``, ``code``, ``splats`` (sorted ids), ``n``: the runs of equal keys. A node's list is bounded where bins are."""
    return found.groupBy("level", "code").agg(F.array_sort(F.collect_list("splat_id")).alias("splats"), F.count("*").alias("n"))


def with_positions(found: DataFrame) -> DataFrame:
    """``start`` of each node's run if all are laid one after the other, by level and code, each with one more place for its end."""
    from pyspark.sql import Window as W

    order = W.orderBy("level", "code").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0)))


def chain(leaves: DataFrame, found: DataFrame, levels: int) -> DataFrame:
    """``code`` of a leaf (level 0) and what ``found`` has of it and of its ancestors: each ``splat_id`` of ``entries``, or a row a node."""
    rest = [c for c in found.columns if c not in ("level", "code")]
    ups = leaves.select("code", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    ups = ups.withColumn("of", F.call_function("shiftright", F.col("code"), F.col("level") * 3))
    return ups.join(found.select("level", F.col("code").alias("of"), *rest), ["level", "of"]).select("code", *rest)
