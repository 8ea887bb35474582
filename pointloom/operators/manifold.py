"""Mesh validation: the checks of a 2-manifold with boundary, and the mesh's metadata.

Triangles are (``i0``, ``i1``, ``i2``). Around a vertex v each triangle is an arrow from the next to the one after; the arrows must form one ring,
or lines that leave nothing over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.grid import defined
from pointloom.operators.components import connected_components
from pointloom.shared import keep

REASONS = ("out of range", "repeated vertex", "isolated", "repeated edge", "interior and boundary", "tunnel")


def arrows(triangles: DataFrame) -> DataFrame:
    """``v``, ``x``, ``y``: each corner of each triangle and the edge opposite."""
    turns = [F.struct(F.col(f"i{a}").alias("v"), F.col(f"i{b}").alias("x"), F.col(f"i{c}").alias("y")) for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    return triangles.select(F.explode(F.array(*turns)).alias("t")).select(*[F.col(f"t.{n}").cast("long").alias(n) for n in "vxy"])


def nonfinite_vertices(vertices: DataFrame) -> DataFrame:
    """The first vertex that is not finite."""
    return vertices.where(~defined(*[F.col(c) for c in "xyz"])).orderBy("vid").limit(1).select("vid")


def violations(num_vertices: int, triangles: DataFrame) -> DataFrame:
    """``reason`` and ``n`` (vertices, edges or triangles) for all that is wrong, in the order of ``REASONS``; no rows for a manifold."""
    three = [F.col(f"i{k}") for k in range(3)]
    out = triangles.where((F.least(*three) < 0) | (F.greatest(*three) >= num_vertices)).agg(F.count("*").alias("n")).select(F.lit(REASONS[0]).alias("reason"), "n")
    twice = triangles.where((three[0] == three[1]) | (three[1] == three[2]) | (three[0] == three[2])).agg(F.count("*").alias("n")).select(F.lit(REASONS[1]).alias("reason"), "n")
    turns = keep(arrows(triangles), "arrows")
    spark = triangles.sparkSession
    alone = spark.range(num_vertices).join(turns, F.col("id") == F.col("v"), "left_anti").agg(F.count("*").alias("n")).select(F.lit(REASONS[2]).alias("reason"), "n")
    edge = turns.groupBy("v", "x").agg(F.count("*").alias("c")).where(F.col("c") > 1).agg(F.count("*").alias("n")).select(F.lit(REASONS[3]).alias("reason"), "n")
    around = links(turns).where(F.col("simple"))
    mixed = around.where((F.col("lines") > 0) & (F.col("walked") != F.col("n"))).agg(F.count("*").alias("n")).select(F.lit(REASONS[4]).alias("reason"), "n")
    tunnel = around.where((F.col("lines") == 0) & (F.col("walked") != F.col("n"))).agg(F.count("*").alias("n")).select(F.lit(REASONS[5]).alias("reason"), "n")
    found = out.unionByName(twice).unionByName(alone).unionByName(edge).unionByName(mixed).unionByName(tunnel)
    return found.where(F.col("n") > 0)


def links(turns: DataFrame) -> DataFrame:
    """For each vertex: its arrows ``n``, whether each end is there once (``simple``), the number of lines, and the arrows ``walked`` from the lines' starts, or once around the first ring.
    A vertex has a handful of triangles; its link is walked in its row."""
    each = turns.groupBy("v").agg(F.collect_list(F.struct("x", "y")).alias("t"))
    each = each.select("v", F.size("t").alias("n"), F.transform("t", lambda e: e["x"]).alias("xs"), F.transform("t", lambda e: e["y"]).alias("ys"))
    each = each.withColumn("simple", (F.size(F.array_distinct("xs")) == F.col("n")) & (F.size(F.array_distinct("ys")) == F.col("n")))
    each = each.withColumn("starts", F.array_except("xs", "ys")).withColumn("lines", F.size("starts"))
    step = "element_at(ys, cast(array_position(xs, s.cur) as int))"
    walk = lambda start: f"""aggregate(sequence(1, n), named_struct('cur', {start}, 'len', 0, 'done', false),
        (s, i) -> if(s.done OR NOT array_contains(xs, s.cur), named_struct('cur', s.cur, 'len', s.len, 'done', true),
                     named_struct('cur', {step}, 'len', s.len + 1, 'done', {step} = {start})), s -> s.len)"""  # noqa: E731
    walked = F.expr(f"if(lines > 0, aggregate(transform(starts, b -> {walk('b')}), 0, (s, v) -> s + v), {walk('xs[0]')})")
    return each.withColumn("walked", F.when(F.col("simple"), walked))


def reason(num_vertices: int, triangles: DataFrame) -> str:
    """The first kind of violation, or the empty string."""
    found = {r["reason"] for r in violations(num_vertices, triangles).collect()}  # at most six rows
    return next((r for r in REASONS if r in found), "")


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """``a``, ``b``: edges that no triangle has the other way round."""
    turns = arrows(triangles).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return turns.join(turns.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


def boundaries(triangles: DataFrame) -> DataFrame:
    """``comp`` and ``n`` of each boundary loop of at least three vertices."""
    return connected_components(boundary_edges(triangles)).groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= 3)


def metadata(num_vertices: int, triangles: DataFrame) -> DataFrame:
    """One row: ``vertices``, ``triangles``, ``components`` (isolated vertices count), ``boundaries``."""
    spark = triangles.sparkSession
    edges = triangles.select(F.explode(F.array(F.struct(F.col("i0").alias("a"), F.col("i1").alias("b")), F.struct(F.col("i1").alias("a"), F.col("i2").alias("b")))).alias("e")).select("e.a", "e.b")
    loops = spark.range(num_vertices).select(F.col("id").alias("a"), F.col("id").alias("b"))
    comps = connected_components(edges.unionByName(loops)).select("comp").distinct().agg(F.count("*").alias("components"))
    return triangles.agg(F.count("*").alias("triangles")).crossJoin(comps).crossJoin(boundaries(triangles).agg(F.count("*").alias("boundaries"))).select(F.lit(num_vertices).cast("long").alias("vertices"), "triangles", "components", "boundaries")  # rows of one
