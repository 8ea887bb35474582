"""Meshes: components and pruning, chunks, dense numbering, transforms, and the joins that replace keys by numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointloom.functions.grid import Grid
from pointloom.operators.components import connected_components
from pointloom.shared import keep

MAX_CHUNK_VERTICES = (1 << 32) - 1
VERTEX_BYTES, TRIANGLE_BYTES = 12, 13


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """Two edges of each triangle: the third would join nothing more."""
    return triangles.select(F.explode(F.array(F.struct(F.col("k0").alias("a"), F.col("k1").alias("b")), F.struct(F.col("k1").alias("a"), F.col("k2").alias("b")))).alias("e")).select("e.a", "e.b")


def components(triangles: DataFrame, block: str | None = None) -> DataFrame:
    """``key``, ``comp`` of every vertex of a triangle. With ``block`` (a column of the triangles), components are first found within each block, in that block's
    task, and only the vertices that several blocks share, with their blocks' components, go on to the whole graph's."""
    if block is None:
        return connected_components(triangle_edges(triangles)).select(F.col("node").alias("key"), "comp")
    import pandas as pd

    from pointloom.operators.components import union_find

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pd.concat([pdf["k0"], pdf["k1"]]).to_numpy()
        v = pd.concat([pdf["k1"], pdf["k2"]]).to_numpy()
        nodes, comp = union_find(u, v)
        return pd.DataFrame({"block": pdf[block].iloc[0], "key": nodes, "local": comp})

    found = keep(triangles.groupBy(block).applyInPandas(local, "block long, key long, local long"), "local-components")
    # the smallest key of a component names it, so a key that two blocks share joins their names
    joined = connected_components(found.where(F.col("key") != F.col("local")).select("key", "local").join(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key"), "key", "left_semi"), "key", "local")
    names = found.select("local").distinct().join(joined.select(F.col("node").alias("local"), "comp"), "local", "left").select("local", F.coalesce("comp", "local").alias("comp"))
    return found.join(names, "local").groupBy("key").agg(F.min("comp").alias("comp"))


def component_sizes(triangles: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp``, ``vertices`` (each once, however many blocks it is in) and ``triangles``."""
    vertices = labels.groupBy("comp").agg(F.count("*").alias("vertices"))
    faces = triangles.select(F.col("k0").alias("key")).join(labels, "key").groupBy("comp").agg(F.count("*").alias("triangles"))
    return vertices.join(faces, "comp", "left").select("comp", "vertices", F.coalesce("triangles", F.lit(0).cast("long")).alias("triangles"))


def prune_threshold(total_vertices: int, share: float) -> int:
    return int(total_vertices * share)


def keep_components(sizes: DataFrame, share: float) -> DataFrame:
    """The components of at least ``floor(total vertices x share)`` vertices."""
    total = sizes.agg(F.coalesce(F.sum("vertices"), F.lit(0)).alias("total"))
    return sizes.crossJoin(F.broadcast(total)).where(F.col("vertices") >= F.floor(F.col("total") * F.lit(share))).drop("total")  # one row is broadcast


def totals(sizes: DataFrame, share: float) -> DataFrame:
    """One row: components, vertices and triangles, all and kept."""
    kept = F.col("vertices") >= F.floor(F.col("total") * F.lit(share))
    all_of = sizes.crossJoin(F.broadcast(sizes.agg(F.coalesce(F.sum("vertices"), F.lit(0)).alias("total"))))
    zero = F.lit(0).cast("long")
    return all_of.agg(
        F.count("*").alias("components"), F.coalesce(F.sum("vertices"), zero).alias("vertices"), F.coalesce(F.sum("triangles"), zero).alias("triangles"),
        F.coalesce(F.sum(kept.cast("long")), zero).alias("kept_components"), F.coalesce(F.sum(F.when(kept, F.col("vertices"))), zero).alias("kept_vertices"), F.coalesce(F.sum(F.when(kept, F.col("triangles"))), zero).alias("kept_triangles"),
    )


def prune(vertices: DataFrame, triangles: DataFrame, share: float, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The mesh without components of fewer vertices than ``share`` of all."""
    labels = keep(components(triangles) if labels is None else labels, "labels")
    good = labels.join(keep_components(component_sizes(triangles, labels), share).select("comp"), "comp", "left_semi").select("key")
    good = keep(good, "kept-keys")
    return vertices.join(good, "key", "left_semi"), triangles.join(good.select(F.col("key").alias("k0")), "k0", "left_semi")


def chunk_of(cell: tuple[Column, Column, Column], chunk_cells: int, low: tuple[int, int, int] = (0, 0, 0)) -> tuple[Column, ...]:
    return tuple(F.floor((c - F.lit(o)) / F.lit(chunk_cells)).cast("int") for c, o in zip(cell, low, strict=True))


def chunk_vertices(vertices: DataFrame, triangles: DataFrame, chunk: list[str]) -> DataFrame:
    """Each chunk's vertices, once each: a vertex of several chunks is in all of them."""
    used = triangles.select(*chunk, F.explode(F.array("k0", "k1", "k2")).alias("key")).distinct()
    return used.join(vertices, "key")


def number(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Dense numbers from 0 within each ``by``, in the order of a key, without a whole chunk in one task: rows are cut into ranges, counted, and numbered within a range from the
    counts of the ranges before (a row for each range and chunk)."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = keep(df.repartitionByRange(parts, *by, order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = cut.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = W.partitionBy(*by, "__part").orderBy(order)
    return cut.join(starts, [*by, "__part"]).withColumn(name, (F.col("__start") + F.row_number().over(within) - 1).cast("long")).drop("__part", "__start")


def index(vertices: DataFrame, triangles: DataFrame, chunk: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices with ``vid``, triangles with ``i0``, ``i1``, ``i2``): numbers within each chunk."""
    chunk = chunk or []
    numbered = keep(number(chunk_vertices(vertices, triangles, chunk) if chunk else vertices, chunk, "key", "vid"), "vertices")
    out = triangles
    for v in range(3):
        out = out.join(numbered.select(*chunk, F.col("key").alias(f"k{v}"), F.col("vid").alias(f"i{v}")), [*chunk, f"k{v}"])
    return numbered, out


def chunk_totals(vertices: DataFrame, triangles: DataFrame, chunk: list[str]) -> DataFrame:
    """``vertices``, ``triangles`` and output ``bytes`` of each chunk; an error where vertices cannot be numbered in 32 bits."""
    v = vertices.groupBy(*chunk).agg(F.count("*").alias("vertices"))
    t = triangles.groupBy(*chunk).agg(F.count("*").alias("triangles"))
    both = v.join(t, chunk).withColumn("bytes", F.col("vertices") * VERTEX_BYTES + F.col("triangles") * TRIANGLE_BYTES)
    return both.withColumn("vertices", F.when(F.col("vertices") <= MAX_CHUNK_VERTICES, F.col("vertices")).otherwise(F.raise_error(F.lit("Too many vertices in one chunk")).cast("long")))


def running_offsets(sizes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Where each component's vertices and triangles begin if a chunk's are laid one after the other."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumns({f"start_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("vertices", "triangles")})


def scale_bias(vertices: DataFrame, scale: float, bias: tuple[float, float, float]) -> DataFrame:
    """Affine transform of the positions."""
    return vertices.withColumns({a: F.col(a) * F.lit(float(scale)) + F.lit(float(b)) for a, b in zip("xyz", bias, strict=True)})


def to_world(vertices: DataFrame, grid: Grid) -> DataFrame:
    return scale_bias(vertices, grid.spacing, tuple(r + grid.spacing * lo for r, (lo, _) in zip(grid.reference, grid.extents, strict=True)))


def filter_chain(*filters: Callable[[tuple[DataFrame, DataFrame]], tuple[DataFrame, DataFrame]]) -> Callable[[tuple[DataFrame, DataFrame]], tuple[DataFrame, DataFrame]]:
    """Mesh filters, one after the other."""

    def run(mesh: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
        for f in filters:
            mesh = f(mesh)
        return mesh

    return run


def chunk_name(base: Column | str, cx: Column, cy: Column, cz: Column) -> Column:
    return F.format_string("%s_%04d_%04d_%04d.ply", F.lit(base) if isinstance(base, str) else base, cx, cy, cz)
