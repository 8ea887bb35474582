import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import components, field, manifold, marching, mesh, splats


def sphere_cloud(spark, n, r, radius=4.0, shift=0.0):
    i = np.arange(n)
    t, nz = i * math.pi * (3 - math.sqrt(5)), 1 - 2 * (i + 0.5) / n
    s = np.sqrt(1 - nz**2)
    normal = np.stack([s * np.cos(t), s * np.sin(t), nz], 1)
    p = normal * r + r + 10.3 + shift
    return spark.createDataFrame([(k, *map(float, (*p[k], radius, *normal[k], 1 / radius**2))) for k in range(n)], "splat_id long, x double, y double, z double, radius double, nx double, ny double, nz double, quality double")


def indexed(vertices, triangles):
    v, t = mesh.index(vertices, triangles)
    return v.count(), t


def test_table():
    counts = [marching.code_counts(c) for c in range(256)]
    assert len(marching.edges()) == 19
    assert (sum(a for a, _ in counts), sum(b for _, b in counts), max(a for a, _ in counts), max(b for _, b in counts)) == (2432, 5760, 13, 36)
    assert [counts[c] for c in (0, 255, 1, 128, 2, 15)] == [(0, 0), (0, 0), (7, 18), (7, 18), (4, 6), (9, 24)]


@pytest.mark.parametrize(("size", "centre", "r", "boundaries"), [((24, 25, 26), (11.0, 12.5, 12.75), 8.3, 0), ((20, 21, 18), (10.5, 11.5, 9.0), 11.5, None)])
def test_analytic_sphere_is_manifold(spark, size, centre, r, boundaries):
    f = F.sqrt(sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip("xyz", centre, strict=True))) - r
    v, t = marching.isosurface(marching.analytic_field(spark, size, f))
    n, t = indexed(v, t)
    assert manifold.reason(n, t) == ""
    got = manifold.metadata(n, t).first()
    if boundaries == 0:
        assert (got.components, got.boundaries, got.vertices - 3 * got.triangles // 2 + got.triangles) == (1, 0, 2)
    else:
        assert got.boundaries > 0


def test_alternating_field_is_manifold(spark):
    f = F.when((F.col("x").bitwiseXOR(F.col("y")).bitwiseXOR(F.col("z"))).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    n, t = indexed(*marching.isosurface(marching.analytic_field(spark, (8, 8, 8), f)))
    assert manifold.reason(n, t) == ""


@pytest.mark.parametrize(("shape", "far"), [("sphere", 1e-9), ("plane", 0.3)])
def test_mls_of_a_sphere(spark, shape, far):
    cloud = sphere_cloud(spark, 1500, 9.0)
    values = field.mls_field(cloud, shape).withColumn("d", F.abs(F.sqrt(sum((F.col(a) - 19.3) * (F.col(a) - 19.3) for a in "xyz")) - 9.0 - F.col("f")))
    assert values.agg(F.max("d")).first()[0] < far
    n, t = indexed(*marching.isosurface(values.select("x", "y", "z", "f")))
    got = manifold.metadata(n, t).first()
    assert manifold.reason(n, t) == "" and (got.components, got.boundaries) == (1, 0)


def test_expansion_is_the_distance_join(spark):
    cloud = sphere_cloud(spark, 20, 3.0, 2.2)
    got = {(r.i, r.j, r.k, round(r.x, 9), round(r.y, 9)) for r in field.expand(cloud).collect()}
    want = set()
    for s in cloud.collect():
        for i in range(5, 25):
            for j in range(5, 25):
                for k in range(5, 25):
                    if ((s.x - i) ** 2 + (s.y - j) ** 2 + (s.z - k) ** 2) / s.radius**2 < 0.99:
                        want.add((i, j, k, round(s.x, 9), round(s.y, 9)))
    assert got == want


def test_components_prune_and_chunks(spark):
    small = marching.analytic_field(spark, (30, 12, 12), F.least(F.sqrt((F.col("x") - 6) * (F.col("x") - 6) + (F.col("y") - 6) * (F.col("y") - 6) + (F.col("z") - 6) * (F.col("z") - 6)) - 4.2, F.sqrt((F.col("x") - 22) * (F.col("x") - 22) + (F.col("y") - 6) * (F.col("y") - 6) + (F.col("z") - 6) * (F.col("z") - 6)) - 1.7))
    v, t = marching.isosurface(small)
    t = t.withColumn("block", F.floor(F.col("x") / 4).cast("long"))
    whole, local = mesh.components(t), mesh.components(t, "block")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, local.select("key", "comp").collect()))
    sizes = mesh.component_sizes(t, whole).collect()
    assert len(sizes) == 2 and all(s.vertices - s.triangles * 3 // 2 + s.triangles == 2 for s in sizes)
    pv, pt = mesh.prune(v, t, 0.4)
    assert pv.count() == max(s.vertices for s in sizes) and pt.count() == max(s.triangles for s in sizes)
    chunked = t.withColumns(dict(zip(("cx", "cy", "cz"), mesh.chunk_of((F.col("x"), F.col("y"), F.col("z")), 7), strict=True)))
    nv, nt = mesh.index(v, chunked, ["cx", "cy", "cz"])
    totals = mesh.chunk_totals(nv, nt, ["cx", "cy", "cz"])
    assert totals.agg(F.sum("triangles")).first()[0] == t.count()
    spans = nv.groupBy("cx", "cy", "cz").agg(F.min("vid").alias("a"), F.max("vid").alias("b"), F.count_distinct("vid").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in spans)


def test_star_rounds_agree_with_one_task(spark):
    rng = np.random.default_rng(1)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(7, 7), (900, 900)] + [(1000 + i, 1001 + i) for i in range(60)], "a long, b long")
    few = sorted(map(tuple, components.connected_components(edges).collect()))
    many = sorted(map(tuple, components.connected_components(edges, one_task=0).collect()))
    assert few == many and (900, 900) in few and (1060, 1000) in few


TET = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 3, 2)]


@pytest.mark.parametrize(("n", "faces", "why"), [
    (4, TET, ""), (3, [(0, 1, 2)], ""), (3, [(0, 1, 3)], "out of range"), (3, [(0, 1, 1)], "repeated vertex"), (4, [(0, 1, 2)], "isolated"),
    (4, [(0, 1, 2), (0, 1, 3)], "repeated edge"), (7, [*TET, (0, 4, 5), (4, 6, 5)], "interior and boundary"),
    (7, [*TET, *[tuple(0 if v == 0 else v + 3 for v in f) for f in TET]], "tunnel"),
])
def test_manifold_reasons(spark, n, faces, why):
    assert manifold.reason(n, spark.createDataFrame(faces, "i0 int, i1 int, i2 int")) == why


def test_boundaries_and_nonfinite(spark):
    t = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "i0 int, i1 int, i2 int")
    got = manifold.metadata(5, t).first()
    assert (got.components, got.boundaries, got.triangles) == (2, 1, 2)
    v = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, float("nan"), 0.0, 0.0), (2, float("inf"), 0.0, 0.0)], "vid long, x double, y double, z double")
    assert manifold.nonfinite_vertices(v).collect()[0].vid == 1


def test_blobs_roundtrip(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), int(i // 3 * 2 if i % 11 == 0 else i // 3), *map(float, rng.uniform(-40, 40, 3)), float(rng.uniform(0.1, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "scan int, splat_id long, x double, y double, z double, radius double").dropDuplicates(["scan", "splat_id"])
    found = splats.blobs(splats.with_boxes(df, None, 2.0, 5))
    columns = ["scan", "first", "last", *[f"{n}_{a}" for n in ("lo", "hi") for a in "xyz"]]
    back = splats.decode_blobs(splats.encode_blobs(found))
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, back.select(columns).collect()))
    assert found.agg(F.sum(F.col("last") - F.col("first"))).first()[0] == df.count()


def test_bucket_boxes(spark):
    from pointloom.functions.grid import Grid

    g = Grid((10.0, -50.0, 40.0), 20.0, ((-1, 5), (1, 100), (2, 50)))
    df = spark.createDataFrame([(0, 115.0, -31.0, 1090.0, 7.0), (1, -1000.0, -1000.0, -1000.0, 100.0)], "splat_id long, x double, y double, z double, radius double")
    names = [f"{n}_{a}" for n in ("lo", "hi") for a in "xyz"]
    assert [tuple(r) for r in splats.with_boxes(df, g, bucket=3).orderBy("splat_id").select(names).collect()] == [(1, -1, 16, 2, 0, 16), (-19, -18, -20, -15, -15, -17)]
    one = spark.createDataFrame([(0, -9.0, 100.0, -125.0, 5.0)], "splat_id long, x double, y double, z double, radius double")
    assert tuple(splats.with_boxes(one, None, 4.0, 10).select(names).first()) == (-1, 2, -4, -1, 2, -3)


def test_ranges(spark):
    r = spark.createDataFrame([(0, 0, 5), (0, 5, 7), (0, 6, 6), (0, 9, 12), (1, 3, 4), (0, 30, 31)], "bin int, first long, last long")
    got = sorted(map(tuple, splats.merge_ranges(r, "bin").collect()))
    assert got == [(0, 0, 7), (0, 9, 12), (0, 30, 31), (1, 3, 4)]
    assert sorted(map(tuple, splats.merge_ranges(r, "bin", 2).collect()))[0] == (0, 0, 12)
    ids = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 3), (1, 4)], "bin int, splat_id long")
    kept = sorted(map(tuple, splats.in_ranges(ids, splats.merge_ranges(r, "bin"), "bin").collect()))
    assert kept == [(0, i) for i in [*range(7), 9, 10, 11, 30]] + [(1, 3)]


def test_nonfinite_rows_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(2.0, 0.0, 0.0, nan), (2.0, 1.0, 0.0, 1.0), (2.0, nan, 0.0, 1.0), (inf, 0.0, 0.0, 1.0), (6.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([(*r, 1.0, 0.0, 0.0) for r in rows], "x double, y double, z double, radius double, nx double, ny double, nz double")
    made = splats.project(df, 2.0, 250.0)
    assert splats.finite(made).count() == 1 and splats.nonfinite_count(made).first()[0] == 5
    assert tuple(splats.finite(made).select("radius", "quality").first()) == (2.0, 0.25)
