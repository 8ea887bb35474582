import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import bucket, octree, simulate, splats, telemetry
from pointloom.functions.grid import Grid
from pointloom.plans import reconstruct
from pointloom.shipping import ship
from pointloom.sources import ply

HEAD = "ply\nformat binary_little_endian 1.0\n"
FULL = HEAD + "element vertex {n}\n" + "".join(f"property float32 {p}\n" for p in ("x", "y", "z", "nx", "ny", "nz", "radius")) + "end_header\n"


def put(path, header, payload=b""):
    path.write_bytes(header.encode() + payload)
    return str(path)


GOOD = FULL.format(n=0).splitlines()

#: What is done to the lines of a good header, and what is then said of it.
SPOILED = {
    "no bytes": (lambda lines: [], "first line"),
    "other first line": (lambda lines: ["PLY", *lines[1:]], "first line"),
    "no last line": (lambda lines: lines[:-1], "no last line"),
    "no format": (lambda lines: [x for x in lines if not x.startswith("format")], "no format"),
    "format without version": (lambda lines: [lines[0], "format binary_little_endian", *lines[2:]], "a name and a version"),
    "other format": (lambda lines: [lines[0], "format base64 1.0", *lines[2:]], "cannot read"),
    "other version": (lambda lines: [lines[0], lines[1].replace("1.0", "2.0"), *lines[2:]], "only version"),
    "text rows": (lambda lines: [lines[0], "format ascii 1.0", *lines[2:]], "point clouds are read in"),
    "other byte order": (lambda lines: [lines[0], lines[1].replace("little", "big"), *lines[2:]], "point clouds are read in"),
    "no element": (lambda lines: [*lines[:2], lines[-1]], "no element"),
    "element without count": (lambda lines: [*lines[:2], "element vertex", *lines[3:]], "a name and a count"),
    "count in words": (lambda lines: [*lines[:2], "element vertex five", *lines[3:]], "a number under"),
    "count below zero": (lambda lines: [*lines[:2], "element vertex -7", *lines[3:]], "a number under"),
    "count beyond 64 bits": (lambda lines: [*lines[:2], f"element vertex {2**64}", *lines[3:]], "a number under"),
    "property before its element": (lambda lines: [*lines[:2], lines[3], lines[2], *lines[4:]], "belongs to no element"),
    "property without name": (lambda lines: [*lines[:-1], "property uchar", lines[-1]], "a property line"),
    "property with two names": (lambda lines: [*lines[:-1], "property uchar red green", lines[-1]], "a property line"),
    "property of no type": (lambda lines: [*lines[:-1], "property quaternion q", lines[-1]], "no such scalar type"),
    "property twice": (lambda lines: [*lines[:-1], "property uchar radius", lines[-1]], "two properties"),
    "list without element type": (lambda lines: [*lines[:-1], "property list uint8 neighbours", lines[-1]], "a property line"),
    "list of fractional length": (lambda lines: [*lines[:-1], "property list float32 int32 neighbours", lines[-1]], "whole number"),
    "list in a vertex": (lambda lines: [*lines[:-1], "property list uint8 int32 neighbours", lines[-1]], "a fixed size"),
    "line of another kind": (lambda lines: [*lines[:-1], "texture none.png", lines[-1]], "begins with"),
    "other element first": (lambda lines: [*lines[:2], "element camera 0", *lines[2:]], "begins with its vertex"),
    "property missing": (lambda lines: [x for x in lines if not x.endswith(" nz")], "lack nz"),
    "property of another type": (lambda lines: [x.replace("float32 ny", "float64 ny") for x in lines], "32-bit float"),
    "rows missing": (lambda lines: [x.replace("vertex 0", "vertex 3") for x in lines], "shorter"),
}


@pytest.mark.parametrize("name", SPOILED)
def test_bad_files_are_named(tmp_path, name):
    spoil, said = SPOILED[name]
    assert ply.splat_layout(put(tmp_path / "good.ply", "\n".join(GOOD) + "\n"))
    uri = put(tmp_path / "bad.ply", "".join(f"{x}\n" for x in spoil(GOOD)))
    with pytest.raises(ply.FormatError, match=f"bad.ply.*{said}"):
        ply.splat_layout(uri)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_any_layout(spark, tmp_path, seed):
    ship(spark)
    rng = np.random.default_rng(seed)
    names = {"uint8": "u1", "int16": "<i2", "float64": "<f8", "uint32": "<u4"}
    fields = [(p, "float", "<f4") for p in ("x", "y", "z", "nx", "ny", "nz", "radius")] + [(f"extra{i}", k, v) for i, (k, v) in enumerate(names.items())]
    fields = [fields[i] for i in rng.permutation(len(fields))]
    data = np.zeros(23, np.dtype([(n, v) for n, _, v in fields]))
    for n, _, _ in fields:
        data[n] = rng.integers(0, 200, 23)
    header = HEAD + "comment any order\nelement vertex 23\n" + "".join(f"property {k} {n}\n" for n, k, _ in fields) + "element edge 1\nproperty int a\nend_header\n"
    put(tmp_path / "b.ply", header, data.tobytes() + b"\0\0\0\0")
    put(tmp_path / "a.ply", FULL.format(n=0))
    put(tmp_path / "note.txt", "")
    ply.register(spark)
    df = spark.read.format("splat_ply").option("rowspertask", "4").load(str(tmp_path))
    read = ("x", "y", "z", "nx", "ny", "nz", "radius")
    assert [(r.file_id, r.row, *[r[p] for p in read]) for r in df.orderBy("file_id", "row").collect()] == [(1, i, *[float(data[p][i]) for p in read]) for i in range(23)]
    made = splats.project(df, 3.0, 50.0).orderBy("row").select("radius").collect()
    assert [r.radius for r in made] == [3 * min(50.0, float(x)) for x in data["radius"]]
    with pytest.raises(FileNotFoundError):
        ply._paths({"path": str(tmp_path / "none.ply")})


def test_writer_bytes(spark, tmp_path):
    ship(spark)
    assert len(ply.mesh_header(4, 3, ("a", "comment two"))) % 4 == 0 and b"comment padding:X" in ply.mesh_header(4, 3, ("a",)) + ply.mesh_header(40, 3, ("a",)) + ply.mesh_header(400, 3, ("a",)) + ply.mesh_header(4000, 3, ("a",))
    v = spark.createDataFrame([(i, float(i), i + 0.5, -1.0 * i) for i in range(4)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 2, 3)], "i0 long, i1 long, i2 long")
    names = spark.createDataFrame([("m.ply", 4, 3)], "file string, vertices long, triangles long")
    assert ply.write_mesh(v, t, names, str(tmp_path), by=[], comments=("made here",)) == ["m.ply"]
    blob = (tmp_path / "m.ply").read_bytes()
    assert len(blob) == len(ply.mesh_header(4, 3, ("made here",))) + 87
    ply.register(spark)
    faces = spark.read.format("ply").option("element", "face").load(str(tmp_path / "m.ply")).orderBy("row").collect()
    assert [list(r.vertex_indices) for r in faces] == [[0, 1, 2], [0, 2, 3], [1, 2, 3]]
    assert ply.read_header(str(tmp_path / "m.ply")).comments[0] == "made here"


def test_generic_reader(spark, tmp_path):
    ship(spark)
    ply.register(spark)
    text = "ply\nformat ascii 1.0\ncomment hi\nelement vertex 2\nproperty short a\nproperty list uchar double b\nelement face 1\nproperty int c\nend_header\n-3 2 1.5 2e3\n4 0\n7\n"
    uri = put(tmp_path / "t.ply", text)
    rows = spark.read.format("ply").load(uri).orderBy("row").collect()
    assert [(r.a, list(r.b)) for r in rows] == [(-3, [1.5, 2000.0]), (4, [])]
    assert spark.read.format("ply").option("element", "face").load(uri).first().c == 7
    big = "ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty ushort a\nproperty list uchar int b\nend_header\n"
    payload = b"".join(np.array([a], ">u2").tobytes() + bytes([len(b)]) + np.array(b, ">i4").tobytes() for a, b in ((65535, [1, -2]), (3, [])))
    rows = spark.read.format("ply").load(put(tmp_path / "u.ply", big, payload)).orderBy("row").collect()
    assert [(r.a, list(r.b)) for r in rows] == [(65535, [1, -2]), (3, [])]
    for word, kind in (("256", "u1"), ("-1", "u2"), ("1.0", "i4"), ("0x10", "i4"), ("", "f4"), ("1e", "f8"), ("abc", "f4")):
        with pytest.raises(ply.FormatError):
            ply.ascii_number(word, kind)


def test_request_planning():
    assert ply.merge_requests([(0, 10), (12, 20), (100, 110), (111, 300)], 100 * 32, 32) == [(0, 20), (100, 110), (111, 300)]
    a = 1 << 40
    assert ply.clip_ranges([(a - 3, a + 4)], 2) == [(a - 3, a - 1), (a - 1, a), (a, a + 2), (a + 2, a + 4)]
    assert [splats.partition_rows(10, r, 3) for r in range(3)] == [(0, 3), (3, 6), (6, 10)]


def cloud(spark):
    rows = [(0, 10, 20, 2), (0, 30, 17, 1), (0, 32, 12, 1), (0, 32, 18, 1), (0, 37, 18, 1), (0, 35, 16, 3), (1, 12, 37, 1), (1, 13, 37, 1), (1, 12, 38, 1), (1, 13, 38, 1), (1, 17, 32, 1), (3, 18, 33, 1), (3, 25, 45, 4)]
    return spark.createDataFrame([(k, float(x), float(y), 10.0, float(r)) for k, (_, x, y, r) in enumerate(rows)], "splat_id long, x double, y double, z double, radius double")


REGION = Grid((-10.0, 0.0, 10.0), 2.5, ((4, 20), (0, 20), (-4, 4)))


@pytest.mark.parametrize(("splats_", "cells"), [(5, 8), (15, 32)])
def test_buckets_cover(spark, splats_, cells):
    found = bucket.bucket(cloud(spark), REGION, max_splats=splats_, max_cells=cells, micro_cells=0, max_split=10**6)
    bins = {r.bin_id: r for r in found.bins.collect()}
    members = {}
    for r in found.members.collect():
        members.setdefault(r.bin_id, []).append(r.splat_id)
    assert (len(bins) == 1) == (splats_ == 15)
    assert all(len(set(m)) == len(m) <= splats_ for m in members.values())
    dims = [REGION.num_cells(i) for i in range(3)]
    cells_of = {}
    for k, b in bins.items():
        assert max(b.hi_x - b.lo_x, b.hi_y - b.lo_y, b.hi_z - b.lo_z) <= cells
        for c in np.ndindex(b.hi_x - b.lo_x, b.hi_y - b.lo_y, b.hi_z - b.lo_z):
            at = (b.lo_x + c[0], b.lo_y + c[1], b.lo_z + c[2])
            assert at not in cells_of
            cells_of[at] = k
    for s in splats.with_boxes(cloud(spark), REGION).collect():
        for x in range(max(0, s.lo_x), min(dims[0] - 1, s.hi_x) + 1):
            for y in range(max(0, s.lo_y), min(dims[1] - 1, s.hi_y) + 1):
                for z in range(max(0, s.lo_z), min(dims[2] - 1, s.hi_z) + 1):
                    assert s.splat_id in members[cells_of[x, y, z]]


def test_density_error(spark):
    with pytest.raises(bucket.DensityError):
        bucket.bucket(cloud(spark), REGION, max_splats=1, max_cells=8)


def test_chunks_and_sizes():
    assert bucket.round_chunk(0, 70, 100, 16) == 80 and bucket.round_chunk(50, 70, 40, 16) == 64 and bucket.chunk_cells_of(100 << 20) == 372
    assert bucket.choose_micro_size((64, 64, 64), 1 << 30, 10, 1000, 64) >= 1


def test_octree_sees_all(spark):
    rng = np.random.default_rng(6)
    rows = [(k, *map(float, rng.uniform(-2, 33, 3)), float(rng.uniform(0.25, 8))) for k in range(60)]
    df = spark.createDataFrame(rows, "splat_id long, x double, y double, z double, radius double")
    got = octree.entries(df, 6)
    assert got.groupBy("splat_id").count().agg(F.max("count")).first()[0] <= 8
    seen = {}
    for r in got.collect():
        seen.setdefault((r.level, r.code), set()).add(r.splat_id)
    def code(x, y, z):
        return sum(((x >> b & 1) << 3 * b) | ((y >> b & 1) << 3 * b + 1) | ((z >> b & 1) << 3 * b + 2) for b in range(5))
    for x, y, z in rng.integers(0, 32, (150, 3)):
        chain = set().union(*(seen.get((lv, code(x >> lv, y >> lv, z >> lv)), set()) for lv in range(6)))
        for k, sx, sy, sz, r in rows:
            d = sum(max(lo - v, v - lo - 1, 0) ** 2 for v, lo in ((sx, x), (sy, y), (sz, z)))
            if d < r * r:
                assert k in chain


def test_registry_and_timeline(spark):
    lines = ["slave options:  --levels=6 --fit-grid=0.5", "device.compute: 4.5 : 1.5 +/- 0.1 [3]", "device.pop.first: 1 : 0.5 +/- 0 [2]", "pass1.time: 10", "bucket.compute: 4", "odd.push: 3", "x: [0]"]
    parsed = telemetry.parse_statistics(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.name: r.value for r in parsed.collect()}
    assert got == {"levels": 6.0, "fit-grid": 0.5, "device.compute": 4.5, "device.pop.first": 1.0, "pass1.time": 10.0, "bucket.compute": 4.0, "odd.push": 3.0, "x": 0.0}
    assert [tuple(r) for r in telemetry.thread_counts(parsed).collect()] == [("total-device-threads", 2)]
    assert {(r.worker, r.action): round(r.percent, 3) for r in telemetry.breakdown(parsed).collect()} == {("main", "compute"): 40.0, ("main", "other"): 60.0, ("device", "compute"): round(450 / 5.5, 3), ("device", "startup"): round(100 / 5.5, 3)}
    assert [r.name for r in telemetry.unmatched_times(parsed).collect()] == ["odd.push"]
    events = ["EVENT w.2 load 0.5 2.0", "VALUE 3", "VALUE 4", "EVENT w.10 load 1.0 1.5", "junk", "EVENT w.2 work 3.0 4.0"]
    t = telemetry.parse_timeline(spark.createDataFrame(list(enumerate(events)), "line long, value string"))
    assert [(r.worker, r.value) for r in t.orderBy("line").collect()] == [("w.2", 4), ("w.10", None), ("w.2", None)]
    assert [tuple(r) for r in telemetry.worker_times(t).collect()] == [("w.2", 0.5, 1.0, 0.0), ("w.10", 1.0, 0.0, 2.5)]
    assert [tuple(r) for r in telemetry.idle_gaps(t).collect()] == [("w.2", 3.0, 1.0)]
    a = spark.createDataFrame([("n", "counter", 1, 0.0, 0.0, 0, 0)], "name string, kind string, total long, sum double, sum2 double, n long, peak long")
    b = a.withColumn("kind", F.lit("peak"))
    assert telemetry.merge(a, a).first().total == 2
    with pytest.raises(Exception, match="two kinds"):
        telemetry.merge(a, b).collect()
    trace = spark.createDataFrame(list(enumerate(["VERTICES 0 5", "CHUNK 3", "VERTICES 5 9", "TRIANGLES 0 2"])), "line long, value string")
    assert [tuple(r)[1:] for r in telemetry.parse_accesses(trace).orderBy("line").collect()] == [(0, "vertices", 0, 5), (3, "vertices", 5, 9), (3, "triangles", 0, 2)]


def test_simulations():
    cache = simulate.PageCache(10, 2)
    for a in ((0, 15), (0, 5), (25, 30), (10, 11)):
        cache.access(*a)
    assert (cache.hits, cache.misses, cache.loaded) == (1, 4, 40)
    made = simulate.reorder([simulate.Access(1, (0, 2), (0, 1)), simulate.Access(0, (2, 3), (1, 2)), simulate.Access(0, (3, 9), (2, 3))], 60)
    assert [(m.chunk, m.vertices, m.triangles) for m in made] == [(0, (0, 1), (0, 1)), (1, (1, 3), (1, 2)), (0, (3, 9), (2, 3))]
    out = simulate.pipeline([simulate.Stage("a", 1, 10), simulate.Stage("b", 2, 1)], [([1.0, 3.0], 1.0)] * 4)
    assert out["a"]["busy"] == 4 and out["b"]["busy"] == 12 and out["b"]["total"] == 8


def test_reconstruct_checkpoint_and_resume(spark, tmp_path):
    from test_surface import sphere_cloud

    ship(spark)
    points = sphere_cloud(spark, 900, 1.5, 0.5, -10.3)
    ply.write_points(points, str(tmp_path / "in.ply"))
    assert reconstruct.concatenate(spark, [str(tmp_path / "in.ply")] * 2, str(tmp_path / "both.ply")) == 1800
    args = ["-o", str(tmp_path / "out.ply"), "--fit-grid", "0.25", "--fit-smooth", "1", "--quiet"]
    reconstruct.main([*args, "--checkpoint", str(tmp_path / "stage"), str(tmp_path / "in.ply")], spark)
    got = reconstruct.main([*args, "--resume", str(tmp_path / "stage"), "--statistics-file", str(tmp_path / "s.txt")], spark)
    assert got["files"] == ["out.ply"] and got["kept_components"] == got["components"] == 1 and (tmp_path / "s.txt").read_text().startswith("components: 1")
    again = reconstruct.main([*args, "--resume", str(tmp_path / "stage"), "--split", "--split-size", "20K"], spark)
    assert len(again["files"]) > 1 and again["files"][0].startswith("out_0000_0000_")
    with pytest.raises(ValueError, match="At least one"):
        reconstruct.main(["-o", "x.ply", "--quiet"], spark)
    for bad in ({"fit_prune": 1.5}, {"max_split": 7}, {"levels": 0}, {"fit_grid": 0.0}):
        with pytest.raises(ValueError):
            reconstruct.Config(**bad).validated()
