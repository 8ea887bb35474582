"""A test for each finding of FINDINGS_r03.md."""

import random

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import op7_url_templates
from pointloom.operators import components, octree, simulate, splats, telemetry
from pointloom.plans import parity
from pointloom.shipping import ship
from pointloom.sources import ply


def test_f1_rules_are_the_contracts(spark, tmp_path):
    urls = ["http://net/de/", "http://a.net/de/9", "http://example.net/de/8", "http://x.example.net/de/80", "http://a.com/en/1", "http://example.com/en/71", "http://a.org/es/", "http://a.net/dex"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in op7_url_templates.query(spark, str(tmp_path)).collect()}
    want = [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]
    assert [got[i] for i in range(len(urls))] == want


def test_f8_f10_f12_ids_are_numbered_by_many_tasks(spark, tmp_path):
    """One line number only: its rows are sorted by several tasks, and numbered by order, whatever their place in the file."""
    rows = spark.range(4000).select(((F.col("id") * 7919) % 4000).alias("l_orderkey"), *[F.lit(1).cast("long").alias(c) for c in ("l_partkey", "l_suppkey")], F.lit(3).alias("l_linenumber"), *[F.lit(1.0).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    rows.unionByName(rows.limit(2).withColumn("l_linenumber", F.lit(None).cast("int"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = parity.lineitem_splats(spark, str(tmp_path)).select("scan", "splat_id", "nx", F.input_file_name().alias("file")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.splat_id, r.nx) for r in made if r.scan is not None)
    assert got == [((3 << 40) + i, float(i % 7 - 3)) for i in range(4000)] and len(made) == 4002
    assert len({r.file for r in made}) > 2


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_hand(rows):
    """Runs of (id, box)."""
    out = []
    for i, box in rows:
        if out and out[-1][1] == i and out[-1][2] == box:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, box])
    return [tuple(x) for x in out]


def splat_rows(spark):
    """Long and short runs over blocks of 8 ids, gaps, and steps that differences hold for many blocks."""
    rows = [(s, i, float((i // k if k else 0) % 50)) for s, k in ((0, 0), (1, 1), (2, 5), (3, 11), (4, 8), (5, 16)) for i in range(150) if (i + s) % 37]
    df = spark.createDataFrame(rows, "scan int, splat_id long, x double").repartition(5, "x")
    return rows, splats.with_boxes(df.withColumns({"y": F.col("x"), "z": F.lit(0.5), "radius": F.lit(0.25)}), None, 1.0, 1)


def test_f6_blobs_in_blocks(spark, monkeypatch):
    rows, boxed = splat_rows(spark)
    assert "_block" in plan(splats.blobs(boxed))
    monkeypatch.setattr(splats, "BLOCK_BITS", 3)
    got = splats.blobs(boxed).select("scan", "first", "last", "hi_x").collect()
    want = {s: by_hand([(i, int(x)) for t, i, x in rows if t == s]) for s in range(6)}
    assert {s: sorted(tuple(r)[1:] for r in got if r.scan == s) for s in range(6)} == want


def test_f4_codec_in_blocks(spark, monkeypatch):
    _, boxed = splat_rows(spark)
    whole = splats.blobs(boxed)
    words = sorted((r.scan, r.first, list(r.words)) for r in splats.encode_blobs(whole).collect())
    assert "_block" in plan(splats.encode_blobs(whole))
    monkeypatch.setattr(splats, "BLOCK_BITS", 3)
    coded = splats.encode_blobs(whole)
    assert sorted((r.scan, r.first, list(r.words)) for r in coded.collect()) == words and sum(len(w) == 1 for _, _, w in words) > len(words) // 2
    columns = sorted(whole.columns)
    assert sorted(map(tuple, splats.decode_blobs(coded).select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_f9_ranges_in_blocks(spark, monkeypatch):
    given = [(b, a, a + (a * 7 + b) % (9 if b else 40)) for b in range(2) for a in range(0, 400, 1 + 6 * b)] + [(2, 3, 90), (2, 4, 6), (2, 3, 5), (2, 91, 95), (2, 200, 201)]
    ranges = spark.createDataFrame(given, "bin int, first long, last long").repartition(3)
    ids = spark.range(450).select(F.col("id").alias("splat_id"), F.explode(F.array(*[F.lit(b) for b in range(3)])).alias("bin"))
    assert "_block" in plan(splats.in_ranges(ids, splats.merge_ranges(ranges, "bin"), "bin"))
    monkeypatch.setattr(splats, "BLOCK_BITS", 3)
    for gap in (0, 1):
        want = []
        for b, a, e in sorted(given):
            if want and want[-1][0] == b and a <= want[-1][2] + gap:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([b, a, e])
        merged = splats.merge_ranges(ranges, "bin", gap)
        assert sorted(map(list, merged.select("bin", "first", "last").collect())) == want
        inside = sorted((r.bin, r.splat_id) for r in splats.in_ranges(ids, merged, "bin").collect())
        assert inside == [(b, i) for b in range(3) for i in range(450) if any(c == b and a <= i < e for c, a, e in want)]


def test_f2_trace_in_blocks(spark, monkeypatch):
    """Blocks of 8 rows give what one pass gives: buffers over several blocks, larger than one, empty, and pages kept from block to block."""
    ship(spark)
    rng = random.Random(5)
    sizes = [rng.choice((0, 0, 0, 1, 2, 5, 30, 200)) if k < 120 else 0 if k < 150 else rng.randrange(9) for k in range(260)]
    made = [simulate.Access(rng.randrange(3), (k * 10, k * 10 + n), (k * 20, k * 20 + rng.choice((0, n)))) for k, n in enumerate(sizes)]
    trace = spark.createDataFrame([(k, a.chunk, *a.vertices, *a.triangles) for k, a in enumerate(made)], "i long, chunk long, v0 long, v1 long, t0 long, t1 long").repartition(3)
    monkeypatch.setattr(simulate, "BLOCK_BITS", 3)
    for capacity, page, slots in ((400, 64, 3), (2000, 700, 2), (60, 12, 8)):
        caches = simulate.replay(simulate.reorder(made, capacity), page, slots)
        got = {r.kind: tuple(r)[1:] for r in simulate.replay_trace(trace, capacity, page, slots).collect()}
        assert got == {n: (c.hits, c.misses, c.loaded) for n, c in zip(("vertices", "triangles"), caches, strict=True)}
    assert [tuple(r) for r in simulate.replay_trace(trace.limit(0), 60, 12, 8).collect()] == [("vertices", 0, 0, 0), ("triangles", 0, 0, 0)]


def test_f3_clouds_in_one_sort(spark, tmp_path):
    ship(spark)
    rows = spark.range(3000).select(F.col("id").alias("splat_id"), (F.col("id") % 3).cast("int").alias("scan"), *[F.col("id").cast("double").alias(c) for c in ply.PROPERTIES]).repartition(5)
    at = f"file://{tmp_path}"
    assert ply.write_clouds(rows, "scan", {s: f"{at}/c{s}.ply" for s in range(1, 5)}) == {1: 1000, 2: 1000, 3: 0, 4: 0}
    back = ply.read_splats(spark, f"{at}/c2.ply").orderBy("splat_id").collect()
    assert [r.x for r in back] == [float(i) for i in range(2, 3000, 3)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c1.ply", "c2.ply", "c3.ply", "c4.ply"]


def test_f7_timeline_of_many_files(spark, tmp_path, monkeypatch):
    """Values stay with their events, over files and pieces of files, and over blocks without an event."""
    events = spark.range(2000).select(F.col("id").alias("line"), F.concat(F.lit("w."), F.col("id")).alias("worker"), F.lit("go").alias("action"), F.lit(1.0).alias("start"), F.lit(2.0).alias("stop"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("value"))
    at = str(tmp_path / "a b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        telemetry.timeline_text(events.repartition(3)).write.text(at)
        lines = telemetry.numbered_lines(spark, at)
        assert lines.select(F.spark_partition_id()).distinct().count() > 8
        assert [r.value.split()[1] for r in lines.orderBy("line").collect() if r.value.startswith("EVENT")] == [f"w.{i}" for i in range(2000)]
        got = {r.worker: r.value for r in telemetry.parse_timeline(lines).collect()}
    finally:
        for k in ("adaptive.coalescePartitions.enabled", "files.maxPartitionBytes", "files.openCostInBytes"):
            spark.conf.unset(f"spark.sql.{k}")
    assert got == {f"w.{i}": i if i % 3 == 0 else None for i in range(2000)}
    monkeypatch.setattr(telemetry, "BLOCK_BITS", 2)
    text = ["VALUE 1", "EVENT a b 1 2", *[f"VALUE {k}" for k in range(20)], "EVENT c d 1 2", "junk"]
    t = telemetry.parse_timeline(spark.createDataFrame(list(enumerate(text)), "line long, value string"))
    assert sorted((r.worker, r.value) for r in t.collect()) == [("a", 19), ("c", None)]


def test_f11_chain_of_counted_nodes(spark):
    entries = spark.createDataFrame([(0, 0, 5), (1, 0, 5), (2, 1, 0), (3, 2, 0), (4, 0, 70), (5, 1, 8)], "splat_id long, level int, code long")
    leaves = entries.select(F.call_function("shiftleft", F.col("code"), F.col("level") * 3).alias("code")).distinct()
    want = sorted(map(tuple, octree.chain(leaves, entries, 3).groupBy("code").agg(F.count("*")).collect()))
    counted = entries.groupBy("level", "code").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, octree.chain(leaves, counted, 3).groupBy("code").agg(F.sum("n")).collect())) == want


def test_f5_hubs_are_broadcast(spark, monkeypatch):
    """Stars, chains and a hub in the middle of them, with every second node a hub."""
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 130)] + [(115, 200 + k) for k in range(30)] + [(39, 300), (301, 300), (400, 400), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    monkeypatch.setattr(components, "HUB", 2)
    least = df.select(F.col("a").alias("u"), F.col("b").alias("v")).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    assert "broadcast" in plan(components._with_least(df.select(F.col("a").alias("u"), F.col("b").alias("v")), least))
    got = sorted(map(tuple, components.connected_components(df, one_task=0).collect()))
    nodes, comp = components.union_find(*(np.array(x) for x in zip(*edges, strict=True)))
    assert got == sorted(zip(nodes.tolist(), comp.tolist(), strict=True))
