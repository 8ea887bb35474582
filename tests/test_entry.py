import __spark_entry__ as entry


def test_flagship_and_names(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    assert entry.entry(spark).columns == ["x", "y", "z", "n", "k0", "k1", "k2"] and entry.entry(spark).count() > 1000


def test_streams_agree_with_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from pointloom.operators import splats
    from pointloom.streaming import incremental

    made = spark.range(500).select(*[((F.col("id") * k) % 97).cast("double").alias(a) for a, k in (("x", 7), ("y", 11), ("z", 13))], F.lit(1.5).alias("radius"), *[F.lit(1.0).alias(c) for c in ("nx", "ny", "nz", "quality")])
    made.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for name, now, want in (("box", incremental.running_box(stream), splats.bounding_box(made)), ("bins", incremental.running_histogram(stream, 5.0, 2), incremental.running_histogram(made, 5.0, 2))):
        q = incremental.start(now, name, str(tmp_path / name))
        q.awaitTermination(60)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))
