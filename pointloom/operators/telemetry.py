"""Run statistics and timelines: a mergeable registry, text forms, and the analyses of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointloom.functions.text import natural_order

#: Action order of a breakdown. Fixed values.
ORDER = ("startup", "compute", "receive", "send", "load", "write", "wait-in", "wait-out")
#: Timing statistics and the (worker, action) that they belong to: in every run, in runs of one process, and in runs of several. Fixed values.
COMMON = {
    "bucket.coarse.compute": ("main", "compute"), "bucket.compute": ("main", "compute"), "bucket.coarse.load": ("main", "load"), "bucket.coarse.write": ("main", "write"),
    "bucket.fine.compute": ("copy", "compute"), "bucket.fine.pop.first": ("copy", "startup"), "bucket.fine.pop": ("copy", "wait-in"), "bucket.fine.write": ("copy", "write"),
    "copy.compute": ("copy", "compute"), "copy.pop.first": ("copy", "startup"), "copy.pop": ("copy", "wait-in"), "copy.write": ("copy", "write"),
    "device.get": ("copy", "wait-out"), "device.push": ("copy", "wait-out"), "device.flush": ("copy", "wait-out"), "device.compute": ("device", "compute"),
    "device.pop.first": ("device", "startup"), "device.pop": ("device", "wait-in"), "mesher.compute": ("mesher", "compute"), "mesher.pop.first": ("mesher", "startup"),
    "mesher.pop": ("mesher", "wait-in"), "tmpwriter.get": ("mesher", "wait-out"), "tmpwriter.push": ("mesher", "wait-out"), "tmpwriter.compute": ("tmpwriter", "compute"),
    "tmpwriter.pop.first": ("tmpwriter", "startup"), "tmpwriter.pop": ("tmpwriter", "wait-in"),
}
SINGLE = {
    "bucket.loader.compute": ("main", "compute"), "bucket.loader.load": ("main", "load"), "bucket.loader.write": ("main", "write"), "bucket.fine.get": ("main", "wait-out"),
    "bucket.fine.push": ("main", "wait-out"), "copy.get": ("main", "wait-out"), "copy.push": ("main", "wait-out"), "mesher.get": ("device", "wait-out"), "mesher.push": ("device", "wait-out"),
}
SEVERAL = {
    "scatter.get": ("main", "wait-out"), "scatter.push": ("main", "wait-out"), "slave.pop.first": ("slave", "startup"), "slave.pop": ("slave", "wait-in"), "slave.recv": ("slave", "receive"),
    "bucket.loader.load": ("slave", "load"), "bucket.loader.write": ("slave", "write"), "bucket.loader.compute": ("slave", "compute"), "bucket.fine.get": ("slave", "wait-out"),
    "bucket.fine.push": ("slave", "wait-out"), "copy.get": ("slave", "wait-out"), "copy.push": ("slave", "wait-out"), "gather.get": ("device", "wait-out"), "gather.compute": ("gather", "compute"),
    "gather.pop.first": ("gather", "startup"), "gather.pop": ("gather", "wait-in"), "ReceiverGather.wait": ("receiver", "wait-in"), "ReceiverGather.recv": ("receiver", "receive"),
    "mesher.get": ("receiver", "wait-out"), "mesher.push": ("receiver", "wait-out"),
}

COUNTER, VARIABLE, PEAK = "counter", "variable", "peak"
#: Lines are looked back over in blocks of 2^17 numbers.
BLOCK_BITS = 17


def counters(samples: DataFrame) -> DataFrame:
    """``name``, ``total`` of increments (``name``, ``value``)."""
    return samples.groupBy("name").agg(F.sum("value").alias("total"))


def variables(samples: DataFrame) -> DataFrame:
    """``sum``, ``sum2``, ``n``, ``mean``, ``variance`` (of the sample; NULL for fewer than two) and ``stddev`` of each name. Sums merge; the rest follows from them."""
    sums = samples.groupBy("name").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum2"), F.count("value").alias("n"))
    return describe(sums)


def describe(sums: DataFrame) -> DataFrame:
    n = F.col("n")
    variance = F.when(n > 1, F.greatest((F.col("sum2") - F.col("sum") * F.col("sum") / n) / (n - 1), F.lit(0.0)))
    return sums.withColumn("mean", F.try_divide("sum", "n")).withColumn("variance", variance).withColumn("stddev", F.sqrt("variance"))


def peaks(changes: DataFrame) -> DataFrame:
    """``current`` and ``peak`` of gauges (``name``, ``at``, ``change``)."""
    level = F.sum("change").over(W.partitionBy("name").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return changes.withColumn("level", level).groupBy("name").agg(F.sum("change").alias("current"), F.greatest(F.max("level"), F.lit(0)).alias("peak"))


def merge(*registries: DataFrame) -> DataFrame:
    """One registry (``name``, ``kind``, ``total``, ``sum``, ``sum2``, ``n``, ``peak``) of several: counters and variables add up, of peaks the largest stays. A name of
    two kinds is an error."""
    both = registries[0]
    for more in registries[1:]:
        both = both.unionByName(more)
    out = both.groupBy("name").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"), *[F.sum(c).alias(c) for c in ("total", "sum", "sum2", "n")], F.max("peak").alias("peak"))
    kind = F.when(F.col("kind") == F.col("other"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("Statistic of two kinds: "), F.col("name"))).cast("string"))
    return out.withColumn("kind", kind).drop("other")


def statistics_text(registry: DataFrame) -> DataFrame:
    """Lines ``name: value``, in order of names."""
    d = describe(registry)
    value = F.when(F.col("kind") == COUNTER, F.col("total").cast("string")).when(F.col("kind") == PEAK, F.col("peak").cast("string"))
    value = value.otherwise(F.when(F.col("n") == 0, "[0]").otherwise(F.concat_ws(" ", F.col("sum").cast("string"), F.lit(":"), F.col("mean").cast("string"), F.lit("+/-"), F.coalesce(F.col("stddev").cast("string"), F.lit("nan")), F.format_string("[%d]", F.col("n")))))
    return d.orderBy("name").select(F.concat("name", F.lit(": "), value).alias("value"))


def parse_statistics(lines: DataFrame) -> DataFrame:
    """``name``, ``value`` (double) and ``count`` (in brackets, if any) of lines ``name: value``, and of ``--name=value`` in a line of options."""
    options = lines.where(F.col("value").rlike(r"^[a-z]+ options: ")).select(F.explode(F.regexp_extract_all("value", F.lit(r" --([-a-zA-Z0-9]+=\S+)"), F.lit(1))).alias("o"))
    options = options.select(F.substring_index("o", "=", 1).alias("name"), F.expr("try_cast(substring(o, instr(o, '=') + 1) as double)").alias("value"), F.lit(None).cast("long").alias("count"))
    pattern = r"^\s*([a-zA-Z0-9.() /:]+?)\s*: (\S+)"
    rows = lines.where(~F.col("value").rlike(r"^[a-z]+ options: ") & F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("v"), F.regexp_extract("value", r"\[(\d+)\]", 1).alias("c"))
    rows = rows.select("name", F.when(F.col("v") == "[0]", F.lit(0.0)).otherwise(F.expr("try_cast(v as double)")).alias("value"), F.expr("try_cast(c as bigint)").alias("count"))
    return options.unionByName(rows)


def thread_counts(parsed: DataFrame) -> DataFrame:
    """``total-...-threads`` taken from the sample counts of the statistics that each thread adds to once."""
    which = F.when(F.col("name") == "device.pop.first", "total-device-threads").when(F.col("name").isin("bucket.fine.pop.first", "copy.pop.first"), "total-bucket-threads").when(F.col("name") == "gather.pop.first", "total-slave-threads")
    return parsed.select(which.alias("name"), F.col("count").alias("value")).where(F.col("name").isNotNull() & F.col("value").isNotNull())


def names_table(spark: SparkSession, several: bool) -> DataFrame:
    found = COMMON | (SEVERAL if several else SINGLE)
    return spark.createDataFrame([(k, *v) for k, v in found.items()], "name string, worker string, action string")


def order_rank(action: Column) -> Column:
    """Place in ``ORDER``; others come last."""
    place = F.array_position(F.lit(list(ORDER)), action)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(ORDER)).cast("long"))


def breakdown(parsed: DataFrame, total: str = "pass1.time") -> DataFrame:
    """``worker``, ``action``, ``seconds`` and ``percent`` of the total, with what is left of the main worker's time as ``other``."""
    several = not parsed.where(F.col("name") == "gather.pop").isEmpty()
    known = parsed.join(F.broadcast(names_table(parsed.sparkSession, several)), "name")  # a fixed table
    sums = known.groupBy("worker", "action").agg(F.sum("value").alias("seconds"))
    main = parsed.where(F.col("name") == total).agg(F.max("value").alias("all"))
    all_of = sums.groupBy("worker").agg(F.sum("seconds").alias("busy")).crossJoin(main).select("worker", "busy", F.when(F.col("worker") == "main", F.coalesce("all", "busy")).otherwise(F.col("busy")).alias("all"))
    other = all_of.where(F.col("all") != F.col("busy")).select("worker", F.lit("other").alias("action"), (F.col("all") - F.col("busy")).alias("seconds"))
    out = sums.unionByName(other).join(all_of.select("worker", "all"), "worker")
    return out.select("worker", "action", "seconds", (F.lit(100.0) * F.try_divide("seconds", "all")).alias("percent"), order_rank(F.col("action")).alias("rank")).orderBy("worker", "rank", "action")


def unmatched_times(parsed: DataFrame, several: bool = False) -> DataFrame:
    """Timing statistics that no worker is known for."""
    timing = parsed.where(F.col("name").rlike(r"\.(get|push|pop|pop\.first|compute|load|write|recv|wait|flush)$"))
    return timing.join(F.broadcast(names_table(parsed.sparkSession, several)), "name", "left_anti").select("name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``value`` of text files; numbers order the lines, by the files' names, then by place. A line's number is twice the start of the piece of
    the file that it is read from, and its place among the lines of the task: pieces after the first of a task are the last of their files."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    files = lines.select("file").distinct().withColumn("_file", F.row_number().over(W.orderBy("file")).cast("long"))  # a row for each file
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = lines.select("value", "file", (F.col("_start") * 2 + at).alias("_at"))
    return rows.join(F.broadcast(files), "file").select((F.shiftleft("_file", 44) + F.col("_at")).alias("line"), "value")


def parse_timeline(lines: DataFrame) -> DataFrame:
    """``line``, ``worker``, ``action``, ``start``, ``stop``, ``value`` of ``EVENT`` lines; a ``VALUE`` line belongs to the event before it, the last one if there are several."""
    event, value = r"^EVENT (\S+) (\S+) ([0-9.]+) ([0-9.]+)$", r"^VALUE ([0-9]+)$"
    rows = lines.where(F.col("value").rlike(event) | F.col("value").rlike(value))
    is_event = F.col("value").rlike(event)
    rows = rows.withColumn("block", F.shiftright("line", BLOCK_BITS))
    blocks = rows.groupBy("block").agg(F.max(F.when(is_event, F.col("line"))).alias("line"))
    given = blocks.select("block", F.max("line").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("given"))  # a row for each block
    here = F.last(F.when(is_event, F.col("line")), ignorenulls=True).over(W.partitionBy("block").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("of", here).join(given, "block").withColumn("of", F.coalesce("of", "given")).drop("given")
    fields = [F.max(F.when(is_event, F.regexp_extract("value", event, i))).alias(n) for i, n in enumerate(("worker", "action", "start", "stop"), 1)]
    given = F.max_by(F.when(~is_event, F.regexp_extract("value", value, 1)), F.when(~is_event, F.col("line")))
    out = rows.where(F.col("of").isNotNull()).groupBy("of").agg(*fields, given.alias("given"))
    return out.select(F.col("of").alias("line"), "worker", "action", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), F.col("given").cast("long").alias("value"))


def timeline_text(events: DataFrame) -> DataFrame:
    """The lines of a timeline, in the order of tasks; an event's lines are in one task."""
    lines = F.array_compact(F.array(F.format_string("EVENT %s %s %.9f %.9f", "worker", "action", "start", "stop"), F.when(F.col("value").isNotNull(), F.format_string("VALUE %d", "value"))))
    return events.repartitionByRange("line").sortWithinPartitions("line").select(F.explode(lines).alias("value"))


def action_times(events: DataFrame) -> DataFrame:
    """``worker``, ``action``, ``seconds``."""
    return events.groupBy("worker", "action").agg(F.sum(F.col("stop") - F.col("start")).alias("seconds"))


def worker_times(events: DataFrame) -> DataFrame:
    """``start`` (idle before), ``idle`` (between) and ``tail`` (after) of each worker, in natural order of names."""
    last = events.agg(F.max("stop").alias("end"))
    each = events.groupBy("worker").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(F.col("stop") - F.col("start")).alias("active"))
    out = each.crossJoin(F.broadcast(last))  # one row
    return out.select("worker", "start", (F.col("stop") - F.col("start") - F.col("active")).alias("idle"), (F.col("end") - F.col("stop")).alias("tail")).orderBy(*natural_order(F.col("worker")))


def idle_gaps(events: DataFrame) -> DataFrame:
    """``gap`` before each event that begins after all earlier ones of its worker have stopped."""
    before = F.max("stop").over(W.partitionBy("worker").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("gap", F.col("start") - before).where(F.col("gap") > 0).select("worker", "start", "gap")


def parse_accesses(lines: DataFrame) -> DataFrame:
    """``line``, ``chunk``, ``kind``, ``first``, ``last`` of a page-access trace: ranges follow the ``CHUNK`` line above them, or chunk 0."""
    parts = F.split("value", " ")
    chunk = F.last(F.when(F.col("value").startswith("CHUNK "), parts[1].cast("int")), ignorenulls=True).over(W.orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("chunk", F.coalesce(chunk, F.lit(0))).where(F.col("value").rlike("^(VERTICES|TRIANGLES) "))
    return rows.select("line", "chunk", F.lower(parts[0]).alias("kind"), parts[1].cast("long").alias("first"), parts[2].cast("long").alias("last"))
