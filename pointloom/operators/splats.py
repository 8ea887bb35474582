"""Splats (oriented points with a radius): ids, projections, the finite filter, bounding grids, buckets, blobs and id ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pointloom.functions.grid import Grid, defined, div_down
from pointloom.shared import keep

FIELDS = ("x", "y", "z", "radius", "nx", "ny", "nz", "quality")
SCHEMA = T.StructType([T.StructField(n, T.FloatType()) for n in FIELDS])
FILE_SHIFT = 40
AXES = ("x", "y", "z")
#: Windows run over blocks of 2^17 consecutive ids; what crosses a border is put together from a few rows for each block.
BLOCK_BITS = 17


def splat_id(file_id: Column, row: Column) -> Column:
    """File number from bit 40 on, row within the file below."""
    return F.shiftleft(file_id.cast("long"), FILE_SHIFT).bitwiseOR(row.cast("long"))


def numbered(df: DataFrame, part: list[str], order: list[str], name: str = "row") -> DataFrame:
    """Each row's place, from 0, by ``order`` among those of its ``part``. Ranges of the order are sorted by tasks of their own, however
    few parts there are; a row for each task and part then gives where its rows begin."""
    laid = df.repartitionByRange(*part, *order).sortWithinPartitions(*part, *order).withColumn("_at", F.monotonically_increasing_id())
    laid = keep(laid, "numbered").withColumn("_task", F.shiftright("_at", 33))
    runs = laid.groupBy("_task", *part).agg(F.min("_at").alias("_base"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*part).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in part], (before - F.col("_base")).alias("_shift"))
    same = F.col("_task") == F.col("_of")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return laid.join(F.broadcast(starts), same).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)  # a row for each task and part


def project(df: DataFrame, smooth: float = 4.0, max_radius: float = math.inf) -> DataFrame:
    """The radius clamped, then scaled; quality from the result. NaN is dealt with first, as Spark takes it for the largest number."""
    r = F.col("radius").cast("double")
    clamped = r if math.isinf(max_radius) else F.when(~F.isnan(r), F.least(r, F.lit(max_radius))).otherwise(r)
    return df.withColumn("radius", clamped * F.lit(smooth)).withColumn("quality", F.try_divide(F.lit(1.0), F.col("radius") * F.col("radius")))


def finite(df: DataFrame) -> DataFrame:
    """Rows of which all eight fields are finite."""
    return df.where(defined(*[F.col(c) for c in FIELDS]))


def nonfinite_count(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(defined(*[F.col(c) for c in FIELDS]), 0).otherwise(1)), F.lit(0)).cast("long").alias("nonfinite"))


def bounding_box(df: DataFrame) -> DataFrame:
    """Of the splats' spheres; one row, combined in each task before it moves."""
    r = F.col("radius").cast("double")
    return df.agg(*[F.min(F.col(a).cast("double") - r).alias(f"min_{a}") for a in AXES], *[F.max(F.col(a).cast("double") + r).alias(f"max_{a}") for a in AXES])


def bounding_grid(df: DataFrame, spacing: float, bucket: int = 1) -> Grid:
    """The grid, at the origin, that covers the bounding box; its lower extents are multiples of ``bucket``."""
    box = bounding_box(df).first()
    if box["min_x"] is None:
        raise ValueError("At least one input point is required")
    lows = [math.floor(math.floor(box[f"min_{a}"] / spacing) / bucket) * bucket for a in AXES]
    highs = [math.ceil(box[f"max_{a}"] / spacing) for a in AXES]
    return Grid((0.0, 0.0, 0.0), spacing, tuple(zip(lows, highs, strict=True)))


def to_grid(df: DataFrame, grid: Grid) -> DataFrame:
    """Positions and radius in units of cells from the grid's lower corner."""
    return df.withColumns({a: grid.world_to_vertex(F.col(a), i) for i, a in enumerate(AXES)} | {"radius": grid.scale(F.col("radius"))})


def bucket_box(grid: Grid | None, spacing: float, bucket: int) -> dict[str, Column]:
    """The inclusive box of buckets that a splat's sphere touches: ``lo_x`` .. ``hi_z``; from the grid's lower corner, or from the origin."""
    out: dict[str, Column] = {}
    r = F.col("radius").cast("double")
    for i, a in enumerate(AXES):
        for name, p in (("lo", F.col(a).cast("double") - r), ("hi", F.col(a).cast("double") + r)):
            cell = F.floor(p / F.lit(spacing)) if grid is None else F.floor((p - F.lit(grid.reference[i])) / F.lit(grid.spacing)) - F.lit(grid.extents[i][0])
            out[f"{name}_{a}"] = div_down(cell, bucket)
    return out


def with_boxes(df: DataFrame, grid: Grid | None = None, spacing: float = 1.0, bucket: int = 1) -> DataFrame:
    return df.withColumns(bucket_box(grid, spacing, bucket))


def clamp_boxes(df: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Boxes clipped to [0, dims); those outside go."""
    out = df.withColumns({f"lo_{a}": F.greatest(F.col(f"lo_{a}"), F.lit(0).cast("long")) for a in AXES} | {f"hi_{a}": F.least(F.col(f"hi_{a}"), F.lit(d - 1).cast("long")) for a, d in zip(AXES, dims, strict=True)})
    return out.where((F.col("lo_x") <= F.col("hi_x")) & (F.col("lo_y") <= F.col("hi_y")) & (F.col("lo_z") <= F.col("hi_z")))


def _block(id: Column) -> Column:
    return F.shiftright(id, BLOCK_BITS)


def _with_next(df: DataFrame, id: Column, following: Column) -> DataFrame:
    """``_block`` of each row, and once more the rows after which an id of another block can follow."""
    return df.withColumn("_block", F.explode(F.when(_block(following) != _block(id), F.array(_block(id), _block(following))).otherwise(F.array(_block(id)))))


def blobs(boxed: DataFrame, part: str = "scan") -> DataFrame:
    """Runs of consecutive ids with the same box: ``first``, ``last`` (exclusive) and the box. ``part`` splits the ids (a file, a range of
    ids); a run never crosses it. Runs are found in blocks of ids, each with the row before it; those that reach a block's end are joined."""
    box = [f"{n}_{a}" for n in ("lo", "hi") for a in AXES]
    i = F.col("splat_id")
    order = W.partitionBy(part, "_block").orderBy("splat_id")
    new = F.lit(False)
    for c in box:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    new = new | (F.lag("splat_id").over(order) != i - 1) | F.lag("splat_id").over(order).isNull()
    rows = _with_next(boxed.select(part, "splat_id", *box), i, i + 1).withColumn("_new", new).where(_block(i).eqNullSafe(F.col("_block")))
    runs = rows.withColumn("run", F.sum(F.col("_new").cast("int")).over(order))
    found = runs.groupBy(part, "_block", "run", *box).agg(F.min("splat_id").alias("first"), (F.max("splat_id") + 1).alias("last"), F.max("_new").alias("_new"))
    cut = ~F.col("_new") | (F.col("last").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0)
    found = keep(found.withColumn("_cut", F.coalesce(cut, F.lit(False))), "runs")
    pieces = found.where("_cut").withColumn("run", F.sum(F.col("_new").cast("int")).over(W.partitionBy(part).orderBy("first")))  # at most two for each block
    whole = pieces.groupBy(part, "run", *box).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.where("not _cut").select(part, *box, "first", "last").unionByName(whole.select(part, *box, "first", "last"))


def encode_blobs(found: DataFrame, part: str = "scan") -> DataFrame:
    """Each blob as words: one, of differences, where the run starts at the end of the one before, its box is at most one wider and moves by -4 .. 3 buckets
    from it, and its length fits; else ten (first and last in two words each, then the box). Blobs don't overlap; only one that ends where another
    begins matters to it, so that one is also in the other's block."""
    order = W.partitionBy(part, "_block").orderBy("first")
    size = F.col("last") - F.col("first")
    word, fits = size, (size > 0) & (size < 1 << 19) & (F.lag("last").over(order) == F.col("first"))
    for i, a in enumerate(AXES):
        move, wide = F.col(f"lo_{a}") - F.lag(f"hi_{a}").over(order), F.col(f"hi_{a}") - F.col(f"lo_{a}")
        fits = fits & move.between(-4, 3) & wide.between(0, 1)
        word = word.bitwiseOR(F.shiftleft(wide, 19 + 4 * i)).bitwiseOR(F.shiftleft(move.bitwiseAND(F.lit(7)), 20 + 4 * i))
    low = F.lit((1 << 32) - 1)
    full = F.array(*[w for c in ("first", "last") for w in (F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(low))], *[F.col(f"{n}_{a}") for a in AXES for n in ("lo", "hi")])
    words = F.when(F.coalesce(fits, F.lit(False)), F.array(word.bitwiseOR(F.lit(1 << 31)))).otherwise(full)
    rows = _with_next(found, F.col("first"), F.col("last")).withColumn("words", words)
    return rows.where(_block(F.col("first")).eqNullSafe(F.col("_block"))).select(part, "first", "words")


def decode_blobs(encoded: DataFrame, part: str = "scan") -> DataFrame:
    """The blobs again: differences are summed since the last full record, which may be some blocks before; a row for each block hands the sums on."""
    order = W.partitionBy(part, "_block").orderBy("first")
    short = F.size("words") == 1
    rows = encoded.withColumn("_block", _block(F.col("first"))).withColumn("base", F.sum(F.when(short, 0).otherwise(1)).over(order))
    since = W.partitionBy(part, "_block", "base").orderBy("first")
    word = F.col("words")[0]
    full = lambda i: F.try_element_at("words", F.lit(i + 1))
    size = F.when(short, word.bitwiseAND(F.lit((1 << 19) - 1))).otherwise(F.shiftleft(full(2), 32).bitwiseOR(full(3)) - F.shiftleft(full(0), 32).bitwiseOR(full(1)))
    columns = [(F.col("first") + size).alias("last")]
    for i, a in enumerate(AXES):
        wide = F.when(short, F.shiftright(word, 19 + 4 * i).bitwiseAND(F.lit(1))).otherwise(full(5 + 2 * i) - full(4 + 2 * i))
        move = F.shiftright(word, 20 + 4 * i).bitwiseAND(F.lit(7))
        step = F.when(short, F.when(move >= 4, move - 8).otherwise(move))
        columns += [wide.alias(f"wide_{a}"), F.sum(F.when(short, step + wide).otherwise(full(5 + 2 * i))).over(since).alias(f"hi_{a}")]
    rows = keep(rows.select(part, "_block", "first", (F.col("base") > 0).alias("_based"), *columns), "decoded")
    his = [f"hi_{a}" for a in AXES]
    ends = rows.groupBy(part, "_block").agg(F.max("_based").alias("_based"), *[F.max_by(c, "first").alias(c) for c in his])
    ends = ends.withColumn("base", F.sum(F.col("_based").cast("int")).over(W.partitionBy(part).orderBy("_block")))
    ends = ends.select(part, "_block", *[F.sum(c).over(W.partitionBy(part, "base").orderBy("_block")).alias(c) for c in his])
    given = ends.select(F.col(part).alias("_part"), F.col("_block").alias("_of"), *[F.lag(c).over(W.partitionBy(part).orderBy("_block")).alias(f"_{c}") for c in his])
    open_ = rows.where("not _based").join(given, F.col(part).eqNullSafe(F.col("_part")) & F.col("_block").eqNullSafe(F.col("_of")))
    rows = rows.where("_based").unionByName(open_.withColumns({c: F.col(c) + F.col(f"_{c}") for c in his}).select(*rows.columns))
    return rows.select(part, "first", "last", *[x for a in AXES for x in ((F.col(f"hi_{a}") - F.col(f"wide_{a}")).alias(f"lo_{a}"), f"hi_{a}")])


def _before(blocks: DataFrame, by: str, value: Column) -> DataFrame:
    """``_by``, ``_of`` (a block) and ``_given``: the value from all blocks of the ``by`` before it; over a row for each block."""
    order = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(F.col(by).alias("_by"), F.col("_block").alias("_of"), value.over(order).alias("_given"))


def merge_ranges(ranges: DataFrame, by: str, gap: int = 0) -> DataFrame:
    """Union of half-open id ranges of each ``by``: those that overlap, touch, or lie at most ``gap`` apart are one. Of equal starts the longest range
    counts; unions are found in blocks of starts, and those at a block's ends are joined."""
    rows = keep(ranges.groupBy(by, "first").agg(F.max("last").alias("last")).withColumn("_block", _block(F.col("first"))), "ranges")
    given = _before(rows.groupBy(by, "_block").agg(F.max("last").alias("last")), by, F.max("last"))
    order = W.partitionBy(by, "_block").orderBy("first")
    rows = rows.withColumn("_reach", F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("_end", F.lead("_block").over(order).isNull())
    rows = rows.join(given, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_of")))
    reach = F.greatest("_reach", "_given")
    rows = rows.withColumn("_new", reach.isNull() | (F.col("first") > reach + gap)).withColumn("run", F.sum(F.col("_new").cast("int")).over(order))
    found = keep(rows.groupBy(by, "_block", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("_new").alias("_new"), F.max("_end").alias("_end")), "runs")
    cut = ~F.col("_new") | F.col("_end")
    pieces = found.where(cut).withColumn("run", F.sum(F.col("_new").cast("int")).over(W.partitionBy(by).orderBy("first")))  # at most two for each block
    whole = pieces.groupBy(by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.where(~cut).select(by, "first", "last").unionByName(whole.select(by, "first", "last"))


def in_ranges(df: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """Rows whose id lies in a range of their ``by``: ids and starts are laid in one order, and each id looks back to the last start, in its block or in
    one before (ranges must be merged)."""
    rows = df.select(by, F.col("splat_id").alias("at"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("kind"), F.struct("*").alias("row"))
    starts = ranges.select(by, F.col("first").alias("at"), "last", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = rows.unionByName(starts).withColumn("_block", _block(F.col("at")))
    given = _before(both.groupBy(by, "_block").agg(F.max_by("last", F.when(F.col("kind") == 0, F.col("at"))).alias("last")), by, F.last("last", ignorenulls=True))
    order = W.partitionBy(by, "_block").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    until = both.withColumn("_until", F.last("last", ignorenulls=True).over(order)).where(F.col("kind") == 1)
    until = until.join(given, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_of")))
    return until.where(F.col("at") < F.coalesce("_until", "_given")).select("row.*")


def partition_rows(total: int, rank: int, size: int) -> tuple[int, int]:
    """Rows [total * rank / size, total * (rank + 1) / size)."""
    return total * rank // size, total * (rank + 1) // size
