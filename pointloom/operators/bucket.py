"""Adaptive spatial bucketing: a histogram of microblocks at every octree level, the highest nodes that fit, and the splats of each.

Everything is relational: a splat's box is expanded to the distinct nodes it touches at each level, counted by one aggregation; a node is
chosen if it fits and no ancestor does; and a microblock finds its chosen node by walking up its (at most 21) ancestors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointloom.functions.grid import Grid, div_up, mul_sat, round_up
from pointloom.operators.splats import AXES, clamp_boxes, with_boxes
from pointloom.shared import keep


class DensityError(ValueError):
    """Too many splats over one cell."""

    def __init__(self, splats: int):
        super().__init__(f"Too many splats ({splats}) cover one cell")
        self.splats = splats


def choose_micro_size(dims: tuple[int, int, int], max_split: int, splats: int, max_splats: int, max_cells: int) -> int:
    """Microblock edge for which there are few enough blocks, doubled on while a flat sheet of splats would still be split well."""
    target = 0.5 * min(dims) * math.sqrt(max_splats / max(1, splats))
    micro = 1
    while True:
        blocks = reduce(mul_sat, (div_up(d, micro) for d in dims))
        if not (blocks > max_split or (blocks > 8 and micro < target * 0.5 and micro * 2 <= max_cells)):
            return micro
        micro *= 2


def round_chunk(chunk_cells: int, max_dim: int, max_cells: int, micro: int) -> int:
    """Chunk edge in cells: a multiple of the microblock, and of as many as fit where a chunk is larger than a bin may be."""
    size = min(max_dim, chunk_cells) if chunk_cells else max_dim
    if size > max_cells:
        return round_up(size, max_cells // micro * micro or micro)
    return round_up(size, micro)


def chunk_cells_of(split_bytes: int, bytes_per_cell: int = 760) -> int:
    """Chunk edge for a file size, if the surface crosses a chunk as a sheet."""
    return math.ceil(math.sqrt(split_bytes / bytes_per_cell))


def touched(boxed: DataFrame, level: int | Column = 0) -> DataFrame:
    """A row for each node (``bx``, ``by``, ``bz``) that a box touches at a level: once for each, however many microblocks it has there."""
    up = lambda c: F.shiftright(F.col(c), level) if isinstance(level, int) else F.call_function("shiftright", F.col(c), level)
    out = boxed
    for a in AXES:
        out = out.withColumn(f"b{a}", F.explode(F.sequence(up(f"lo_{a}"), up(f"hi_{a}"))))
    return out


def level_counts(boxed: DataFrame, levels: int, chunk: int | None = None) -> DataFrame:
    """``level``, ``bx``, ``by``, ``bz``, ``n``: splats over each node of each level; with ``chunk`` (microblocks on an edge) also ``cx``, ``cy``, ``cz``, and nodes are counted from their chunk's corner."""
    names = ["bx", "by", "bz"]
    split = boxed if chunk is None else by_chunk(boxed, chunk)
    keys = ([] if chunk is None else ["cx", "cy", "cz"]) + ["level", *names]
    return touched(split.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))), F.col("level")).groupBy(*keys).agg(F.count("*").alias("n"))


def by_chunk(boxed: DataFrame, chunk: int) -> DataFrame:
    """Each box cut at chunk borders, counted from the chunk's corner."""
    out = boxed
    for a in AXES:
        first, last = (F.floor(F.col(f"{n}_{a}") / F.lit(chunk)) for n in ("lo", "hi"))
        out = out.withColumn(f"c{a}", F.explode(F.sequence(first, last)))
    base = {a: F.col(f"c{a}") * F.lit(chunk) for a in AXES}
    return out.withColumns({f"lo_{a}": F.greatest(F.col(f"lo_{a}") - base[a], F.lit(0).cast("long")) for a in AXES} | {f"hi_{a}": F.least(F.col(f"hi_{a}") - base[a], F.lit(chunk - 1).cast("long")) for a in AXES})


def pick_nodes(counts: DataFrame, levels: int, max_splats: int, max_cells: int, micro: int) -> DataFrame:
    """The cut: nodes that fit (or are microblocks), none of whose ancestors does."""
    keys = [c for c in ("cx", "cy", "cz") if c in counts.columns]
    fits = (F.col("level") == 0) | ((F.shiftleft(F.lit(micro).cast("long"), 0) * F.pow(F.lit(2.0), F.col("level")) <= max_cells) & (F.col("n") <= max_splats))
    good = counts.where(fits)
    ups = F.sequence(F.lit(1), F.lit(levels - 1) - F.col("level"))
    above = F.transform(F.when(F.col("level") < levels - 1, ups).otherwise(F.expr("cast(array() as array<int>)")), lambda u: u)
    asked = good.select(*keys, "level", "bx", "by", "bz", F.explode(above).alias("u"))
    asked = asked.select(*keys, F.col("level"), "bx", "by", "bz", (F.col("level") + F.col("u")).alias("al"), *[F.call_function("shiftright", F.col(b), F.col("u")).alias(f"a{b}") for b in ("bx", "by", "bz")])
    parents = good.select(*[F.col(k).alias(f"p{k}") for k in keys], F.col("level").alias("pl"), *[F.col(b).alias(f"p{b}") for b in ("bx", "by", "bz")])
    match = (F.col("al") == F.col("pl")) & (F.col("abx") == F.col("pbx")) & (F.col("aby") == F.col("pby")) & (F.col("abz") == F.col("pbz"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"p{k}"))
    covered = asked.join(parents, match, "left_semi").select(*keys, "level", "bx", "by", "bz").distinct()
    return good.join(covered, [*keys, "level", "bx", "by", "bz"], "left_anti")


@dataclass(frozen=True)
class Buckets:
    """``bins``: ``bin_id``, ``gen`` and ``cx`` .. ``cz`` of the chunk, cell extents ``lo_x`` .. ``hi_z`` and ``n``; ``members``: ``bin_id``, ``splat_id``."""

    bins: DataFrame
    members: DataFrame
    micro: int
    chunk_cells: int


def bucket(splats: DataFrame, grid: Grid, *, max_splats: int, max_cells: int, chunk_cells: int = 0, micro_cells: int = 0, max_split: int = 1 << 30) -> Buckets:
    """Bins of at most ``max_splats`` splats and ``max_cells`` cells on an edge that cover all splats. Cells denser than that, microblocks halved
    as far as one cell, raise ``DensityError``."""
    dims = tuple(grid.num_cells(i) for i in range(3))
    total, top = splats.count(), max(dims)
    if total <= max_splats and top <= max_cells and (chunk_cells == 0 or chunk_cells >= top):
        whole = splats.sparkSession.range(1).select(F.lit(0).cast("long").alias("bin_id"), F.lit(0).alias("gen"), *[F.lit(0).cast("long").alias(f"c{a}") for a in AXES], *[F.lit(v).cast("long").alias(f"{n}_{a}") for i, a in enumerate(AXES) for n, v in (("lo", 0), ("hi", dims[i]))], F.lit(total).cast("long").alias("n"))
        inside = clamp_boxes(with_boxes(splats, grid), dims)
        return Buckets(whole, inside.select(F.lit(0).cast("long").alias("bin_id"), "splat_id"), top, top)
    micro = micro_cells if 0 < micro_cells <= top else choose_micro_size(dims, max_split, total, max_splats, max_cells)
    while reduce(mul_sat, (div_up(d, micro) for d in dims)) > max_split:
        micro *= 2
    while True:
        size = round_chunk(chunk_cells, top, max_cells, micro)
        per_chunk = size // micro
        levels = 1 + max(0, math.ceil(math.log2(per_chunk)))
        boxed = clamp_boxes(with_boxes(splats, grid, bucket=micro), tuple(div_up(d, micro) for d in dims)).select("splat_id", *[f"{n}_{a}" for n in ("lo", "hi") for a in AXES])
        nodes = keep(pick_nodes(keep(level_counts(boxed, levels, per_chunk), "node-counts"), levels, max_splats, max_cells, micro), "nodes")
        worst = nodes.agg(F.max("n")).first()[0]
        if worst is None or worst <= max_splats:
            break
        if micro == 1:
            raise DensityError(worst)
        micro = max(1, micro // 2)  # only microblocks can be over the budget: make them smaller
    order = W.orderBy("cx", "cy", "cz", "level", "bx", "by", "bz")  # a row for each bin, not for each splat
    numbered = nodes.withColumn("bin_id", (F.row_number().over(order) - 1).cast("long")).withColumn("gen", F.dense_rank().over(W.orderBy("cx", "cy", "cz")) - 1)
    numbered = keep(numbered, "bins")
    edge = F.pow(F.lit(2.0), F.col("level")).cast("long") * F.lit(micro)
    corner = {a: F.col(f"c{a}") * F.lit(size) + F.col(f"b{a}") * edge for a in AXES}
    ends = {a: F.least(corner[a] + edge, (F.col(f"c{a}") + 1) * F.lit(size), F.lit(dims[i]).cast("long")) for i, a in enumerate(AXES)}
    bins = numbered.select("bin_id", "gen", "cx", "cy", "cz", *[corner[a].alias(f"lo_{a}") for a in AXES], *[ends[a].alias(f"hi_{a}") for a in AXES], "n")
    parts = touched(by_chunk(boxed, per_chunk).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))), F.col("level"))
    members = parts.join(numbered.select("bin_id", "cx", "cy", "cz", "level", "bx", "by", "bz"), ["cx", "cy", "cz", "level", "bx", "by", "bz"]).select("bin_id", "splat_id")
    return Buckets(bins, members, micro, size)


def batches(bins: DataFrame, max_splats: int) -> DataFrame:
    """Bins in batches, greedily in order: one is closed when the next bin would take it over ``max_splats``. It runs over the rows of bins, in
    one ordered pass, as each batch begins where the one before ended."""

    def greedy(pdfs):
        total, number = 0, 0
        for pdf in pdfs:
            out = []
            for n in pdf["n"]:
                if total and total + n > max_splats:
                    total, number = 0, number + 1
                total += n
                out.append(number)
            yield pdf.assign(batch=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bins.schema) + ", batch long"
    return bins.coalesce(1).sortWithinPartitions("bin_id").mapInPandas(greedy, schema)


def chunk_generations(bins: DataFrame) -> DataFrame:
    """``gen`` counted up wherever the chunk changes from the bin before."""
    order = W.orderBy("bin_id")
    change = F.lag("cx").over(order).isNull() | (F.lag("cx").over(order) != F.col("cx")) | (F.lag("cy").over(order) != F.col("cy")) | (F.lag("cz").over(order) != F.col("cz"))
    return bins.withColumn("change", change.cast("int")).withColumn("gen", (F.sum("change").over(order) - 1).cast("int")).drop("change")
