"""Contiguous ranges of an integer key, cut by histograms of bytes: the same input gives the same ranges, on any number of executors.

A first histogram cuts the key's span into ``BINS`` bins. Bins that hold more than a range should are cut again, between the least and
the greatest key in them, until they are small enough; what one key (or null) alone holds beyond that is cut by a tie-break.
So neither keys far from all others nor a key of very many rows make a range large, as long as the key's rows have different ties.

Defined results: null keys come first; an empty table has one range; rows of equal key and tie are never parted.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1 << 14
#: Ties made here are from 0 to below this.
TIES = 1 << 30
#: Ranges grow beyond their target rather than be more than about this many: a histogram's rows are what reaches the driver.
MAX_RANGES = 1 << 15
LOWEST = -(1 << 63)


def _array(values: list[int], kind: str) -> Column:
    """A constant array; one string, not a call for each element."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _search(bounds: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """The place of the last of the ascending ``bounds`` that is not above (key, tie), by bisection."""
    keys, ties = (_array(list(x), "bigint") for x in zip(*bounds, strict=True))
    steps = [1 << i for i in reversed(range((len(bounds) - 1).bit_length()))] or [0]

    def step(at: Column, more: Column) -> Column:
        least = F.get(keys, at + more)
        return F.when((least < key) | ((least == key) & (F.get(ties, at + more) <= tie)), at + more).otherwise(at)

    return F.aggregate(_array(steps, "int"), F.lit(0), step)


def _parts(low: int, high: int, parts: int) -> list[int]:
    """Where the parts of low .. high begin, without the first."""
    width = -(-(high - low + 1) // parts)
    return list(range(low + width, high + 1, width))


def places(df: DataFrame, key: str, size: Column, target: int, tie: Column | None = None) -> tuple[Column, int]:
    """The range number of a row of ``df`` (or of a table with the same ``key`` and ``tie``), and the number of ranges of about ``target``
    of ``size``. Ranges follow the ``key`` (long), within a key the ``tie`` (long, not null)."""
    low, high, total = df.agg(F.min(key), F.max(key), F.sum(size)).first()
    if total is None:
        return F.lit(0), 1
    target = max(target, int(total) // MAX_RANGES)
    tie = F.lit(0).cast("long") if tie is None else tie
    # bounds of the cells of null keys (as key 0), then of the others
    nulls, others = [(0, LOWEST)], [] if low is None else [(k, LOWEST) for k in [low, *_parts(low, high, BINS)]]
    step = 1 if low is None else -(-(high - low + 1) // BINS)
    even = len(others)  # as long as no bin was cut again, a key's bin follows from its distance to the lowest
    sizes: dict[tuple[bool, tuple[int, int]], int | None] = {(False, x): None for x in nulls} | {(True, x): None for x in others}

    def placed(values: list[int] | None) -> Column:
        """A row's cell, or what ``values`` has for it."""
        cell = _search(nulls, F.lit(0).cast("long"), tie) if len(nulls) > 1 else F.lit(0)
        if others:
            wide = "decimal(20,0)"  # the distance may be beyond a long
            away, width = F.col(key).cast(wide) - F.lit(low).cast(wide), F.lit(step).cast(wide)
            bin_of = ((away - away % width) / width).cast("int")  # exact: a plain quotient of decimals is rounded
            if len(others) > even:
                bin_of = _search(others, F.col(key), tie)
            cell = F.when(F.col(key).isNull(), cell).otherwise(bin_of + len(nulls))
        return cell if values is None else F.get(_array(values, "int"), cell)

    while True:
        cells = [(False, x) for x in nulls] + [(True, x) for x in others]
        new = placed(None if all(x is None for x in sizes.values()) else [i if sizes[c] is None else -1 for i, c in enumerate(cells)])
        rows = df.select(new.alias("cell"), F.coalesce(F.col(key), F.lit(0)).alias("key"), tie.alias("tie"), size.alias("size")).where("cell >= 0")
        found = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("tie").alias("t0"), F.max("tie").alias("t1")).collect()
        sizes = {c: n or 0 for c, n in sizes.items()}
        more = 0
        for r in found:
            known, bound = cells[r.cell]
            sizes[known, bound] = int(r["size"])
            if r["size"] > target and (r.k0, r.t0) != (r.k1, r.t1):
                parts = 1 << (4 * int(r["size"]) // target).bit_length()
                if r.k0 < r.k1:
                    cuts = [(k, LOWEST) for k in _parts(r.k0, r.k1, parts)]
                else:
                    cuts = [(r.k0, t) for t in _parts(r.t0, r.t1, parts)]
                (others if known else nulls).extend(cuts)
                sizes |= {(known, x): None for x in [bound, *cuts]}
                more += len(cuts)
        nulls.sort()
        others.sort()
        if not more:
            break

    numbers, now, held = [], 0, 0
    for c in [(False, x) for x in nulls] + [(True, x) for x in others]:
        if held and held + sizes[c] > target:
            now, held = now + 1, 0
        held += sizes[c]
        numbers.append(now)
    return placed(numbers), now + 1


def files(manifest: DataFrame, group: str, amount: str | None = None) -> DataFrame:
    """The files of a manifest, a partition for each: ``path`` and ``start``, the sum of ``amount`` over all files before it.
    Only a row for each range reaches the driver."""
    value = F.lit(0).cast("long") if amount is None else F.col(amount)
    sums = manifest.groupBy(group).agg(F.sum(value).alias("amount"), F.count("*").alias("files")).orderBy(group).collect()
    before = accumulate(((r.amount, r.files) for r in sums), lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0))
    known = manifest.sparkSession.createDataFrame([(r[0], *b) for r, b in zip(sums, before, strict=False)], f"{group} int, __sum long, __files long")
    own = Window.partitionBy(group).orderBy("roll")
    listed = manifest.select(group, "roll", "path", value.alias("__amount")).join(F.broadcast(known), group).select(  # at most a row for each range
        (F.col("__files") + F.row_number().over(own) - 1).cast("int").alias("n"),
        "path",
        (F.col("__sum") + F.sum("__amount").over(own) - F.col("__amount")).alias("start"),
    )
    return listed.repartitionById(max(1, sum(r.files for r in sums)), F.col("n"))
