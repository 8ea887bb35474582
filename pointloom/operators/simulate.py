"""Simulations: a page cache over access ranges, a reorder buffer, and the processing pipeline as queues of workers.

``reorder``, ``replay`` and ``pipeline`` take a small trace or timeline on the driver. ``replay_trace`` gives what the first two give for a trace of any
length: blocks of it are worked on by tasks, and what one block hands to the next (what the buffer holds, the pages in use) is put together on the driver.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointloom.operators.splats import numbered
from pointloom.shared import keep

#: Rows of a trace that a task works on at once: 2^17.
BLOCK_BITS = 17


@dataclass
class PageCache:
    """Least-recently-used pages over half-open address ranges."""

    page: int
    slots: int
    hits: int = 0
    misses: int = 0
    pages: OrderedDict = field(default_factory=OrderedDict)

    def access(self, first: int, last: int) -> None:
        for k in range(first // self.page, -(-last // self.page)):
            if k in self.pages:
                self.hits += 1
                self.pages.move_to_end(k)
                continue
            self.misses += 1
            if len(self.pages) == self.slots:
                self.pages.popitem(last=False)
            self.pages[k] = True

    @property
    def loaded(self) -> int:
        return self.misses * self.page


@dataclass(frozen=True)
class Access:
    chunk: int
    vertices: tuple[int, int]
    triangles: tuple[int, int]

    @property
    def size(self) -> int:
        return 12 * (self.vertices[1] - self.vertices[0] + self.triangles[1] - self.triangles[0])


def reorder(accesses: Iterable[Access], capacity: int) -> list[Access]:
    """Accesses gathered up to ``capacity`` bytes, then written out by chunk and first vertex, with ranges laid one after the other."""
    out: list[Access] = []
    held: list[Access] = []
    size = at_v = at_t = 0

    def flush() -> None:
        nonlocal size, at_v, at_t
        for a in sorted(held, key=lambda a: (a.chunk, a.vertices[0])):
            nv, nt = a.vertices[1] - a.vertices[0], a.triangles[1] - a.triangles[0]
            out.append(Access(a.chunk, (at_v, at_v + nv), (at_t, at_t + nt)))
            at_v, at_t = at_v + nv, at_t + nt
        held.clear()
        size = 0

    for a in accesses:
        if held and size + a.size > capacity:
            flush()
        held.append(a)
        size += a.size
    flush()
    return out


def replay(accesses: Iterable[Access], page: int, slots: int, vertex_bytes: int = 12, triangle_bytes: int = 12) -> tuple[PageCache, PageCache]:
    """Caches of vertices and triangles after all accesses, chunk by chunk."""
    caches = PageCache(page, slots), PageCache(page, slots)
    for a in sorted(accesses, key=lambda a: a.chunk):
        caches[0].access(a.vertices[0] * vertex_bytes, a.vertices[1] * vertex_bytes)
        caches[1].access(a.triangles[0] * triangle_bytes, a.triangles[1] * triangle_bytes)
    return caches


def _fills(sizes: np.ndarray, capacity: int, opened: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of ``sizes``; for each row where the next buffer begins if one begins there (the number of rows: in none of these); and the rows at
    which the first can begin, whatever the buffer held before (``opened``: at row 0)."""
    sums = np.cumsum(sizes)
    begin = np.maximum(np.searchsorted(sums, sums - sizes + capacity, side="right"), np.arange(len(sizes)) + 1)
    first = np.zeros(1, int) if opened else np.flatnonzero(((sizes > 0) | (np.arange(len(sizes)) == 0)) & (sums - sizes <= capacity))
    return sums, begin, first


def replay_trace(trace: DataFrame, capacity: int, page: int, slots: int, vertex_bytes: int = 12, triangle_bytes: int = 12) -> DataFrame:
    """``kind``, ``hits``, ``misses``, ``loaded`` of ``replay(reorder(trace, capacity), page, slots)``. ``trace``: ``i`` (0, 1, 2 ..), ``chunk``, ``v0``, ``v1``, ``t0``, ``t1``.

    A buffer's rows depend on where it began, so each block gives, for each row at which its first buffer can begin, where its last one does; a cache
    holds the latest ``slots`` pages, so each block gives its own latest ones."""
    spark, bits = trace.sparkSession, BLOCK_BITS
    size = 12 * (F.col("v1") - F.col("v0") + F.col("t1") - F.col("t0"))
    rows = keep(trace.select("i", "chunk", "v0", (F.col("v1") - F.col("v0")).alias("nv"), (F.col("t1") - F.col("t0")).alias("nt"), size.alias("size")).withColumn("block", F.shiftright("i", bits)), "trace")

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, sizes = table["i"].to_numpy(), table["size"].to_numpy()
        sums, begin, first = _fills(sizes, capacity, i[0] == 0)
        at, of = first, np.arange(len(first))  # the buffer that each case is in: cases meet soon
        while (begin[at] < len(sizes)).any():
            at, same = np.unique(np.where(begin[at] < len(sizes), begin[at], at), return_inverse=True)
            of = same[of]
        last = at[of]
        made = {"block": [table["block"][0].as_py()], "sum": [int(sums[-1])], "nv": [int(table["nv"].to_numpy().sum())], "nt": [int(table["nt"].to_numpy().sum())]}
        lists = {"until": sums[first], "start": i[last], "held": sums[-1] - (sums - sizes)[last]}
        return pa.table(made | {k: pa.array([v.tolist()], pa.list_(pa.int64())) for k, v in lists.items()})

    found = rows.groupBy("block").applyInArrow(ends, "block long, sum long, nv long, nt long, until array<long>, start array<long>, held array<long>").orderBy("block")
    entry: dict[int, tuple[int, int, int, int]] = {}
    start = held = at_v = at_t = 0
    for b in found.toLocalIterator():  # a row for each block
        entry[b.block] = (start, held, at_v, at_t)
        k = 0 if b.block == 0 else next((k for k, u in enumerate(b.until) if held + u > capacity), None)
        start, held = (start, held + b.sum) if k is None else (b.start[k], b.held[k])
        at_v, at_t = at_v + b.nv, at_t + b.nt

    def filled(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, sizes, nv, nt = (table[c].to_numpy() for c in ("i", "size", "nv", "nt"))
        start, held, at_v, at_t = entry[table["block"][0].as_py()]
        sums, begin, first = _fills(sizes, capacity, i[0] == 0)
        k = 0 if i[0] == 0 else next((int(k) for k in first if held + sums[k] > capacity), len(i))
        batch = np.zeros(len(i), np.int64)
        batch[:k] = start
        while k < len(i):
            batch[k : begin[k]] = i[k]
            k = int(begin[k])
        return pa.table({"i": i, "batch": batch, "chunk": table["chunk"], "v0": table["v0"], "nv": nv, "nt": nt, "bv": at_v + np.cumsum(nv) - nv, "bt": at_t + np.cumsum(nt) - nt})

    batched = rows.groupBy("block").applyInArrow(filled, "i long, batch long, chunk long, v0 long, nv long, nt long, bv long, bt long")
    inside = W.partitionBy("batch").orderBy("chunk", "v0", "i")
    ends_of = lambda n, base: F.min(base).over(W.partitionBy("batch")) + F.sum(n).over(inside.rowsBetween(W.unboundedPreceding, 0))
    laid = batched.withColumn("v", ends_of("nv", "bv")).withColumn("t", ends_of("nt", "bt"))
    laid = laid.withColumn("all", F.lit(0)).select("all", "chunk", "batch", "v0", "i", (F.col("v") - F.col("nv")).alias("va"), F.col("v").alias("vb"), (F.col("t") - F.col("nt")).alias("ta"), F.col("t").alias("tb"))
    order = numbered(laid, ["all"], ["chunk", "batch", "v0", "i"], "at").select("at", *[(F.col(c) * by).alias(c) for c, by in (("va", vertex_bytes), ("vb", vertex_bytes), ("ta", triangle_bytes), ("tb", triangle_bytes))])
    order = keep(order.withColumn("block", F.shiftright("at", bits)), "order")
    kinds = (("va", "vb"), ("ta", "tb"))

    def latest(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        out = []
        for a, b in kinds:
            pages: dict[int, bool] = {}
            for first, last in zip(reversed(table[a].to_pylist()), reversed(table[b].to_pylist()), strict=True):
                for k in range(-(-last // page) - 1, first // page - 1, -1):
                    pages[k] = True
                    if len(pages) == slots:
                        break
                if len(pages) == slots:
                    break
            out.append(list(pages)[::-1])
        return pa.table({"block": [table["block"][0].as_py()], "v": pa.array([out[0]], pa.list_(pa.int64())), "t": pa.array([out[1]], pa.list_(pa.int64()))})

    before: dict[int, list[list[int]]] = {}
    state: list[list[int]] = [[], []]
    for b in order.groupBy("block").applyInArrow(latest, "block long, v array<long>, t array<long>").orderBy("block").toLocalIterator():  # a row for each block
        before[b.block] = state
        state = [([k for k in old if k not in new] + new)[-slots:] for old, new in zip(state, (list(b.v), list(b.t)), strict=True)]

    def played(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        out = []
        for (a, b), pages, kind in zip(kinds, before[table["block"][0].as_py()], ("vertices", "triangles"), strict=True):
            cache = PageCache(page, slots, pages=OrderedDict.fromkeys(pages, True))
            for first, last in zip(table[a].to_pylist(), table[b].to_pylist(), strict=True):
                cache.access(first, last)
            out.append((kind, cache.hits, cache.misses, cache.loaded))
        return pa.table(dict(zip(("kind", "hits", "misses", "loaded"), map(list, zip(*out, strict=True)), strict=True)))

    found = order.groupBy("block").applyInArrow(played, "kind string, hits long, misses long, loaded long").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "loaded")])
    kinds_of = spark.createDataFrame([("vertices",), ("triangles",)], "kind string")
    return kinds_of.join(F.broadcast(found), "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "misses", "loaded")])  # two rows


@dataclass(frozen=True)
class Stage:
    """Workers that take items from the queue before them; ``capacity`` bounds the sum of item sizes waiting in that queue."""

    name: str
    workers: int
    capacity: float


def pipeline(stages: list[Stage], items: list[tuple[list[float], float]]) -> dict[str, dict[str, float]]:
    """Replay items - (time in each stage, size) - through stages with bounded queues: for each stage its busy time, its wait for input and for room, and the end.

    Events happen in order of time; an item larger than a queue enters it when the queue is empty."""
    queues = [deque() for _ in stages]
    room = [s.capacity for s in stages]
    idle = [s.workers for s in stages]
    blocked: list[deque] = [deque() for _ in stages]  # finished items of the stage before, waiting for room here
    stats: dict[str, dict[str, float]] = defaultdict(lambda: {"busy": 0.0, "blocked": 0.0, "end": 0.0})
    events: list[tuple[float, int, int, int]] = []
    number = 0
    source = deque(range(len(items)))

    def fits(k: int, size: float) -> bool:
        return size <= room[k] or not queues[k]

    def start(now: float) -> None:
        nonlocal number
        moved = True
        while moved:
            moved = False
            while source and fits(0, items[source[0]][1]):
                i = source.popleft()
                room[0] -= items[i][1]
                queues[0].append(i)
                moved = True
            for k in range(len(stages)):
                while blocked[k] and fits(k, items[blocked[k][0][0]][1]):
                    i, since = blocked[k].popleft()
                    room[k] -= items[i][1]
                    queues[k].append(i)
                    idle[k - 1] += 1
                    stats[stages[k - 1].name]["blocked"] += now - since
                    moved = True
                while idle[k] and queues[k]:
                    i = queues[k].popleft()
                    room[k] += items[i][1]
                    idle[k] -= 1
                    number += 1
                    stats[stages[k].name]["busy"] += items[i][0][k]
                    heapq.heappush(events, (now + items[i][0][k], number, k, i))
                    moved = True

    start(0.0)
    now = 0.0
    while events:
        now, _, k, i = heapq.heappop(events)
        stats[stages[k].name]["end"] = now
        if k + 1 < len(stages):
            blocked[k + 1].append((i, now))
        else:
            idle[k] += 1
        start(now)
    for s in stages:
        stats[s.name]["waiting"] = s.workers * now - stats[s.name]["busy"] - stats[s.name]["blocked"]
    return {s.name: stats[s.name] | {"total": now} for s in stages}
