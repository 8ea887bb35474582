"""Near-duplicate detection with DartMinHash signatures and banded joining.

A document is the set of its five-word shingles (lower-cased words of ASCII letters and digits and all else that is not ASCII; a
text of one to four words has one shingle), each of weight one however often it occurs, so that signatures agree as often as
the similarity that defines a link says. Darts are thrown by hashes: the weight axis of an element is cut into regions of height
one, and in each region darts arrive, in order of rank, as a Poisson process of rate one whose arrivals and heights are
hashes of (shingle, region, arrival). A dart hits the document if its height is within the weight. All darts of ranks up to a bound
are enumerated at once - the bound is set so that about ``THROWS`` hit, whatever the number of elements - each is hashed to
one of ``COORDS`` coordinates, and the earliest dart of each coordinate is kept; the bound is doubled where a coordinate stays empty.
Two documents agree in a coordinate with the probability of their sets' Jaccard similarity.

Documents that agree in all ``ROWS`` coordinates of one of ``BANDS`` bands share a bucket (at similarity 0.8 that is missed with
probability 7e-5). A pair is a link if the exact Jaccard similarity of its shingle sets is ``THRESHOLD`` or more; classes are the
connected components of the links, and their id is the smallest document id. A bucket's pairs are never all made:

- equal texts are one document from the start;
- in each bucket, all are compared with one leader, and the components of the links are formed;
- where a bucket's documents are then in several components, each document's shingles that no other such document has are
  counted (aggregations only, no pair is made). They bound what it can share with any other: a document whose bound no link
  could have is done, however large its bucket. That closes the usual large group of texts around one template;
- of what is left, more leaders are taken from outside each bucket's largest component, a few at first and more each
  round, until every pair of different components has been compared. A comparison costs exact bounds first (sizes, shareable
  shingles, and maps: every element is one of ``64 x MAP`` bits of its document's map, and each bit that only one of two
  documents has stands for at least one element that the other has not) and is verified by the sets themselves.

Defined results:
- texts without words (null and empty ones too) have no shingles, are near nothing, and are classes of their own;
- rows with equal ids are one document: one class, of which one row stays; rows with null ids are never linked, have a null class and stay;
- the copies of a text, however many, are joined by a hash of the text, never paired; very long texts are sketched whole;
- shingles count once, however often a text repeats them;
- an empty table gives an empty result; further columns are returned by ``deduplicate`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointloom.llm import flat
from pointloom.operators.components import connected_components
from pointloom.shared import keep, shelf

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
COORDS = BANDS * ROWS
THROWS = COORDS * (np.log(COORDS) + 2.5)
#: Numbers of 64 bits in a document's map of elements.
MAP = 16
#: Documents of a bucket that meet its leaders in one task.
SLICE = 256
#: Ids up to this number are broadcast (8 MB); more are joined by a shuffle.
SMALL = 1_000_000
U64 = np.uint64


def _salt(k: int) -> np.uint64:
    return U64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))


def distinct(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle), sorted by row."""
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], shingle[new]


def dart_minhash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, coords: int = COORDS, throws: float = THROWS) -> np.ndarray:
    """Signatures (rows x coords) of weighted sets given as parallel arrays; rows without elements get zeros."""
    best = np.zeros((rows, coords), U64)
    total = np.bincount(row, weights=weight, minlength=rows)
    todo = total > 0
    while todo.any():
        bound = np.where(todo, throws / np.maximum(total, 1e-300), 0.0)
        mine = todo[row]
        regions = np.ceil(weight[mine]).astype(np.int64)
        element = np.repeat(np.flatnonzero(mine), regions)
        region = np.arange(len(element)) - np.repeat(np.cumsum(regions) - regions, regions)
        with np.errstate(over="ignore"):
            state = flat.mix(shingle[element] + region.astype(U64) * _salt(1))
        rank, limit = np.zeros(len(element)), bound[row[element]]
        of, dart, rank_of = [], [], []
        while len(element):
            with np.errstate(over="ignore"):
                state = flat.mix(state + _salt(2))
            rank = rank - np.log(flat.unit(state))
            live = rank < limit
            element, region, state, rank, limit = element[live], region[live], state[live], rank[live], limit[live]
            hit = region + flat.unit(flat.mix(state ^ _salt(3))) < weight[element]
            of.append(row[element[hit]])
            dart.append(flat.mix(state[hit] ^ _salt(4)))
            rank_of.append(rank[hit])
        of, dart, rank_of = np.concatenate(of), np.concatenate(dart), np.concatenate(rank_of)
        cell = of * coords + (dart % U64(coords)).astype(np.int64)
        order = np.lexsort((rank_of, cell))
        cell, dart = cell[order], dart[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        full = np.zeros(rows, np.int64) + np.bincount(cell[first] // coords, minlength=rows)
        done = todo & (full == coords)
        use = first[done[cell[first] // coords]]
        best.reshape(-1)[cell[use]] = dart[use]
        todo &= ~done
        throws *= 2
    return best


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each row."""
    out = np.zeros((len(signature), signature.shape[1] // ROWS), U64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = flat.mix(out * _salt(5) + signature[:, j::ROWS] + _salt(j + 6))
    return out


def maps_of(row: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """The map (rows x MAP) of each row's elements: a bit for each element, the same in every document."""
    out = np.zeros((rows, MAP), U64)
    bit = flat.mix(shingle ^ _salt(50)) % U64(64 * MAP)
    np.bitwise_or.at(out, (row, (bit // U64(64)).astype(np.int64)), U64(1) << bit % U64(64))
    return out


def _enough(shared: Column, na: Column, nb: Column) -> Column:
    """Whether sets of these sizes that share so many elements are a link."""
    return shared >= F.lit(THRESHOLD) * (na + nb - shared)


def _may_be(most: Column, na: Column, nb: Column) -> Column:
    """Whether sets of these sizes that share at most so many elements could be a link."""
    return most * F.lit(1 + THRESHOLD) >= F.lit(THRESHOLD) * (na + nb) - F.lit(1e-6)


def _words() -> list[str]:
    return [f"m{k}" for k in range(MAP)]


def _mapped(map_col: str = "map", n_col: str = "n") -> list[Column]:
    """The map's numbers as columns, and ``slack``: the elements less the map's bits."""
    words = [F.col(map_col)[k] for k in range(MAP)]
    bits = F.lit(0)
    for x in words:
        bits = bits + F.bit_count(x)
    return [*[x.alias(name) for x, name in zip(words, _words(), strict=True)], (F.col(n_col) - bits).alias("slack")]


def _most_shared(prefix: str) -> Column:
    """At most so many elements are shared with the set whose columns have the prefix: a bit that one map lacks stands for an element the other set has alone."""
    both = F.lit(0)
    for m in _words():
        both = both + F.bit_count(F.col(m).bitwiseAND(F.col(prefix + m)))
    return F.least("slack", f"{prefix}slack") + both


def text_keys(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's word sequence."""
    counts = np.diff(before)
    place = np.arange(len(hashes)) - np.repeat(before[:-1], counts)
    keys = []
    with np.errstate(over="ignore"):
        for k in (40, 41):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(flat.mix(hashes ^ flat.mix(place.astype(U64) * _salt(1) + _salt(k))))])
            keys.append(sums[before[1:]] - sums[before[:-1]])
    return keys[0], keys[1]


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = flat.Words(flat.ALNUM)
    for batch in batches:
        for first, data, offsets in flat.pieces(batch.column(1)):
            _, _, hashes, before = finder.find(data, offsets)
            rows = len(before) - 1
            row, shingle = distinct(*flat.shingles(hashes, before, WIDTH))
            k1, k2 = text_keys(hashes, before)
            at = np.arange(rows + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(before)), pa.array(np.bincount(row, minlength=rows)),
                    _lists(bands_of(dart_minhash(row, shingle, np.ones(len(row)), rows)), at * BANDS), _lists(maps_of(row, shingle, rows), at * MAP), _lists(shingle, np.searchsorted(row, at)),
                ],
                names=["id", "k1", "k2", "n_words", "n", "bands", "map", "set"],
            )
    flat.tidy()


SKETCH = "id long, k1 long, k2 long, n_words long, n long, bands array<bigint>, map array<bigint>, set array<bigint>"


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast where the number of ids allows it."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by the exact similarity of their shingle sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(_enough(F.col("shared"), F.col("nx"), F.col("ny"))).select("a", "b")


def _pairs(df: DataFrame, a: str, b: str, na: str, nb: str) -> DataFrame:
    """Distinct pairs of similar size: sets of sizes under THRESHOLD apart cannot be links."""
    close = F.least(na, nb) >= F.lit(THRESHOLD) * F.greatest(na, nb)
    return df.where(close & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _shareable(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``node``, ``alone``: how many of its shingles no other of ``nodes`` has, where there are any. Counts are combined before they are shuffled."""
    each = sets.join(nodes, "node", "left_semi").select("node", F.explode("set").alias("shingle"))
    once = each.groupBy("shingle").agg(F.count("*").alias("times"), F.max("node").alias("node")).where(F.col("times") == 1)
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def _open(wide: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of the buckets whose documents are in several components, each with its component, the bucket's largest one, its smallest set's size and the slices it is dealt in."""
    placed = wide.join(label.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = placed.groupBy("band", "h", "comp").agg(F.count("*").alias("size"), F.min("n").alias("low"))
    whole = parts.groupBy("band", "h").agg(F.max(F.struct("size", F.negative("comp").alias("c"))).alias("top"), F.min("low").alias("low"), F.count("*").alias("parts"), F.ceil(F.sum("size") / SLICE).alias("slices"))
    return placed.join(whole.where(F.col("parts") > 1).select("band", "h", "low", "slices", F.negative(F.col("top.c")).alias("main")), ["band", "h"])


def _rounds(multi: DataFrame, links: DataFrame, tested: DataFrame, sets: DataFrame, sketches: DataFrame, put) -> DataFrame:
    """``node``, ``comp`` of all linked documents, after all that share a bucket and could be linked have been compared."""
    label = put(connected_components(links, put=put), "near-labels")
    wide = multi.where(F.col("m") > 2).select("band", "h", "node", "n")
    nodes = put(_open(wide, label).select("node").distinct(), "near-open")
    if nodes.isEmpty():
        return label
    nodes = _few(nodes)
    alone = _shareable(nodes, sets)
    bounds = sketches.join(nodes, "node", "left_semi").select("node", "n", "map").join(alone, "node", "left").withColumn("can", F.col("n") - F.coalesce("alone", F.lit(0)))
    # a partner has at least THRESHOLD times as many shingles
    bounds = put(bounds.where(F.col("can") >= F.lit(THRESHOLD) * F.col("n")).select("node", "can", *_mapped()), "near-bounds")
    wide = put(wide.join(_few(bounds.select("node", "can")), "node"), "near-wide")
    used, at_once, tasks = None, 4, int(multi.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        open_ = _open(wide, label).where(_may_be(F.col("can"), F.col("n"), F.greatest("low", F.lit(THRESHOLD) * F.col("n"))))
        open_ = put(open_.join(bounds.drop("can"), "node"), "near-open")
        order = F.row_number().over(W.partitionBy("band", "h").orderBy("node"))
        outside = open_.where(F.col("comp") != F.col("main"))
        outside = outside if used is None else outside.join(used, ["band", "h", "node"], "left_anti")
        leaders = put(outside.withColumn("k", order).where(F.col("k") <= at_once).select("band", "h", "slices", *[F.col(c).alias(f"leader_{c}") for c in ("node", "n", "comp", "can", "slack", *_words())]), "near-leaders")
        if leaders.isEmpty():
            return label
        full = not leaders.groupBy("band", "h").count().where(F.col("count") >= at_once).isEmpty()
        # a large bucket is met slice by slice, each in a task of its own
        sliced = leaders.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
        dealt = open_.withColumn("slice", F.pmod(F.xxhash64("node"), "slices")).repartition(tasks, "band", "h", "slice")
        may = (F.col("comp") != F.col("leader_comp")) & _may_be(F.least("can", "leader_can"), F.col("n"), F.col("leader_n")) & _may_be(_most_shared("leader_"), F.col("n"), F.col("leader_n"))
        more = _pairs(dealt.join(sliced, ["band", "h", "slice"]).where(may), "leader_node", "node", "leader_n", "n")
        more = put(more.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        new = put(_verify(more, sets), "near-links")
        if not new.isEmpty():
            links = links.unionByName(new)
            label = put(connected_components(links, put=put), "near-labels")
        if not full:  # all that lay outside their bucket's largest component have met all others
            return label
        tested = tested.unionByName(more)
        mine = leaders.select("band", "h", F.col("leader_node").alias("node"))
        used = put(mine if used is None else used.unionByName(mine), "near-used")
        at_once *= 4


def classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``documents``: ``id``, ``class_id``, ``n_words``, ``n_copies`` (rows with the same words)."""
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with shelf(documents.sparkSession) as put:
        sketches = put(texts.mapInArrow(_sketch, SKETCH).withColumn("node", F.monotonically_increasing_id()), "near-sketches")
        worded = sketches.where((F.col("n_words") > 0) & F.col("id").isNotNull())
        # equal texts have equal bands, so the first will do; a text's node is that of one of its rows
        reps = worded.groupBy("k1", "k2").agg(F.min(F.struct("id", "node")).alias("least"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        reps = put(reps.select("k1", "k2", "least.id", "least.node", "n_copies", "n", "bands"), "near-reps")

        rows = reps.select("node", "n", F.posexplode("bands").alias("band", "h"))
        buckets = rows.groupBy("band", "h").agg(F.min(F.struct("node", "n")).alias("leader"), F.count("*").alias("m")).where(F.col("m") > 1)
        multi = rows.join(buckets, ["band", "h"]).select("band", "h", "node", "n", "m", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"))
        multi = put(multi, "near-buckets")
        sets = put(sketches.select("node", "set").join(_few(put(multi.select("node").distinct(), "near-nodes")), "node", "left_semi"), "near-sets")
        tested = put(_pairs(multi, "leader", "node", "leader_n", "n"), "near-pairs")
        found = _verify(tested, sets)
        # rows that share an id are one document
        several = put(worded.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where(F.col("x") != F.col("y")).select("id"), "near-several")
        if not several.isEmpty():
            own = worded.join(several, "id", "left_semi").select(F.col("id").alias("of"), "k1", "k2").join(reps.select("k1", "k2", "node"), ["k1", "k2"])
            found = found.unionByName(own.select("of", F.col("node").alias("a")).join(own.groupBy("of").agg(F.min("node").alias("b")), "of").select("a", "b").distinct())
        links = put(found, "near-links")
        label = _rounds(multi, links, tested, sets, sketches, put)

        placed = reps.join(label, "node", "left").select("k1", "k2", "id", "n_copies", F.coalesce("comp", "node").alias("comp"))
        least = placed.groupBy("comp").agg(F.min("id").alias("class_id"))
        named = placed.join(least, "comp").select("k1", "k2", "n_copies", "class_id")
        alone = (F.col("n_words") == 0) | F.col("id").isNull()
        found = sketches.select("id", "k1", "k2", "n_words").join(named, ["k1", "k2"], "left").select(
            "id",
            F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            "n_words",
            F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n_copies")).alias("n_copies"),
        )
        return keep(found, "near-classes")


def deduplicate(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with one row of each class, that of the smallest id, and the columns they had."""
    found = classes(documents, id_col=id_col, text_col=text_col).where(F.col("id").isNotNull())
    gone = found.where(F.col("id") != F.col("class_id")).select(F.col("id").alias("__gone")).distinct()
    kept = documents.join(_few(keep(gone, "near-gone")), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    again = keep(found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("id").alias("__again")), "near-again")
    if again.isEmpty():
        return kept
    repeated = F.col(id_col).cast("long") == F.col("__again")
    return kept.join(_few(again), repeated, "left_anti").unionByName(kept.join(_few(again), repeated, "left_semi").dropDuplicates([id_col]))


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_near_duplicates``: the class of every document."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_words", "n_copies", (F.col("id") == F.col("class_id")).alias("kept"))
