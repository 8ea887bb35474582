"""Benchmark decontamination: a hash set of test n-grams against the word windows of every document.

The hash set is a bit set: each window's two hashes (of its first and last word, and of all its words) set two bits each, and there are
``BITS`` bits a window, up to ``MOST`` in all (16 MB), however large the benchmark; a larger one lets more windows through to the
verification. The bits are a constant of the plan, so they reach every executor once. Each document is scanned in its own
row, in one pass; the windows whose bits are all set leave it with their words and are verified by a join with the benchmark's windows, words
against words. That table is broadcast where its size is checked to allow it (``SMALL`` windows), else both sides are shuffled by
the window. Only built-in functions are used.

Defined results:
- null or empty text, or text without a word: no words, no hits, not contaminated, kept as it is;
- repeated rows and equal ids: each row is judged by itself;
- a benchmark item without words has no window; items repeated under one id count once; an item
  with a null id makes hits but is not listed;
- an empty benchmark or an empty document table gives no hits;
- further columns of the documents are returned by ``clean`` and never mixed with ours, which all
  start with two underscores while at work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import staging

#: Words, after A-Z are lower-cased: fixed by the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window.
WINDOW = 10
#: Bits of the set for each window, and the most of them.
BITS, MOST = 64, 1 << 27
#: Windows up to this number are broadcast, about 100 bytes each.
SMALL = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``len``, ``gram``, ``item``, ``key`` (hash of all words) and ``ends`` (hash of the first and the last) of each distinct window."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    at = items.select("item", "len", "w", F.explode(F.expr("sequence(0, size(w) - len)")).alias("i"))
    return at.select(
        "len",
        F.expr("array_join(slice(w, i + 1, len), ' ')").alias("gram"),
        "item",
        F.expr("xxhash64(slice(w, i + 1, len))").alias("key"),
        F.expr("xxhash64(w[i], w[i + len - 1])").alias("ends"),
    ).distinct()


@dataclass(frozen=True)
class HashSet:
    """The benchmark's windows: their table, the lengths that occur, and the bits."""

    windows: DataFrame
    lengths: tuple[int, ...]
    bits: np.ndarray
    small: bool


def _spread(h: str) -> tuple[str, str]:
    """SQL for a hash's 64-bit number in the set (before the mask) and for its two bits there."""
    return f"shiftrightunsigned({h}, 12)", f"(shiftleft(1L, cast({h} & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned({h}, 6) & 63 as int)))"


def hash_set(windows: DataFrame) -> HashSet:
    """What reaches the driver are the numbers of the bit set that are not 0, at most ``MOST`` / 64."""
    windows = staging.keep(windows, "benchmark-windows")
    found = windows.select("len", "key", "ends").distinct()
    n = found.count()
    size = 1
    while size * 64 < min(MOST, BITS * n):
        size *= 2
    bits = np.zeros(size, np.int64)
    for h in ("key", "ends"):
        place, mask = _spread(h)
        got = found.select(F.expr(f"{place} & {size - 1}L").alias("place"), F.expr(mask).alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
        bits[got["place"].to_numpy()] |= got["mask"].to_numpy()
    lengths = tuple(sorted(r[0] for r in found.select("len").distinct().collect()))  # at most as many as a window has words
    return HashSet(windows, lengths, bits, windows.count() <= SMALL)


def _hits(known: HashSet) -> Column:
    """Array of (pos, len, gram) of the windows of ``__w`` whose bits are all set: the pair of first and last word is looked up before all the words."""
    mask = len(known.bits) - 1
    # a constant: Spark folds it into one array
    bits = F.split(F.lit(",".join(map(str, known.bits.tolist()))), ",").cast("array<bigint>")

    def has(h: Column) -> Column:
        place = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(mask).cast("long")).cast("int")
        one = F.lit(1).cast("long")
        low, high = h.bitwiseAND(F.lit(63).cast("long")).cast("int"), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(63).cast("long")).cast("int")
        both = F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))
        return F.get(bits, place).bitwiseAND(both) == both

    parts = []
    for n in known.lengths:
        places = F.when(F.size("__w") >= n, F.sequence(F.lit(0), F.size("__w") - n)).otherwise(F.expr("cast(array() as array<int>)"))
        first = F.filter(places, lambda i: has(F.xxhash64(F.get("__w", i), F.get("__w", i + (n - 1)))))  # noqa: B023
        whole = F.filter(first, lambda i: has(F.xxhash64(F.slice("__w", i + 1, n))))  # noqa: B023
        parts.append(F.transform(whole, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice("__w", i + 1, n), " ").alias("gram"))))  # noqa: B023
    return F.concat(*parts) if parts else F.expr("cast(array() as array<struct<pos:int,len:int,gram:string>>)")


def _verified(rows: DataFrame, known: HashSet) -> DataFrame:
    """``rows`` have a hit ``h`` (or null): ``item`` of each benchmark item that has its words, and ``__true`` where one has. Spark combines before it shuffles."""
    grams = known.windows.select(F.col("len").alias("__len"), F.col("gram").alias("__gram"), "item", F.lit(True).alias("__true"))
    grams = F.broadcast(grams) if known.small else grams
    return rows.join(grams, (F.col("h.len") == F.col("__len")) & (F.col("h.gram") == F.col("__gram")), "left")


def _places(hits: str) -> Column:
    """The distinct word positions inside the hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each row of ``documents``: ``__id``, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``spans`` ((pos, len), in words).

    Only hits leave their row: the one shuffle carries a row for each document and one for each hit."""
    known = hash_set(benchmark_windows(benchmark, item_col, item_text_col, window))
    base = documents.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), words(F.col(text_col)).alias("__w"))
    found = base.select("__row", "__id", F.size("__w").alias("n_words"), F.explode_outer(_hits(known)).alias("h"))
    per_row = _verified(found, known).groupBy("__row", "__id", "n_words").agg(
        F.collect_set(F.col("item").cast("string")).alias("items"),
        F.collect_set(F.when(F.col("__true"), F.struct(F.col("h.pos").alias("pos"), F.col("h.len").alias("len")))).alias("spans"),
    )
    return per_row.select("__id", F.col("n_words").cast("long").alias("n_words"), F.size(_places("spans")).cast("long").alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("spans").alias("spans"))


def clean(documents: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_hit_share: float = 0.0) -> DataFrame:
    """``documents`` without contamination, with the columns they had. The scan is written once; only documents with hits are shuffled.

    ``remove="documents"`` drops each document of which more than ``max_hit_share`` of the words are hit;
    ``remove="spans"`` keeps all and cuts the hit words, with the separators before them, from the text."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    columns = documents.columns
    known = hash_set(benchmark_windows(benchmark, item_col, item_text_col, window))
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"), words(F.col(text_col)).alias("__w"))
    scanned = staging.keep(boxed.select("__doc", F.size("__w").alias("__n"), _hits(known).alias("__hits"), F.monotonically_increasing_id().alias("__row")), "decontamination-scan")
    without = scanned.where(F.size("__hits") == 0).select("__doc")
    suspect = scanned.where(F.size("__hits") > 0)
    hits = _verified(suspect.select("__row", F.explode("__hits").alias("h")), known).where("__true")
    spans = hits.groupBy("__row").agg(F.collect_set(F.struct(F.col("h.pos").alias("pos"), F.col("h.len").alias("len"))).alias("__spans")).select("__row", _places("__spans").alias("__places"))
    judged = suspect.join(spans, "__row", "left").withColumn("__places", F.coalesce("__places", F.expr("cast(array() as array<int>)")))
    if remove == "documents":
        kept = judged.where(F.size("__places") <= F.lit(max_hit_share) * F.col("__n")).select("__doc")
        return without.unionByName(kept).select(*[F.col(f"__doc.`{c}`").alias(c) for c in columns])
    given = F.coalesce(F.col(f"__doc.`{text_col}`"), F.lit(""))
    parts = judged.withColumn("__raw", F.regexp_extract_all(given, F.lit(f"({RAW_WORD})"), F.lit(0))).withColumn("__gaps", F.split(given, RAW_WORD))
    cut = F.expr("concat(array_join(transform(__raw, (x, i) -> if(array_contains(__places, i), '', concat(__gaps[i], x))), ''), element_at(__gaps, -1))")
    text = F.when(F.size("__places") > 0, cut).otherwise(F.col(f"__doc.`{text_col}`"))
    changed = parts.select(*[text.alias(c) if c == text_col else F.col(f"__doc.`{c}`").alias(c) for c in columns])
    return without.select(*[F.col(f"__doc.`{c}`").alias(c) for c in columns]).unionByName(changed)


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_decontamination``: the contract's digest for every document."""
    judged = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select(
        F.col("__id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM grams),
doc_grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, lens WHERE len(w) >= n)),
hits AS (SELECT d.r, d.i, d.n, g.item_id FROM doc_grams d JOIN grams g ON d.n = g.n AND d.gram = g.gram),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN places p ON l.r = p.r LEFT JOIN listed i ON l.r = i.r
"""
