"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1-, 2- and 3-grams of lower-cased characters (runs of other characters
than letters count as one space) of a sample of labelled documents, at most ``fit_per_lang`` of each
language, drawn by a hash of the row. The smoothed log-probability matrix (languages x
``buckets``, at most ``MAX_LANGS`` x 2^15 32-bit numbers) is broadcast; whole texts are scored in batches as
sparse rows: the matrix rows of a text's n-grams are gathered and summed.

Defined results:
- null text or text without a letter: ``und`` with score 0;
- ties between languages go to the one that sorts first;
- rows with null text or language teach nothing; without any labelled row all is ``und``;
- repeated rows and ids are each predicted alike; further columns are ignored by ``predict`` and kept by ``keep_known``;
- an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import flat

BUCKETS, ORDERS, MAX_LANGS, UNKNOWN = 1 << 15, (1, 2, 3), 1000, "und"
FIT_PER_LANG = 5000
#: Matrix entries gathered at once.
GATHERED = 1 << 21


@lru_cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            table[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return table


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letter or space, row) of each character of all rows."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    return _letters()[codes], np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(leads[offsets]))


def _grams(low: np.ndarray, row: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of each n-gram, for each order; runs of spaces count as one."""
    space = low == 32
    stay = np.ones(len(low), bool)
    stay[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    low, row = low[stay].astype(np.uint64), row[stay]
    mark = np.uint64(buckets - 1)
    with np.errstate(over="ignore"):
        code = np.zeros(len(low), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = max(0, len(low) - n + 1)
            code = code[:m] * np.uint64(0x9E3779B97F4A7C15) + low[n - 1 :][:m] + np.uint64(1)
            if n in ORDERS:
                same = row[:m] == row[n - 1 :][:m]
                yield ((code[same] ^ (code[same] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40) & mark).astype(np.int64), row[:m][same]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  #: buckets x languages, log-probabilities
    prior: np.ndarray


def _drawn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sizes: dict[str, int], fit_per_lang: int) -> DataFrame:
    """At most ``fit_per_lang`` rows of each language (``lang``, ``text``): those whose hash of the id and the row's place is least, so null and repeated ids are drawn like others."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 53))
    # the place is numbered before any filter
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    wanted = {k: min(1 << 53, int((1 << 53) * (1.5 * fit_per_lang + 50) / n)) for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)])
    some = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("draw") < limit[F.col("lang")]))
    # what is collected is a number for each language, out of a sample of a bounded size
    at = some.groupBy("lang").agg(F.try_element_at(F.array_sort(F.collect_list("draw")), F.lit(fit_per_lang)).alias("draw")).collect()
    last = F.create_map(*[F.lit(x) for r in at for x in (r["lang"], (1 << 53) if r["draw"] is None else r["draw"])])
    return some.where(F.col("draw") <= last[F.col("lang")]).select("lang", "text")


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_per_lang: int = FIT_PER_LANG, buckets: int = BUCKETS, smooth: float = 0.5) -> Model:
    """Learn from at most ``fit_per_lang`` documents of each language (all, where there are fewer); the prior counts them all."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0))
    drawn = _drawn(labelled, id_col, text_col, lang_col, sizes, fit_per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            which = np.array([langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
            for first, data, offsets in flat.pieces(batch.column(1)):
                for grams, row in _grams(*_codes(data, offsets), buckets):
                    own = which[first + row]
                    for k in np.unique(own):
                        total.setdefault(int(k), np.zeros(buckets, np.int64))
                        total[int(k)] += np.bincount(grams[own == k], minlength=buckets)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["k", "bucket", "n"])

    got = drawn.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((buckets, len(langs)))
    table[got["bucket"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    prior = np.log(np.array([sizes[k] for k in langs]) / sum(sizes.values()))
    return Model(langs, np.log((table + smooth) / (table.sum(0) + smooth * buckets)).astype(np.float32), prior)


def predict(documents: DataFrame, model: Model, *, text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """The columns in ``carry``, then ``lang_pred`` and ``score``: the posterior probability of the language."""
    given = documents.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = given.schema[:-1]
    schema = kept.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        at_once = max(1, GATHERED // max(1, len(m.langs)))
        for batch in batches:
            n, n_carry = batch.num_rows, batch.num_columns - 1
            sums, letters = np.zeros((n, len(m.langs))), np.zeros(n, bool)
            for first, data, offsets in flat.pieces(batch.column(n_carry)):
                low, row = _codes(data, offsets)
                letters[first + row[low != 32]] = True
                for grams, row in _grams(low, row, len(m.table)) if m.langs else ():
                    for i in range(0, len(grams), at_once):
                        own = row[i : i + at_once]
                        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        sums[first + own[cuts]] += np.add.reduceat(m.table[grams[i : i + at_once]], cuts, axis=0, dtype=np.float64)
            known = letters if m.langs else np.zeros(n, bool)
            best, value = np.full(n, len(m.langs)), np.zeros(n)
            if known.any():
                sums = sums[known] + m.prior
                best[known] = sums.argmax(1)
                value[known] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carry], pa.array(names[best], pa.string()), pa.array(value)], names=[*batch.schema.names[:n_carry], "lang_pred", "score"])
        flat.tidy()

    return given.mapInArrow(score, schema)


def keep_known(documents: DataFrame, model: Model, *, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The documents whose language is recognised, with their columns: neither ``und`` nor a posterior under ``min_score``."""
    boxed = predict(documents, model, text_col=text_col, carry=(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__doc"),))
    good = boxed.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return good.select(*[F.col(f"__doc.`{c}`").alias(c) for c in documents.columns])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """``op2_language_id``: learns from the fold that is not held out and predicts every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(~held_out()))
    return predict(documents, model, carry=(F.col("doc_id"), held_out().alias("held_out")))
