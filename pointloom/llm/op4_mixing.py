"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words between white space) are summed by cell (source, language, topic); the cells' weights are raked until the weighted marginals are
the targets; each document is then drawn, by the hash of its id, with a probability proportional to its cell's weight, so that the
expected tokens are the budget. Topics are kinds of writing, told by simple marks, unless the caller names a column or expression.

Probabilities end at 1, so the weights are raked against what is expected with them held there: the shares of the expected tokens are
the targets, as far as there are tokens, and ``Fit.off`` says how far off the result is.

Sizes: every level is raked, however many there are. Up to ``ON_DRIVER`` cells are fitted on the driver and broadcast; more
stay a table, each step of the raking an aggregation by level and a join. Sums are combined before they are shuffled, and
a document is shuffled only to meet more cells than may be broadcast.

Defined results:
- null levels are a level of their own, ``(none)``; null and empty texts have no tokens and topic ``empty``;
- a given target for a level that no document has is an error; one for a level without tokens cannot be met: the axis's other targets
  are scaled up; with given targets, a level without one gets none of the budget;
- targets that contradict each other, or that need more tokens than there are, end at the closest round's weights, and ``off`` tells;
- rows with equal ids are drawn together; null ids are drawn by the hash of their text;
- an empty table gives an empty result; further columns are returned by ``sample``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import staging

AXES = ("source", "lang", "topic")
NONE = "(none)"
#: Cells that the driver fits and that are broadcast: at most about 100 MB.
ON_DRIVER = 1_000_000
#: The registered query's targets: shares proportional to tokens to these powers; and its budget, a share of all tokens.
POWERS, BUDGET = {"source": 0.5, "lang": 0.5, "topic": 0.9}, 0.5
ROUNDS, CLOSE = 1000, 1e-10
#: The same for more cells than the driver fits.
FAR_ROUNDS, FAR_CLOSE = 30, 1e-6


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _many(text: Column, mark: str, size: Column) -> Column:
    return (size - F.length(F.replace(text, F.lit(mark), F.lit("")))) * 50 >= size


def topic(text: Column) -> Column:
    """What kind of writing a text is: tables, loud or marked-up text, short notes, or prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    return F.when(size == 0, "empty").when(_many(t, "|", size), "table").when(_many(t, "!!", size), "loud").when(_many(t, "###", size), "marked").when(size < 500, "short").otherwise("prose")


@dataclass(frozen=True)
class Fit:
    cells: DataFrame  #: (level of each axis, ``n`` tokens, ``weight``, ``prob``), kept in the shared folder
    off: float  #: the largest distance of a share of the expected tokens from its target


def _level(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def _factor(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """k such that the sum of tokens x min(1, k x weight) is the budget, as far as there are tokens."""
    usable = (weight > 0) & (tokens > 0)
    t, w = tokens[usable], weight[usable]
    order = np.argsort(-w)
    t, w = t[order], w[order]
    # with the i first cells full, the rest takes what is left
    full, mass = np.concatenate([[0.0], np.cumsum(t)[:-1]]), np.cumsum((t * w)[::-1])[::-1]
    k = (budget - full) / np.maximum(mass, 1e-300)
    fits = np.flatnonzero(k * w <= 1)
    return float(max(0.0, k[fits[0]])) if len(fits) else (float(1 / w[-1]) if len(w) else 0.0)


def calibrate(tokens: np.ndarray, index: list[np.ndarray], goals: list[np.ndarray], budget: float, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Probabilities of the cells, and how far off the marginals of the expected tokens are. ``index``: for each axis the level of each cell.

    The weights are raked axis by axis against what is expected of them with probabilities held at 1, so that the marginals are met after that, too."""
    if not len(tokens):
        return np.zeros(0), 0.0
    goals = [np.where(np.bincount(i, weights=tokens, minlength=len(g)) > 0, g, 0.0) for i, g in zip(index, goals, strict=True)]
    goals = [g / max(g.sum(), 1e-300) for g in goals]
    weight = np.ones(len(tokens))

    def expected() -> tuple[np.ndarray, np.ndarray]:
        p = np.minimum(1.0, _factor(tokens, weight, budget) * weight)
        return p, tokens * p

    best, best_off, since = expected()[0], np.inf, 0
    for _ in range(rounds):
        for i, goal in zip(index, goals, strict=True):
            _, e = expected()
            now = np.bincount(i, weights=e, minlength=len(goal)) / max(e.sum(), 1e-300)
            weight = weight * np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[i]
        weight /= max(weight.max(initial=0.0), 1e-300)
        p, e = expected()
        off = max((float(np.abs(np.bincount(i, weights=e, minlength=len(g)) / max(e.sum(), 1e-300) - g).max()) for i, g in zip(index, goals, strict=True)), default=0.0)
        since = 0 if off < 0.999 * best_off else since + 1
        if off < best_off:
            best, best_off = p, off
        if off <= close or since >= 20:
            break
    return best, best_off


def _factor_apart(cells: DataFrame, budget: float) -> float:
    """The factor, from sums of cells of nearly equal weight: a few thousand rows, whatever the cells."""
    near = cells.where("weight > 0 and n > 0").groupBy(F.floor(F.log2("weight") * 256).alias("at")).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("weight"))
    got = near.select(F.col("n").cast("double"), "weight").toArrow()
    return _factor(got["n"].to_numpy(), got["weight"].to_numpy(), budget)


def _calibrate_apart(cells: DataFrame, axes: list[str], budget: float) -> tuple[DataFrame, float]:
    """The same where the cells are too many for the driver: each axis of each round is an aggregation by level and a join back; ``cells`` has a target share ``goal_<axis>``."""
    cells, best, best_off = cells.withColumn("weight", F.lit(1.0)), None, np.inf
    expects = F.col("n") * F.col("p")

    def filled(cells: DataFrame) -> tuple[DataFrame, float]:
        now = cells.withColumn("p", F.least(F.lit(1.0), F.lit(_factor_apart(cells, budget)) * F.col("weight")))
        return now, max(now.agg(F.sum(expects)).first()[0] or 0.0, 1e-300)

    for _ in range(FAR_ROUNDS):
        for axis in axes:
            now, total = filled(cells)
            share = now.groupBy(axis).agg((F.sum(expects) / F.lit(total)).alias("now"))
            raked = now.drop("p").join(share, axis).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"goal_{axis}") / F.col("now")).otherwise(0.0))
            cells = staging.keep(raked.drop("now"), "mix-raked")
        now, total = filled(cells)
        apart = [now.groupBy(axis, f"goal_{axis}").agg(F.sum(expects).alias("e")).agg(F.max(F.abs(F.col("e") / F.lit(total) - F.col(f"goal_{axis}")))).first()[0] for axis in axes]
        off, before = max([0.0, *[x or 0.0 for x in apart]]), best_off
        if off < best_off:
            best, best_off = now, off
        if off <= FAR_CLOSE or off > 0.99 * before:
            break
    return (cells.withColumn("p", F.lit(0.0)), 0.0) if best is None else (best, best_off)


def _refuse(axis: str, missing: list[str], total: int) -> None:
    if missing and total:
        raise ValueError(f"targets for a {axis} that no document has: {', '.join(missing)}")


def _with_goals(cells: DataFrame, axes: list[str], targets: dict[str, dict[str, float]] | None, powers: dict[str, float | None], total: int) -> DataFrame:
    """``cells`` with the target share ``goal_<axis>`` of each axis, where they are too many for the driver."""
    spark, with_goals = cells.sparkSession, cells
    for axis in axes:
        levels = cells.groupBy(axis).agg(F.sum("n").alias("n"))
        if targets and axis in targets:
            # as many rows as were given
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[axis].items()], f"{axis} string, goal double")
            _refuse(axis, [r[0] for r in given.where("goal > 0").join(levels, axis, "left_anti").orderBy(axis).limit(10).collect()], total)
            goal = levels.where("n > 0").join(given, axis)
        else:
            goal = levels.where("n > 0").withColumn("goal", F.pow(F.col("n").cast("double"), F.lit(float(powers[axis]))))
        goal = goal.select(axis, "goal").join(goal.agg(F.sum("goal").alias("goals"))).select(axis, (F.col("goal") / F.col("goals")).alias(f"goal_{axis}"))
        with_goals = with_goals.join(goal, axis, "left").withColumn(f"goal_{axis}", F.coalesce(f"goal_{axis}", F.lit(0.0)))
    return staging.keep(with_goals, "mix-goals")


def fit(documents: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, powers: dict[str, float | None] = POWERS, budget: float = BUDGET, text_col: str = "text", topic_of: Column | None = None, on_driver: int = ON_DRIVER) -> Fit:
    """Sum the cells and set their probabilities. An axis in ``targets`` has its shares from there, others from ``powers`` (None: the axis is left alone)."""
    slim = documents.select(
        _level("source").alias("source"), _level("lang").alias("lang"), F.coalesce(topic(F.col(text_col)) if topic_of is None else topic_of.cast("string"), F.lit(NONE)).alias("topic"), n_tokens(F.col(text_col)).alias("n")
    )
    cells = staging.keep(slim.groupBy(*AXES).agg(F.sum("n").alias("n")), "mix-cells")
    axes = [a for a in AXES if (targets and a in targets) or powers.get(a) is not None]
    spark = documents.sparkSession
    if cells.count() > on_driver or not on_driver:
        total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found, off = _calibrate_apart(_with_goals(cells, axes, targets, powers, total), axes, budget * total)
        found = found.select(*AXES, "n", F.col("p").alias("prob"))
    else:
        rows = cells.orderBy(*AXES).toArrow().to_pylist()
        total = sum(r["n"] for r in rows)
        index, goals = [], []
        for axis in axes:
            names, place = np.unique(np.array([r[axis] for r in rows], object), return_inverse=True) if rows else (np.zeros(0, object), np.zeros(0, int))
            tokens = np.bincount(place, weights=[r["n"] for r in rows], minlength=len(names))
            if targets and axis in targets:
                given = {str(k): float(v) for k, v in targets[axis].items()}
                _refuse(axis, sorted(k for k in given.keys() - set(names) if given[k] > 0)[:10], total)
                goal = np.array([given.get(x, 0.0) for x in names])
            else:
                goal = np.power(np.maximum(tokens, 1.0), float(powers[axis]))
            goal = np.where(tokens > 0, goal, 0.0)
            index.append(place)
            goals.append(goal / max(goal.sum(), 1e-300))
        p, off = calibrate(np.array([r["n"] for r in rows], float), index, goals, budget * total)
        found = spark.createDataFrame([(*[r[a] for a in AXES], r["n"], float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, n long, prob double")
    # weights are probabilities relative to drawing all alike
    return Fit(staging.keep(found.select(*AXES, "n", (F.col("prob") / F.lit(budget)).alias("weight"), "prob"), "mix-fitted"), off)


def weighted(documents: DataFrame, fitted: Fit, *, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None, seed: int = 0) -> DataFrame:
    """``documents`` in a struct ``__doc``, with ``__topic``, ``__weight``, ``__prob`` and ``__sampled``. Up to ``ON_DRIVER`` cells are broadcast."""
    cells = fitted.cells.select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("weight").alias("__weight"), F.col("prob").alias("__prob"))
    cells = F.broadcast(cells) if cells.count() <= ON_DRIVER else cells
    base = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__doc"),
        _level("source").alias("__s"),
        _level("lang").alias("__l"),
        (topic(F.col(text_col)) if topic_of is None else topic_of.cast("string")).alias("__topic"),
    ).withColumn("__t", F.coalesce("__topic", F.lit(NONE)))
    unit = F.pmod(F.xxhash64(F.coalesce(F.col(f"__doc.`{id_col}`").cast("long"), F.xxhash64(f"__doc.`{text_col}`")), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return base.join(cells, ["__s", "__l", "__t"]).withColumn("__sampled", unit < F.col("__prob"))


def sample(documents: DataFrame, fitted: Fit, **params) -> DataFrame:
    """The drawn documents, with their columns."""
    drawn = weighted(documents, fitted, **params).where("__sampled")
    return drawn.select(*[F.col(f"__doc.`{c}`").alias(c) for c in documents.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """``op4_mixing``: every document's weight and probability, and whether it is drawn."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return weighted(documents, fit(documents)).select("__doc.doc_id", "__doc.source", "__doc.lang", F.col("__topic").alias("topic"), n_tokens(F.col("__doc.text")).alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__prob").alias("prob"), F.col("__sampled").alias("sampled"))
