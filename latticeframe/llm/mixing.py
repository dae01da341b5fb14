"""Mixing sources to target weights by iterative proportional fitting (operator 2).

Documents fall in cells of (source, language, topic); without a column for it the topic is a cluster of the texts'
words, see ``topics``.  Token weights are raked until the three marginals meet their
targets; a cell's calibrated rate, scaled so that the largest is 1 or a token budget is met, is the probability that a document of the
cell is drawn.  Draws compare a hash of the document and a seed with that rate, so they repeat exactly.

Cells come from one aggregation with partial sums.  All categories are raked, over the cells that occur.  Up to
``driver_cells`` (131,072) of them are raked on the driver and broadcast; that is the bound of both.  More stay in the shared
folder: each raking step is an aggregation and a join, and rates reach their documents by a join that is not broadcast.
Only if ``most`` is given, a dimension keeps its ``most`` heaviest categories and those that targets name, and
pools the rest, which are raked as one category; none is dropped.

Targets: per dimension a table category -> share (missing categories share what is left by their own weight), or by
default each category's share to the power ``temper``, which lifts rare ones.  A share for a category that has no
tokens can't be met and is an error, unless no text has any; so are targets that were given and that no weights of the
cells that occur can meet together to ``MISS`` of a share.  Default targets give way where not all can be met.

Edge cases: a null source, language or topic is a category of its own, apart from any name; a null or empty text has no
tokens and takes the rate of its cell; a cell without tokens takes rate 1; repeated rows, and rows of one id and cell, are
drawn alike, and a null id always; ties can't matter; texts of any length are counted whole; clashing column names
are kept, as the row travels as one column; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, remove, stored
from .topics import topic_and_tokens

DIMENSIONS = ("source", "lang", "topic")
#: What names no category: names get ``=`` in front, so that these can't be one.
POOLED, MISSING = "*", "?"
MISS = 1e-6


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def category(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), MISSING).otherwise(F.concat(F.lit("="), value))


def named(value: Column) -> Column:
    """A category as it is shown: its name, ``*`` for pooled ones, null for null."""
    return F.when(value == POOLED, POOLED).when(value.startswith("="), F.substr(value, F.lit(2)))


def rake(table: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights for a table of three axes whose marginals meet the targets (shares of one)."""
    at = np.nonzero(table)
    w = np.zeros(table.shape)
    w[at] = rake_cells(list(at), table[at], targets, rounds, tolerance)
    return w


def rake_cells(at: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-9, given: tuple = (0, 1, 2)) -> np.ndarray:
    """The same for the cells that occur: their places on each axis and their tokens.

    ``given`` are the axes whose targets were asked for: those must be met, and come last where not all can be.
    """
    w = tokens / max(tokens.sum(), 1e-300)
    for axes in (range(len(at)), given):
        seen: list[float] = []
        for _ in range(rounds):
            worst = 0.0
            for k in axes:
                now = np.bincount(at[k], w, len(targets[k]))
                factor = np.divide(targets[k], now, out=np.zeros_like(targets[k]), where=now > 0)
                worst = max(worst, float(np.abs(now - targets[k]).max(initial=0)))
                w = w * factor[at[k]]
            if worst < tolerance or _stalled(seen, worst):
                break
    if len(w):
        _check_miss(max((float(np.abs(np.bincount(at[k], w, len(targets[k])) - targets[k]).max(initial=0)) for k in given), default=0.0))
    return w


def _stalled(seen: list[float], worst: float) -> bool:
    """Whether ten rounds have brought less than a hundredth, as where no weights meet the targets."""
    seen.append(worst)
    return len(seen) > 20 and worst > 0.99 * seen[-11]


def _check_miss(worst: float) -> None:
    if worst > MISS:
        raise ValueError(f"no weights of these cells meet all targets together: a share is missed by {worst:.2g}")


def _target(shares: np.ndarray, names: list[str], given: dict | None, temper: float) -> np.ndarray:
    if given is None:
        out = np.where(shares > 0, shares, 1) ** temper * (shares > 0)
    else:
        out = np.array([given.get(n, 0.0) for n in names])
        rest = np.array([s if n not in given else 0.0 for n, s in zip(names, shares, strict=True)])
        if rest.sum() > 0:
            out = out + rest / rest.sum() * max(0.0, 1 - out.sum())
        out = out * (shares > 0)
    return out / out.sum() if out.sum() > 0 else out


def _check_targets(cells: DataFrame, targets: dict) -> None:
    """Raises for a share that no document can take up."""
    unknown = set(targets) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"targets for unknown dimensions: {sorted(unknown)}")
    for d, given in targets.items():
        asked = sorted((n for n, share in given.items() if share > 0), key=str)
        asked = [f"={n}" if n is not None else MISSING for n in asked]
        have = {r[d] for r in cells.where(F.col(d).isin(asked) & (F.col("n") > 0)).select(d).distinct().collect()}
        if set(asked) - have and not cells.where("n > 0").isEmpty():
            raise ValueError(f"targets of {d} name categories without tokens: {sorted(set(asked) - have)}")


def _pooled(cells: DataFrame, targets: dict, most: int) -> tuple[DataFrame, dict]:
    """Cells by the kept categories of each dimension, and those: the heaviest and all that targets name."""
    kept = {}
    for d in DIMENSIONS:
        top = cells.groupBy(d).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), d).limit(most).collect()
        kept[d] = sorted({r[d] for r in top} | set(targets.get(d) or ()))
    pool = [F.when(F.col(d).isin(kept[d]), F.col(d)).otherwise(POOLED).alias(d) for d in DIMENSIONS]
    return cells.groupBy(*pool).agg(F.sum("n").alias("n")), kept


def _told(documents: DataFrame, topic: Column | None, topics: int) -> Column:
    """A column (topic, n) over ``documents``: a row's topic and its tokens."""
    if topic is None:
        return topic_and_tokens(documents, topics)
    return F.struct(topic.alias("topic"), token_count(F.col("text")).alias("n"))


def _cell(source: str, lang: str, told: str) -> list[Column]:
    """Columns k_source, k_lang, k_topic and k_tokens of the columns that are named."""
    cell = zip(DIMENSIONS, (source, lang, f"{told}.topic"), strict=True)
    return [*(category(F.col(c)).alias(f"k_{d}") for d, c in cell), F.col(f"{told}.n").alias("k_tokens")]


def calibrate(documents: DataFrame, targets: dict | None = None, **options) -> DataFrame:
    """Rates by cell: source, lang, topic, tokens, weight, rate; options as for ``mix``."""
    rates = _rates(documents, targets=targets, **options)[0]
    return rates.select(*(named(F.col(d)).alias(d) for d in DIMENSIONS), "tokens", "weight", "rate")


def _rates(documents: DataFrame, targets: dict | None = None, temper: float = 0.7, budget: float | None = None, most: int | None = None, topic: Column | None = None, topics: int = 8, driver_cells: int = 1 << 17) -> tuple[DataFrame, dict, bool, Column]:
    """Rates by cell, the kept categories if some are pooled, whether the table is small, and the column of a row's topic and tokens."""
    spark = documents.sparkSession
    bounded_batches(spark)
    targets = {d: t for d, t in (targets or {}).items() if t is not None}
    told = _told(documents, topic, topics)
    rows = documents.select("source", "lang", told.alias("told")).select(*_cell("source", "lang", "told"))
    cells, path = stored(rows.groupBy(*(F.col(f"k_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("k_tokens").alias("n")), "cells")
    _check_targets(cells, targets)
    targets = {d: {f"={n}" if n is not None else MISSING: x for n, x in t.items()} for d, t in targets.items()}
    kept = {}
    if most is not None:
        few, kept = _pooled(cells, targets, most)
        cells, pooled_path = stored(few, "cells")
        remove(spark, path)
        path = pooled_path
    small = cells.count() <= driver_cells
    out = _on_driver(cells, targets, temper, budget) if small else _on_cluster(cells, targets, temper, budget)
    remove(spark, path)
    return out, kept, small, told


CELL = "source string, lang string, topic string, tokens long, weight double, rate double"


def _on_driver(cells: DataFrame, targets: dict, temper: float, budget: float | None) -> DataFrame:
    found = sorted(cells.select(*DIMENSIONS, "n").collect())
    tokens = np.array([r["n"] for r in found], float)
    total = tokens.sum()
    axes, at, goals = [], [], []
    for d in DIMENSIONS:
        names, place = np.unique(np.array([r[d] for r in found], object), return_inverse=True)
        axes.append(names)
        at.append(place.astype(np.int64))
        goals.append(_target(np.bincount(place, tokens, len(names)) / max(total, 1), names.tolist(), targets.get(d), temper))
    weight = rake_cells(at, tokens, goals, given=tuple(k for k, d in enumerate(DIMENSIONS) if d in targets))
    rate = np.divide(weight * total, tokens, out=np.zeros_like(weight), where=tokens > 0)
    top = rate.max(initial=0)
    scale = 1 / top if top > 0 else 1.0
    if budget is not None and total > 0:
        scale = _scale_to(budget * total, rate, tokens)
    out = [(*r[:3], r["n"], float(w), min(1.0, float(x * scale)) if r["n"] else 1.0) for r, w, x in zip(found, weight, rate, strict=True)]
    return cells.sparkSession.createDataFrame(out, CELL)


def _on_cluster(cells: DataFrame, targets: dict, temper: float, budget: float | None, rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """``_on_driver`` with the cells and all marginals in the shared folder."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("n")).first()[0] or 0
    goals, paths = {}, []
    for d in DIMENSIONS:
        share = cells.groupBy(d).agg((F.sum("n") / F.lit(max(total, 1))).alias("share"))
        given = targets.get(d)
        if given is None:
            goal = F.when(F.col("share") > 0, F.pow("share", F.lit(float(temper)))).otherwise(0.0)
        else:
            asked = spark.createDataFrame([(n, float(x)) for n, x in given.items()], f"{d} string, given double")
            share = share.join(asked, d, "left")
            left = max(0.0, 1 - sum(given.values()))
            rest = share.where("given IS NULL").agg(F.sum("share")).first()[0] or 0
            goal = F.when(F.col("share") > 0, F.coalesce("given", F.col("share") * F.lit(left / rest if rest else 0.0))).otherwise(0.0)
        goal = share.select(d, goal.alias("goal"))
        whole = goal.agg(F.sum("goal")).first()[0] or 0
        goals[d], path = stored(goal.withColumn("goal", F.col("goal") / F.lit(whole or 1.0)), "goals")
        paths.append(path)
    w, path = stored(cells.select(*DIMENSIONS, "n", (F.col("n") / F.lit(float(max(total, 1)))).alias("w")), "raked")
    given = [d for d in DIMENSIONS if d in targets]
    for axes in (DIMENSIONS, given):
        seen: list[float] = []
        for _ in range(rounds if axes else 0):
            worst = 0.0
            for d in axes:
                now, now_path = stored(w.groupBy(d).agg(F.sum("w").alias("now")).join(goals[d], d), "marginal")
                worst = max(worst, now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
                factor = now.select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
                new, new_path = stored(w.join(factor, d).select(*DIMENSIONS, "n", (F.col("w") * F.col("factor")).alias("w")), "raked")
                remove(spark, path, now_path)
                w, path = new, new_path
            if worst < tolerance or _stalled(seen, worst):
                break
    for d in given:
        now = w.groupBy(d).agg(F.sum("w").alias("now")).join(goals[d], d)
        _check_miss(now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
    rate = F.when(F.col("n") > 0, F.col("w") * F.lit(float(total)) / F.col("n")).otherwise(0.0)
    rated = w.withColumn("r", rate)
    top = rated.agg(F.max("r")).first()[0] or 0
    scale = 1 / top if top > 0 else 1.0
    if budget is not None and total > 0:
        scale = _scale_of(rated, budget * total)
    out, _ = stored(rated.select(*DIMENSIONS, F.col("n").alias("tokens"), F.col("w").alias("weight"), F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("r") * F.lit(scale))).otherwise(1.0).alias("rate")), "rates")
    remove(spark, path, *paths)
    return out


def _scale_to(tokens: float, rate: np.ndarray, table: np.ndarray) -> float:
    """The scale at which min(1, rate * scale) draws that many tokens in expectation, by bisection."""
    low, high = 0.0, 1 / max(rate[rate > 0].min(initial=1.0), 1e-12)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (np.minimum(1, rate * mid) * table).sum() >= tokens else (mid, high)
    return high


def _scale_of(rated: DataFrame, tokens: float) -> float:
    """The same over cells in a table (n, r): what is drawn is concave in the scale, so Newton's steps rise to the answer."""
    scale = 0.0
    for _ in range(100):
        full = F.col("r") * F.lit(scale) >= 1
        sums = rated.agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("r") * F.col("n"))).alias("slope"), F.min(F.when(F.col("r") > 0, F.col("r"))).alias("least")).first()
        high = 1 / max(sums["least"] or 1.0, 1e-12)
        new = min(high, (tokens - sums["held"]) / sums["slope"]) if sums["slope"] else high
        if new <= scale * (1 + 1e-13):
            break
        scale = new
    return scale


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")) / F.lit(float(1 << 52))


def mix(documents: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The drawn documents, with all their columns.

    Options: ``targets``, ``temper``, ``budget`` (share of the tokens), ``most``, ``topic`` (a column; else ``topics``
    clusters of the texts' words), ``driver_cells``.
    """
    return _drawn(documents, seed, **options).select("doc.*")


def _drawn(documents: DataFrame, seed: int = 20, **options) -> DataFrame:
    rates, kept, small, told = _rates(documents, **options)
    table = rates.toDF("c_source", "c_lang", "c_topic", "c_tokens", "c_weight", "c_rate")
    held = documents.select(F.struct("*").alias("doc"), told.alias("k_told"), draw(F.col("doc_id"), seed).alias("k_draw"))
    held = held.select("doc", *_cell("doc.source", "doc.lang", "k_told"), "k_draw")
    if kept:
        held = held.withColumns({f"k_{d}": F.when(F.col(f"k_{d}").isin(kept[d]), F.col(f"k_{d}")).otherwise(POOLED) for d in DIMENSIONS})
    both = held.join(F.broadcast(table) if small else table, (F.col("k_source") == F.col("c_source")) & (F.col("k_lang") == F.col("c_lang")) & (F.col("k_topic") == F.col("c_topic")))
    return both.where(F.coalesce("k_draw", F.lit(0.0)) < F.col("c_rate"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The drawn documents, half the tokens in expectation: doc_id, their cell, tokens and rate."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    cell = [named(F.col(f"k_{d}")).alias(d) for d in DIMENSIONS]
    return _drawn(documents, budget=0.5).select("doc.doc_id", *cell, F.col("k_tokens").alias("n_tokens"), F.round("c_rate", 9).alias("rate"))
