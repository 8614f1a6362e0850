"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of every cell are summed; the
table of cells is raked until its margins have the shares asked for, with ``budget`` times all
tokens in total and no cell asked for more than it holds. A document is kept with the chance
(target of its cell) / (tokens of its cell), by a hash of its id, so a lost task draws the same.

Targets name the categories; what they do not name, and null, is ``OTHER`` and keeps its share.
The cells are therefore bounded by the targets, whatever the corpus, and are raked on the driver.
Sums are combined before their shuffle, so one source with a large part of all rows is no hot key.

Tokens are words between white space. Topics are kinds of text told by their signs: ``table``,
``noisy``, ``figures`` and ``prose``.

Defined results: null text is empty, has no tokens and topic ``prose``; cells without tokens keep
their documents with the chance ``budget``; a null ``doc_id`` draws like the text ``null``; equal
ids draw alike; an empty table gives no rows; of clashing columns the made ones win.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.common import table

OTHER = "other"
AXES = ("source", "lang", "topic")
BUDGET, ROUNDS = 0.5, 200
#: Relative weights. Sources weigh alike, so that no source outweighs the others.
TARGETS = {
    "source": {f"src{i}": 1.0 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.9, "table": 0.03, "noisy": 0.069, "figures": 0.001},
}


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """Shares of signs among all characters decide."""
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))) / chars
    return (
        F.when(share("|") > 0.02, "table")
        .when(share("#$%&*!") > 0.04, "noisy")
        .when(share("0123456789") > 0.04, "figures")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """``docs`` with ``tokens``, ``topic`` and the categories ``_source``, ``_lang``, ``_topic``."""
    made = docs.withColumn("tokens", token_count(F.col("text"))).withColumn("topic", topic(F.coalesce("text", F.lit(""))))
    for axis in AXES:
        known = F.col(axis).isin(list(targets[axis]))
        made = made.withColumn(f"_{axis}", F.when(known, F.col(axis)).otherwise(OTHER))
    return made


def rake(cells: dict[tuple[str, ...], float], targets: dict[str, dict[str, float]], budget: float = BUDGET, rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Tokens wanted of each cell. Margins in turn are scaled to their shares; what a full cell
    cannot give, the others of its margin do; a margin that cannot be met gives what it has."""
    keys = sorted(cells)
    held = np.array([cells[k] for k in keys], float)
    total = held.sum()
    if not total:
        return dict.fromkeys(keys, 0.0)
    wanted = held * budget
    margins = []
    for n, axis in enumerate(AXES):
        names = sorted({k[n] for k in keys})
        of = np.array([names.index(k[n]) for k in keys])
        mass = np.bincount(of, held, len(names))
        other = mass[names.index(OTHER)] / total if OTHER in names else 0.0
        weight = np.array([0.0 if x == OTHER else targets[axis][x] for x in names])
        share = weight / max(weight.sum(), 1e-300) * (1 - other)
        if OTHER in names:
            share[names.index(OTHER)] = other
        margins.append((of, share * total * budget))
    for _ in range(rounds):
        before = wanted.copy()
        for of, goal in margins:
            for _ in range(8):  # until what was cut off at full cells is dealt to the others
                free = wanted < held
                fixed = np.bincount(of, np.where(free, 0, wanted), len(goal))
                loose = np.bincount(of, np.where(free, wanted, 0), len(goal))
                over = np.bincount(of, wanted, len(goal)) > goal * (1 + 1e-12)
                factor = np.where(over, goal / np.maximum(fixed + loose, 1e-300), np.maximum(goal - fixed, 0) / np.maximum(loose, 1e-300))
                scaled = np.where(over[of] | free, wanted * factor[of], wanted)
                scaled = np.minimum(scaled, held)
                if np.abs(scaled - wanted).max() <= 1e-9 * total:
                    break
                wanted = scaled
        if np.abs(wanted - before).max() <= 1e-9 * total:
            break
    return dict(zip(keys, wanted.tolist()))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 5) -> DataFrame:
    """``docs`` with ``tokens``, ``topic``, ``probability`` and ``kept``."""
    targets = targets or TARGETS
    placed = with_cells(docs, targets)
    names = [f"_{a}" for a in AXES]
    sums = placed.groupBy(*names).agg(F.sum("tokens").alias("tokens")).collect()  # bounded by the targets
    cells = {tuple(r[n] for n in names): float(r["tokens"]) for r in sums}
    wanted = rake(cells, targets, budget)
    chance = {k: wanted[k] / v if v else budget for k, v in cells.items()}
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)), 11) / float(1 << 53)
    if not chance:
        return placed.drop(*names).withColumns({"probability": F.lit(budget), "kept": F.lit(False)})
    listed = F.create_map(*[F.lit(x) for k, v in sorted(chance.items()) for x in ("\x1f".join(k), float(v))])
    probability = F.element_at(listed, F.concat_ws("\x1f", *names))
    return placed.withColumn("probability", probability).withColumn("kept", draw < F.col("probability")).drop(*names)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "probability", "kept")
