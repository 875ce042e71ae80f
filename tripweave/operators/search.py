"""Parameter search: seeded random points, scored fold by fold by several fits at a time.

A fold's features, weights and vectors are fitted and written once and shared by all points (models.fold_tables), as a run with the
point would fit them, so a search reports the loss that the run then has. Fits are Spark jobs that leave cores idle while a tree's
next level is planned, so driver threads submit some of them side by side, each to a scheduler pool of its own
(spark.scheduler.mode=FAIR shares the cores evenly; without it they queue for free slots).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Span:
    """Range of a parameter, ends included: whole steps from `low` where `step` is given, else real, on the log scale if wanted."""

    low: float
    high: float
    step: int | None = None
    log: bool = False

    def __post_init__(self):
        if self.low > self.high or (self.log and self.low <= 0) or (self.step is not None and self.step < 1):
            raise ValueError(f"no values in {self}")

    def draw(self, generator: random.Random) -> float | int:
        if self.step is not None:
            return int(self.low) + self.step * generator.randint(0, int((self.high - self.low) // self.step))
        if self.log:
            return math.exp(generator.uniform(math.log(self.low), math.log(self.high)))
        return generator.uniform(self.low, self.high)


def random_points(space: dict[str, Span | list], trials: int, seed: int = 0) -> list[dict]:
    """`trials` points of the space, a list being a choice. The first points of a longer search are those of a shorter one."""
    generator = random.Random(seed)
    chosen = sorted(space)
    return [{n: space[n].draw(generator) if isinstance(space[n], Span) else generator.choice(space[n]) for n in chosen} for _ in range(trials)]


@dataclass
class Trial:
    """A point and its loss on each fold that it was scored on."""

    number: int
    params: dict
    losses: dict[int, float] = field(default_factory=dict)

    @property
    def loss(self) -> float:
        """Mean over its folds."""
        return sum(self.losses.values()) / len(self.losses)


@dataclass
class Found:
    """All trials of a search in drawing order, and the one with the least mean loss over all folds; ties go to the earlier one."""

    trials: list[Trial]
    folds: list[int]

    @property
    def best(self) -> Trial:
        return min((t for t in self.trials if len(t.losses) == len(self.folds)), key=lambda t: (t.loss, t.number))

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per trial and fold: parameters, loss on the fold, mean loss, and whether the trial won."""
        best = self.best.number
        rows = [
            {"trial": t.number, **{n: float(v) for n, v in t.params.items()}, "fold": f, "loss": loss, "mean_loss": t.loss, "best": t.number == best}
            for t in self.trials for f, loss in t.losses.items()
        ]
        names = sorted(self.trials[0].params)
        schema = ", ".join(["trial int", *[f"{n} double" for n in names], "fold int", "loss double", "mean_loss double", "best boolean"])
        return spark.createDataFrame([tuple(r[c] for c in ["trial", *names, "fold", "loss", "mean_loss", "best"]) for r in rows], schema)


def search(spark: SparkSession, found: list, prepare: Callable, loss: Callable[..., float], points: list[dict], threads: int = 4, keep: float = 1.0) -> Found:
    """Score the points on every fold.

    `prepare(fold)` makes what all points share there, `loss(prepared, **point)` is one fit's loss. With `keep` below one, only that
    share of the field, the best by mean loss so far and at least one, goes on to the next fold. The result does not depend on the number of threads.
    """
    if not points or not found:
        raise ValueError("a search needs points and folds")
    if not 0 < keep <= 1 or threads < 1:
        raise ValueError("keep is a share above 0 and at most 1, threads at least 1")
    trials = [Trial(k, p) for k, p in enumerate(points)]
    standing = trials

    for position, fold in enumerate(found):
        prepared = prepare(fold)

        def score(trial: Trial, prepared=prepared, number=fold.number) -> tuple[Trial, int, float]:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial.number % threads}")
            return trial, number, float(loss(prepared, **trial.params))

        with ThreadPoolExecutor(threads) as pool:
            # Each submission copies the caller's job properties to the thread that runs it.
            for trial, number, value in [f.result() for f in [pool.submit(inheritable_thread_target(spark)(score), t) for t in standing]]:
                trial.losses[number] = value
        if position < len(found) - 1:
            standing = sorted(standing, key=lambda t: (t.loss, t.number))[: max(1, math.ceil(keep * len(standing)))]
    return Found(trials, [f.number for f in found])
