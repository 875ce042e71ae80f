"""Log-link count model with variance mu + alpha mu^2, its dispersion alpha estimated by maximum likelihood.

Coefficients come from iteratively reweighted least squares: with the margin eta = log mu a row's weight is mu / (1 + alpha mu) and its
working response eta + (y - mu) / mu. One step is one weighted least-squares fit by normal equations (LinearRegression, solver
"normal"), which is one aggregate over the rows. The dispersion has a search of its own: each pass takes the log likelihood of a
few values of alpha in one aggregate, on a log scale, and keeps the interval around the best. Both are repeated until alpha settles.

Every step starts from the written vectors and the last coefficients, so no plan grows with the steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.session import write_through

#: Dispersions looked at: below the first a count is as good as Poisson.
LEAST, MOST = 1e-6, 1e3
#: Margins are held here, so that no mean overflows while coefficients settle.
WIDEST = 30.0
# Coefficients of the asymptotic series of the log-gamma function, 1/12, -1/360, 1/1260, -1/1680, and the shift at which it is used.
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
SHIFT = 8


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x > 0, to about 1e-10: the asymptotic series at x + 8, less the logs of the factors up to it."""
    z = x + SHIFT
    factors = F.log(x)
    for k in range(1, SHIFT):
        factors = factors + F.log(x + k)
    series = sum((F.lit(c) / F.pow(z, F.lit(2 * k + 1)) for k, c in enumerate(SERIES)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - factors


def log_likelihood(y: Column, mu: Column, alpha: Column) -> Column:
    """Of one count, without log y!, which no parameter enters."""
    inverse = 1.0 / alpha
    return log_gamma(y + inverse) - log_gamma(inverse) + y * F.log(alpha * mu) - (y + inverse) * F.log1p(alpha * mu)


@dataclass
class NegativeBinomial:
    """Fitted model: `design` turns columns into vectors, `line` those into margins."""

    design: PipelineModel
    line: LinearRegressionModel
    alpha: float
    likelihood: float
    steps: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds pred, the expected count."""
        made = self.line.transform(self.design.transform(df))
        return made.withColumn("pred", _mean(F.col("margin"))).drop("margin", self.line.getFeaturesCol(), "label")


def fit(df: DataFrame, design: PipelineModel, label: str = "n", weight: str | None = None, ridge: float = 0.0, most: int = 25, tolerance: float = 1e-4) -> NegativeBinomial:
    """`design` is a fitted pipeline that makes the column `features`; rows without a count or with no weight do not train.

    `ridge` is a penalty on the squared standardised coefficients, for designs with redundant columns. Raises ValueError without any event.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    made = design.transform(df).select("features", F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = write_through(made.where("y IS NOT NULL AND w > 0"))
    sums = rows.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")).first()
    if not sums["mean"]:
        raise ValueError("no events to fit a count model on")
    # A first margin that follows the counts, as is usual for such fits.
    current = rows.withColumn("margin", F.log((F.col("y") + sums["mean"]) / 2))
    alpha, line, steps, likelihood = 0.0, None, 0, -math.inf
    solver = LinearRegression(
        featuresCol="features", labelCol="working", weightCol="curvature", predictionCol="margin", solver="normal", regParam=ridge, elasticNetParam=0.0
    )
    # Poisson coefficients first, then alpha and the coefficients that belong to it in turn.
    for _ in range(most):
        before = alpha
        for _ in range(most):
            line_before, line = line, solver.fit(_working(current, alpha))
            steps += 1
            current = line.transform(rows)
            if line_before is not None and _moved(line_before, line) < tolerance:
                break
        alpha, likelihood = _dispersion(current, tolerance, near=before)
        if abs(alpha - before) <= 10 * tolerance * max(alpha, LEAST):
            break
    return NegativeBinomial(design, line, alpha, likelihood, steps)


def _mean(margin: Column) -> Column:
    return F.exp(F.least(F.greatest(margin, F.lit(-WIDEST)), F.lit(WIDEST)))


def _working(rows: DataFrame, alpha: float) -> DataFrame:
    """Working response and weight of a least-squares step."""
    mu = _mean(F.col("margin"))
    return rows.select("features", (F.log(mu) + (F.col("y") - mu) / mu).alias("working"), (F.col("w") * mu / (1 + alpha * mu)).alias("curvature"))


def _moved(a: LinearRegressionModel, b: LinearRegressionModel) -> float:
    """Largest change of a coefficient."""
    pairs = zip([a.intercept, *a.coefficients], [b.intercept, *b.coefficients])
    return max(abs(x - y) for x, y in pairs)


def _dispersion(rows: DataFrame, tolerance: float, near: float, points: int = 16) -> tuple[float, float]:
    """The alpha of the largest likelihood for the given means, and that likelihood."""
    low, high = math.log(LEAST), math.log(MOST)
    if near > LEAST:
        # Later rounds look around the last value first; an interval that does not hold the best is widened again.
        low, high = max(low, math.log(near) - 0.2), min(high, math.log(near) + 0.2)
    held = rows.select("y", "w", _mean(F.col("margin")).alias("mu"))
    best, value = near, -math.inf
    while high - low > tolerance:
        grid = [low + (high - low) * k / points for k in range(points + 1)]
        each = held.select("y", "mu", "w", F.posexplode(F.array(*[F.lit(math.exp(g)) for g in grid])).alias("k", "alpha"))
        sums = each.groupBy("k").agg(F.sum(F.col("w") * log_likelihood(F.col("y"), F.col("mu"), F.col("alpha"))).alias("v")).collect()
        top = max(sums, key=lambda r: (r["v"], -r["k"]))
        best, value = math.exp(grid[top["k"]]), top["v"]
        gap = (high - low) / points
        if top["k"] in (0, points) and math.log(LEAST) < grid[top["k"]] < math.log(MOST):
            low, high = max(math.log(LEAST), grid[top["k"]] - 8 * gap * points), min(math.log(MOST), grid[top["k"]] + 8 * gap * points)
        else:
            low, high = max(low, grid[top["k"]] - gap), min(high, grid[top["k"]] + gap)
    return best, value
