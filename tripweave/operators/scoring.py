"""Scores of count forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.operators.ranking import average_rank_correlation, exact_quantiles

MIN_MU = 1e-9


def poisson_deviance(actual: str, pred: str) -> Column:
    """Poisson deviance of one row; a zero count contributes only its mean."""
    y, mu = F.col(actual).cast("double"), F.greatest(F.col(pred), F.lit(MIN_MU))
    return 2.0 * (F.when(y > 0, y * F.ln(y / mu)).otherwise(0.0) - (y - mu))


def measures(actual: str = "actual", pred: str = "pred") -> list[Column]:
    """The aggregates every score table shares."""
    error = F.col(pred) - F.col(actual)
    return [
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(poisson_deviance(actual, pred)).alias("poisson_deviance"),
        F.sum(F.col(pred).cast("double")).alias("pred_sum"),
        F.sum(F.col(actual).cast("double")).alias("obs_sum"),
        F.try_divide(F.sum(F.col(pred).cast("double")), F.sum(F.col(actual).cast("double"))).alias("calibration"),
        F.avg(error).alias("bias"),
        F.max(F.col(pred).cast("double")).alias("pred_max"),
    ]


def score(preds: DataFrame, by: list[str] = (), actual: str = "actual", pred: str = "pred") -> DataFrame:
    return preds.groupBy(*by).agg(*measures(actual, pred))


def score_sets(preds: DataFrame, sets: list[list[str]], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Pooled and per-dimension scores in one pass with grouping sets; `level` names the set."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])
    grouped = preds.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims])
    out = grouped.agg(level.alias("level"), *measures(actual, pred))
    return out.withColumn("level", F.when(F.col("level") == "", "all").otherwise(F.col("level")))


def prediction_tail(preds: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
    """99.9th percentile of the predictions, exact at any size."""
    return exact_quantiles(preds, pred, {"pred_p999": 0.999}, by)


def count_band(actual: Column) -> Column:
    """Eight bands of observed counts."""
    # Upper ends of the bands.
    tops = [0, 1, 2, 5, 10, 20, 50]
    label = F.lit("51+")
    for low, high in reversed(list(zip([None] + tops[:-1], tops))):
        name = str(high) if low is None or high == low + 1 else f"{low + 1}-{high}"
        label = F.when(actual <= high, name).otherwise(label)
    return label


def mean_residuals(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("pred") - F.col("actual")).alias("mean_residual"))


def error_by_hour(preds: DataFrame, hour: str = "hour") -> DataFrame:
    """Quartiles of the absolute error per hour; every group is an hour's share of all rows."""
    errors = preds.select(F.col(hour).alias("hour"), F.abs(F.col("pred") - F.col("actual")).alias("err"))
    quartiles = exact_quantiles(errors, "err", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["hour"])
    means = errors.groupBy("hour").agg(F.count("*").alias("n"), F.avg("err").alias("mean_err"))
    # One row per hour of the day.
    return means.join(F.broadcast(quartiles), "hour")


def residual_volume_correlation(preds: DataFrame, volume: DataFrame, key: str) -> DataFrame:
    """Rank correlation of a place's mean residual with its volume."""
    joined = mean_residuals(preds, [key]).join(volume, key)
    return average_rank_correlation(joined, "mean_residual", [c for c in volume.columns if c != key][0])


def extreme_errors(preds: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Largest over- and under-predictions; each task keeps n rows."""
    errors = preds.withColumn("error", F.col("pred") - F.col("actual"))
    over = errors.orderBy(F.desc("error"), *keys).limit(n).withColumn("kind", F.lit("over"))
    under = errors.orderBy("error", *keys).limit(n).withColumn("kind", F.lit("under"))
    return over.unionByName(under)


# ---- two groups of rows ------------------------------------------------------


def group_losses(preds: DataFrame, group: str, by: list[str] = (), pred: str = "pred") -> DataFrame:
    """Mean deviance of the rows in and out of a group, and overall."""
    row = poisson_deviance("actual", pred)
    return preds.groupBy(*by).agg(
        F.avg(F.when(F.col(group), row)).alias("loss_group"),
        F.avg(F.when(~F.col(group), row)).alias("loss_other"),
        F.avg(row).alias("loss_all"),
        F.count_if(F.col(group)).alias("n_group"),
        F.count_if(~F.col(group)).alias("n_other"),
    )


def blend(losses: DataFrame, gammas: list[float], mode: str = "group_mean") -> DataFrame:
    """Blend the two group means for each gamma; nothing is refitted or rescanned.

    group_mean: gamma and 1 - gamma on the means, or the overall mean if a group is empty.
    row_weighted: each row weighs gamma or 1 - gamma. off: the overall mean, once and without a gamma.
    """
    if mode not in ("group_mean", "row_weighted", "off") or not all(0 <= g <= 1 for g in gammas):
        raise ValueError("mode is group_mean, row_weighted or off, and gamma lies in [0, 1]")
    if mode == "off":
        return losses.withColumns({"gamma": F.lit(None).cast("double"), "loss": F.col("loss_all"), "mode": F.lit("off")})
    swept = losses.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    g, own, rest = F.col("gamma"), F.col("loss_group"), F.col("loss_other")
    empty = (F.col("n_group") == 0) | (F.col("n_other") == 0)
    if mode == "row_weighted":
        in_weight, out_weight = g * F.col("n_group"), (1 - g) * F.col("n_other")
        weighted = F.coalesce(own, F.lit(0.0)) * in_weight + F.coalesce(rest, F.lit(0.0)) * out_weight
        loss, label = F.try_divide(weighted, in_weight + out_weight), F.lit("row_weighted")
    else:
        loss = F.when(empty, F.col("loss_all")).otherwise(g * own + (1 - g) * rest)
        label = F.when(empty, "group_mean_empty").otherwise("group_mean")
    return swept.withColumns({"loss": loss, "mode": label})


# ---- calibration -------------------------------------------------------------


def forward_factors(preds: DataFrame, compound: bool = False) -> DataFrame:
    """Level factor of each fold, from the fold before it only; one row per fold.

    The factor is observed over raw predicted. With `compound` the fold before is taken as already
    corrected by its own factor.
    """
    sums = preds.groupBy("fold").agg(
        F.sum(F.col("actual").cast("double")).alias("obs"), F.sum("pred_raw").alias("raw")
    )
    if not compound:
        ratio = F.when(F.col("raw") > 0, F.col("obs") / F.col("raw"))
        # A fold that predicts nothing leaves the factor as it was.
        earlier = W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
        return sums.select("fold", F.coalesce(F.last(ratio, ignorenulls=True).over(earlier), F.lit(1.0)).alias("factor"))
    ordered = sums.agg(F.sort_array(F.collect_list(F.struct("fold", "obs", "raw"))).alias("folds"))
    start = F.struct(F.lit(1.0).alias("next"), F.array().cast("array<struct<fold:int,factor:double>>").alias("out"))

    def step(state: Column, fold: Column) -> Column:
        corrected = fold["raw"] * state["next"]
        now = F.struct(fold["fold"].cast("int").alias("fold"), state["next"].alias("factor"))
        return F.struct(
            F.when(corrected > 0, fold["obs"] / corrected).otherwise(state["next"]).alias("next"),
            F.array_append(state["out"], now).alias("out"),
        )

    return ordered.select(F.inline(F.aggregate("folds", start, step)["out"]))


def calibrate(preds: DataFrame, compound: bool = False) -> DataFrame:
    """Add `factor` and the calibrated `pred` to raw fold predictions."""
    # One row per fold.
    factors = F.broadcast(forward_factors(preds, compound))
    return preds.join(factors, "fold").withColumn("pred", F.col("pred_raw") * F.col("factor"))


# ---- against simple floors ---------------------------------------------------


def compare_same_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Score two models on the rows both predicted."""
    both = left.select(*keys, "actual", F.col("pred").alias("pred_a")).join(
        right.select(*keys, F.col("pred").alias("pred_b")), keys
    )
    return both.agg(
        F.count("*").alias("n"),
        F.avg(poisson_deviance("actual", "pred_a")).alias("deviance_a"),
        F.avg(poisson_deviance("actual", "pred_b")).alias("deviance_b"),
    ).withColumn("change_pct", 100.0 * F.try_divide(F.col("deviance_b") - F.col("deviance_a"), F.col("deviance_a")))


def against_entity_mean(entities: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Deviance against predicting each entity's own training mean, with the median relative error."""
    joined = entities.join(means.withColumnRenamed("mean", "pred_mean"), keys)
    scores = joined.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.avg(poisson_deviance("actual", "pred")).alias("deviance"),
        F.avg(poisson_deviance("actual", "pred_mean")).alias("deviance_mean"),
    )
    relative = joined.where("actual > 0").withColumn("ape", F.abs(F.col("pred") - F.col("actual")) / F.col("actual"))
    middle = exact_quantiles(relative, "ape", {"median_ape": 0.5}, ["kind"])
    return scores.join(middle, "kind", "left").withColumn(
        "improvement_pct", 100.0 * F.try_divide(F.col("deviance_mean") - F.col("deviance"), F.col("deviance_mean"))
    )


def gap_shares(preds: DataFrame, by: list[str]) -> DataFrame:
    """Where the absolute error comes from: share of the total gap per group."""
    gaps = preds.groupBy(*by).agg(F.sum(F.abs(F.col("pred") - F.col("actual"))).alias("gap"))
    total = gaps.agg(F.sum("gap")).scalar()
    return gaps.withColumn("share_pct", 100.0 * F.try_divide(F.col("gap"), total))
