"""Count models fitted walk-forward, saved and reloaded."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.operators import boosting, negative_binomial
from tripweave.operators.folds import Fold
from tripweave.operators.joins import member_of
from tripweave.operators.scoring import measures
from tripweave.session import side_by_side, write_through

# What a missing reading becomes for a tree; outside every feature's range.
MISSING = -999.0
LAG_FEATURES = ["lag1", "lag24", "lag168", "lag1_ma3", "cell_prior"]


def with_cell_prior(train: DataFrame, other: DataFrame, value: str = "n") -> DataFrame:
    """Mean of each cell over the training days; unseen cells get the mean of the cell means."""
    prior = train.groupBy("cell").agg(F.avg(value).alias("cell_prior"))
    overall = prior.agg(F.avg("cell_prior")).scalar()
    joined = other.join(prior, "cell", "left").withColumn("_overall", overall)
    return joined.withColumn("cell_prior", F.coalesce("cell_prior", "_overall")).drop("_overall")


def seasonal_naive(train: DataFrame, other: DataFrame, keys: list[str], coarse: list[str], value: str = "n") -> DataFrame:
    """Mean of the same keys over the training rows, then of the coarse keys, then overall."""
    fine = train.groupBy(*keys).agg(F.avg(value).alias("_fine"))
    wide = train.groupBy(*coarse).agg(F.avg(value).alias("_wide"))
    overall = train.agg(F.avg(value)).scalar()
    joined = other.join(fine, keys, "left").join(wide, coarse, "left").withColumn("_all", overall)
    return joined.withColumn("pred", F.coalesce("_fine", "_wide", "_all")).drop("_fine", "_wide", "_all")


def seasonal_naive_walk(blocked: DataFrame, keys: list[str], coarse: list[str], value: str = "n") -> DataFrame:
    """Seasonal naive predictions of every fold at once.

    `blocked` is a panel with a `block` column, block k >= 1 being validated on all earlier blocks. Sums
    and counts are taken per block and accumulated over the few blocks before, instead of one pass
    over the panel for every fold.
    """

    def before(group: list[str], name: str) -> DataFrame:
        sums = blocked.groupBy(*group, "block").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
        past = W.partitionBy(*group).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        return sums.select(*group, "block", (F.sum("_s").over(past) / F.sum("_c").over(past)).alias(name))

    fine, wide, overall = before(keys, "_fine"), before(coarse, "_wide"), before([], "_all")
    valid = blocked.where("block >= 1")
    joined = valid.join(fine, [*keys, "block"], "left").join(wide, [*coarse, "block"], "left")
    # One row per block.
    joined = joined.join(F.broadcast(overall), "block", "left")
    out = joined.withColumn("pred", F.coalesce("_fine", "_wide", "_all")).drop("_fine", "_wide", "_all")
    return out.withColumnRenamed("block", "fold")


# ---- model families ---------------------------------------------------------


def glm(family: str, label: str = "n", numeric: list[str] = LAG_FEATURES, power: float = 1.4) -> Pipeline:
    """Log-link count GLM on hour and weekday effects, the cell's level and numeric columns.

    family="poisson", or "tweedie" whose variance grows as mean^power, for over-dispersed counts. A cell enters by the log
    of its training mean, one column however many cells there are: the solver's normal equations take 4,096 at most.
    """
    # Indexing text makes hour and weekday categories; an unseen one gets the reference level.
    formula = RFormula(
        formula=f"{label} ~ hour_text + dow_text + cell_level + " + " + ".join(numeric),
        handleInvalid="keep", featuresCol="features", labelCol="label",
    )
    shape = {"variancePower": power, "linkPower": 0.0} if family == "tweedie" else {"link": "log"}
    model = GeneralizedLinearRegression(
        family=family, featuresCol="features", labelCol="label", predictionCol="pred", maxIter=50, regParam=1e-3, **shape
    )
    return Pipeline(stages=[formula, model])


def glm_columns(df: DataFrame) -> DataFrame:
    level = F.log(F.greatest(F.col("cell_prior"), F.lit(0.01)))
    return df.withColumns({"hour_text": F.col("hour").cast("string"), "dow_text": F.col("dow").cast("string"), "cell_level": level})


def pearson_dispersion(model: PipelineModel) -> float:
    """Pearson chi-square over residual degrees of freedom; above 1 means over-dispersed."""
    return float(model.stages[-1].summary.dispersion)


def boosted(
    numeric: list[str], categorical: list[str] = (), label: str = "n", weight: str | None = None, depth: int = 5, rounds: int = 20, step: float = 0.1, bins: int = 64
) -> Pipeline:
    """Gradient-boosted trees on log1p of the count; categories keep the training set's codes.

    The squared loss is taken on the log scale and level_factor() brings the mean back; boosting.fit has the Poisson loss. `bins` has to be at least the number of values of the largest category, see category_bins().
    """
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep") for c in categorical]
    columns = [f"{c}_code" for c in categorical] + list(numeric)
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    trees = GBTRegressor(
        featuresCol="features", labelCol="log_label", predictionCol="log_pred", maxDepth=depth, maxIter=rounds,
        stepSize=step, maxBins=bins, seed=0, **({"weightCol": weight} if weight else {}),
    )
    return Pipeline(stages=[*indexers, assemble, trees])


def boosted_columns(df: DataFrame, numeric: list[str], label: str | None = None) -> DataFrame:
    """Missing readings made explicit, numbers as doubles, and the log label for fitting."""
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in numeric})
    return df if label is None else df.withColumn("log_label", F.log1p(F.col(label).cast("double")))


def category_bins(df: DataFrame, categorical: list[str], least: int = 64) -> int:
    """Bins that hold every value of each category and the code for unseen ones; one pass."""
    if not categorical:
        return least
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in categorical]).first()
    return max(least, *[n + 1 for n in counts])


def boosted_predictions(model: PipelineModel, df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Predicted counts, never negative, times the factor that level_factor() found on the training rows."""
    return model.transform(df).withColumn("pred", F.greatest(F.expm1("log_pred"), F.lit(0.0)) * F.lit(float(factor)))


def level_factor(model: PipelineModel, prepared: DataFrame, label: str, weight: str | None = None) -> float:
    """Observed over predicted total of the training rows: exp of a mean of logs lies below the mean."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = boosted_predictions(model, prepared).agg(F.sum(w * F.col(label)).alias("seen"), F.sum(w * F.col("pred")).alias("made")).first()
    return float(sums["seen"] / sums["made"]) if sums["made"] else 1.0


# ---- walk-forward -----------------------------------------------------------

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def walk_forward(panel: DataFrame, found: list[Fold], fit_predict: FitPredict) -> DataFrame:
    """Fit on each fold's past, predict its days, and stack the predictions with their fold. The fits of the folds run side by side."""
    parts = side_by_side(panel.sparkSession, [lambda f=f: fit_predict(f.train(panel), f.valid(panel)).withColumn("fold", F.lit(f.number)) for f in found])
    return reduce(DataFrame.unionByName, parts)


def glm_fit_predict(family: str) -> FitPredict:
    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        prepared = glm_columns(with_cell_prior(train, train)).persist()
        try:
            model = glm(family).fit(prepared)
        finally:
            prepared.unpersist()
        return model.transform(glm_columns(with_cell_prior(train, valid)))

    return run


def negative_binomial_fit_predict(ridge: float = 1e-6, **options) -> FitPredict:
    """The columns of glm() with a dispersion estimated beside the coefficients."""

    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        prepared = glm_columns(with_cell_prior(train, train)).persist()
        try:
            design = Pipeline(stages=glm("poisson").getStages()[:1]).fit(prepared)
            model = negative_binomial.fit(prepared, design, "n", ridge=ridge, **options)
        finally:
            prepared.unpersist()
        return model.transform(glm_columns(with_cell_prior(train, valid))).withColumn("alpha", F.lit(model.alpha))

    return run


def boosted_fit_predict(numeric: list[str], categorical: list[str] = (), **options) -> FitPredict:
    """Trees on numeric columns, among them the cell's training mean, and on categories where they are wanted, for the squared
    loss of log counts. poisson_fit_predict is the same for the count's own loss."""

    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        prepared = boosted_columns(with_cell_prior(train, train), numeric, "n").persist()
        try:
            model = boosted(numeric, list(categorical), bins=category_bins(prepared, list(categorical)), **options).fit(prepared)
            factor = level_factor(model, prepared, "n")
        finally:
            prepared.unpersist()
        return boosted_predictions(model, boosted_columns(with_cell_prior(train, valid), numeric), factor)

    return run


def poisson_fit_predict(numeric: list[str], categorical: list[str] = (), **options) -> FitPredict:
    """Trees fitted on the Poisson loss, see boosting."""

    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        prepared = boosted_columns(with_cell_prior(train, train), numeric)
        bins = category_bins(prepared, list(categorical))
        model = boosting.fit(prepared, list(numeric), list(categorical), "n", bins=bins, **options)
        return model.transform(boosted_columns(with_cell_prior(train, valid), numeric))

    return run


@dataclass(frozen=True)
class Rows:
    """Which rows train, what they weigh and which count toward the score.

    train_units and train_slots choose the training rows; score_units and score_slots the scored ones. Training rows that
    are not scored weigh `off_target`, and a positive `group_weight` gives that share of the weight to the units of `group`
    (a frame of block_id). Nothing given: every row trains, weighs one and is scored.
    """

    train_units: DataFrame | None = None
    train_slots: object = "all"
    score_units: DataFrame | None = None
    score_slots: object = "all"
    off_target: float = 1.0
    group: DataFrame | None = None
    group_weight: float = 0.0

    def mark(self, df: DataFrame) -> DataFrame:
        """Columns scored and in_group of each row."""
        from tripweave.operators import features

        units = df.select("block_id").distinct() if self.score_units is None else self.score_units
        marked = features.with_score_mask(df, units, self.score_slots)
        if self.group is None:
            return marked.withColumn("in_group", F.lit(False))
        return member_of(marked, "block_id", self.group.select("block_id"), "in_group")

    def training(self, df: DataFrame) -> DataFrame:
        """The training rows with their weight."""
        from tripweave.operators import features

        kept = features.keep_slots(df, self.train_slots)
        if self.train_units is not None:
            kept = kept.join(self.train_units.select("block_id").distinct(), "block_id", "left_semi")
        group = None if self.group is None else "in_group"
        return features.with_row_weights(self.mark(kept), self.off_target, group, self.group_weight).drop("scored", "in_group")


@dataclass
class FoldTables:
    """What all fits on one fold share: assembled training rows, and the validation rows with their features, written."""

    rows: boosting.Assembled
    valid: DataFrame
    target: str

    def predictions(self, **options) -> DataFrame:
        """Predictions of trees with these options; they say which rows are scored and which are in the group."""
        made = boosting.grow(self.rows, **options).transform(self.valid)
        return made.select("block_id", "date", "slot", "scored", "in_group", F.col(self.target).alias("actual"), F.col("pred").alias("pred_raw"))


def fold_tables(train: DataFrame, valid: DataFrame, blocks: list, target: str, rows: Rows = Rows(), written: bool = True) -> FoldTables:
    """Feature blocks and row weights fitted on the training rows, both sides transformed; `written` where several fits follow."""
    from tripweave.operators.features import FeatureSet

    chosen = rows.training(train)
    features = FeatureSet(blocks).fit(chosen.drop("weight"))
    numeric = features.columns
    assembled = boosting.assemble(boosted_columns(features.transform_keeping(chosen), numeric), numeric, (), target, "weight")
    later = boosted_columns(features.transform_keeping(rows.mark(valid)), numeric)
    return FoldTables(assembled, write_through(later) if written else later, target)


class SharedFolds:
    """The tables of each fold for runs that differ in the options of their trees only: made by the first run that asks, then read."""

    def __init__(self):
        self.held: list[tuple[DataFrame, DataFrame, FoldTables]] = []

    def tables(self, train: DataFrame, valid: DataFrame, make: Callable[[], FoldTables]) -> FoldTables:
        for of_train, of_valid, tables in list(self.held):
            if train.sameSemantics(of_train) and valid.sameSemantics(of_valid):
                return tables
        made = make()
        self.held.append((train, valid, made))
        return made


def feature_fit_predict(blocks: Callable[[], list], target: str, rows: Rows = Rows(), shared: SharedFolds | None = None, **options) -> FitPredict:
    """Feature blocks fitted on the training rows, weighted trees for the Poisson loss on their columns; predictions say which rows
    are scored and which are in the group. Runs with equal blocks, target and rows may have their fold tables in common, see SharedFolds."""

    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        if shared is None:
            return fold_tables(train, valid, blocks(), target, rows, written=False).predictions(**options)
        return shared.tables(train, valid, lambda: fold_tables(train, valid, blocks(), target, rows)).predictions(**options)

    return run


def run_loss(preds: DataFrame, gamma: float | None = None) -> DataFrame:
    """One row with the loss of the scored rows: the mean deviance, or with a gamma the blend of group and others."""
    from tripweave.operators import scoring

    losses = scoring.group_losses(preds.where("scored").withColumnRenamed("pred_raw", "pred"), "in_group")
    return scoring.blend(losses, [0.0 if gamma is None else gamma], "off" if gamma is None else "group_mean").select("loss")


def ablation(panel: DataFrame, found: list[Fold], blocks: Callable[[], list], target: str, keys: Iterable[str] = (), **options) -> DataFrame:
    """Score over all folds, or for each value of the keys (fold), with every block, then without each of them."""
    names = [b.name for b in blocks()]
    parts = []
    for dropped in [None, *names]:
        kept = lambda d=dropped: [b for b in blocks() if b.name != d]
        preds = walk_forward(panel, found, feature_fit_predict(kept, target, **options))
        row = preds.groupBy(*keys).agg(*measures("actual", "pred_raw")).withColumn("dropped", F.lit(dropped or "none"))
        parts.append(row)
    return reduce(DataFrame.unionByName, parts)


def search(panel: DataFrame, found: list[Fold], make: Callable[..., FitPredict], grid: dict[str, Iterable], score: Callable[[DataFrame], DataFrame], by_fold: bool = False) -> DataFrame:
    """Score of every parameter combination over all folds; `score` reduces predictions to one row with `loss`. With by_fold
    the column fold holds null for all folds together, and there is a row for each fold too.

    `make` gets the combination and returns what a run with it would use, rows and weights included.
    """
    names = sorted(grid)
    parts = []
    for values in product(*[list(grid[n]) for n in names]):
        chosen = dict(zip(names, values))
        preds = walk_forward(panel, found, make(**chosen))
        if by_fold:  # read once for each fold and once for all
            preds = write_through(preds)
        key = [F.lit(chosen[n]).alias(n) for n in names]
        if by_fold:
            parts.append(score(preds).select(*key, F.lit(None).cast("int").alias("fold"), "loss"))
            parts += [score(preds.where(F.col("fold") == f.number)).select(*key, F.lit(f.number).alias("fold"), "loss") for f in found]
        else:
            parts.append(score(preds).select(*key, "loss"))
    return reduce(DataFrame.unionByName, parts)


def training_comparison(panel: DataFrame, found: list[Fold], drop_from_training, fit_predict: FitPredict) -> DataFrame:
    """Identical folds with and without some training rows; both arms predict the same days."""

    def leaner(train: DataFrame, valid: DataFrame) -> DataFrame:
        return fit_predict(train.where(~drop_from_training), valid)

    full = walk_forward(panel, found, fit_predict).withColumn("arm", F.lit("all"))
    return full.unionByName(walk_forward(panel, found, leaner).withColumn("arm", F.lit("dropped")))
