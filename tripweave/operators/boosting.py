"""Newton boosting on the Poisson loss, out of MLlib's regression trees.

With mu = exp(margin), the loss of a row is mu - y * margin, its gradient mu - y and its curvature mu. A regression tree on the
target (y - mu) / mu with the row weight w * mu splits where the second-order gain is largest, and the weighted mean of a leaf,
sum w (y - mu) / sum w mu, is that leaf's Newton step. So each round is one weighted tree, and the sum of the trees, each times the
learning rate, is kept as one MLlib ensemble that saves, loads and predicts as such. The margin is a column, written every few rounds, so
that no plan grows with the rounds.

The curvature is held above a share of the mean count: a leaf of rows with next to no expected events cannot take a step that
overshoots, however many events one of them has.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.operators import binned
from tripweave.session import write_through

#: Rounds between two written margins.
WRITTEN_EVERY = 4
#: Rounds from which on the columns are cut into bins once for all of them, see binned.
BINNED_FROM = 50


@dataclass
class CountTrees:
    """Fitted trees: `stages` turn columns into margins without the intercept."""

    stages: PipelineModel
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds pred, the expected count."""
        made = self.stages.transform(df).withColumn("pred", F.exp(F.col("margin") + self.intercept))
        return made.drop("features", "margin", *[s.getOutputCol() for s in self.stages.stages if hasattr(s, "labels")])


@dataclass
class Assembled:
    """Training rows as vectors, written once: any number of fits with different parameters read the same table."""

    table: DataFrame
    stages: list
    width: int
    mean: float


def assemble(df: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "n", weight: str | None = None) -> Assembled:
    """Vectors, counts and weights of the rows that train; rows without a count or with no weight do not."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_code", handleInvalid="keep").fit(df) for c in categorical]
    vectors = VectorAssembler(inputCols=[f"{c}_code" for c in categorical] + list(numeric), outputCol="features", handleInvalid="keep")
    ready = PipelineModel([*indexers, vectors]).transform(df)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ready = write_through(ready.select("features", F.col(label).cast("double").alias("y"), w.alias("w")).where("y IS NOT NULL AND w > 0"))
    sums = ready.agg(F.sum(F.col("w") * F.col("y")).alias("events"), F.sum("w").alias("rows")).first()
    mean = (sums["events"] or 0.0) / sums["rows"] if sums["rows"] else 0.0
    return Assembled(ready, [*indexers, vectors], len(categorical) + len(numeric), mean)


def fit(
    df: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "n", weight: str | None = None, **options
) -> CountTrees:
    """Trees for a non-negative count. Numeric columns must not be null; categories keep the training set's codes, with one for unseen values.

    The options are those of grow(). Without rows, or without any event, the expected count is next to nothing everywhere.
    """
    return grow(assemble(df, numeric, categorical, label, weight), **options)


def grow(
    rows: Assembled, depth: int = 5, rounds: int = 20, step: float = 0.1, bins: int = 64, least_rows: int = 1, share: float = 1.0, floor: float = 0.05, seed: int = 0
) -> CountTrees:
    """Trees on assembled rows. Each round takes a share of the rows, drawn by a hash of features and count.

    Fits of BINNED_FROM rounds or more cut the columns into bins once (binned), shorter ones let each tree choose its own.
    """
    spark, mean = rows.table.sparkSession, rows.mean
    intercept = math.log(max(mean, 1e-9))
    if rounds >= BINNED_FROM and mean > 0 and rows.width:
        made, cuts = binned.grow(rows.table, rows.width, rounds, bins, binned.Options(depth, step, least_rows, share, floor * mean, seed, intercept))
        last = _ensemble(spark, _mllib_trees(spark, made, cuts), step)
        return CountTrees(PipelineModel([*rows.stages, last]), intercept)
    trees = []
    work = rows.table.withColumn("margin", F.lit(0.0))
    for k in range(rounds if mean > 0 else 0):
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="target", weightCol="curvature", predictionCol="part", maxDepth=depth, maxBins=bins, minInstancesPerNode=least_rows, seed=seed
        ).fit(_with_target(work, intercept, floor * mean, share, seed + k))
        trees.append(tree)
        work = tree.transform(work).select("features", "y", "w", (F.col("margin") + step * F.col("part")).alias("margin"))
        if (k + 1) % WRITTEN_EVERY == 0:
            work = write_through(work)
    last = _ensemble(spark, [t._java_obj for t in trees], step) if trees else _ensemble(spark, [_flat_tree(spark, rows.width)._java_obj], 0.0)
    return CountTrees(PipelineModel([*rows.stages, last]), intercept)


def _with_target(work: DataFrame, intercept: float, least: float, share: float, seed: int) -> DataFrame:
    """The rows of a round with their Newton target and curvature."""
    mu = F.exp(F.col("margin") + intercept)
    held = F.greatest(mu, F.lit(least))
    drawn: Column = F.lit(True) if share >= 1 else F.pmod(F.xxhash64("features_text", "y", F.lit(seed)), F.lit(1000)) < int(1000 * share)
    rows = work if share >= 1 else work.withColumn("features_text", F.col("features").cast("string"))
    return rows.where(drawn).select("features", ((F.col("y") - mu) / held).alias("target"), (F.col("w") * held).alias("curvature"))


def _flat_tree(spark, width: int):
    """A tree without a split, for training rows that have no event."""
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense([0.0] * width), 0.0)], ["features", "target"])
    return DecisionTreeRegressor(featuresCol="features", labelCol="target", predictionCol="part").fit(rows)


def _mllib_trees(spark, trees: list[binned.Tree], cuts: list) -> list:
    """Trees of binned as MLlib's models in the JVM. Impurities and gains are left at zero: only splits and leaves are known."""
    context = spark.sparkContext
    jvm = context._jvm
    leaf, inner, split = (getattr(jvm.org.apache.spark.ml.tree, n) for n in ("LeafNode", "InternalNode", "ContinuousSplit"))
    model = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(context._gateway.new_array(jvm.double, 3), 0)
    models = []
    for tree in trees:
        made = [None] * len(tree.left)
        for i in reversed(range(len(made))):  # children come after their parent
            left, column = tree.left[i], tree.column[i]
            if left < 0:
                made[i] = leaf(tree.value[i], 0.0, stats)
            else:
                made[i] = inner(tree.value[i], 0.0, 0.0, made[left], made[left + 1], split(column, float(cuts[column][tree.code[i]])), stats)
        models.append(model(f"counttree_{uuid.uuid4().hex[:12]}", made[0], len(cuts)))
    return models


def _ensemble(spark, trees: list, step: float) -> GBTRegressionModel:
    """The weighted sum of regression trees of the JVM as MLlib's own model of that form."""
    context = spark.sparkContext
    jvm = context._jvm
    held = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        held[i], weights[i] = tree, float(step)
    made = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"counttrees_{trees[0].uid()}", held, weights))
    made.setFeaturesCol("features")
    made.setPredictionCol("margin")
    return made
