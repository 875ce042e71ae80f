"""Inputs that must be refused, and dimensions beyond earlier limits."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tripweave.operators import cells, folds, models, network
from tripweave.sources import boundary


def test_grid_of_another_alignment_is_refused(spark):
    from tripweave.functions import geohash as gh

    grid = spark.range(40).select((757152 + 3 * F.col("id")).alias("i"), (863040 + 3 * F.col("id")).alias("j"))
    ids = grid.select(gh.encode(F.col("i"), F.col("j")).alias("block_id"))
    shares = [cells.block_corner_share(ids, 8, 3, 3).first()["corner_share"], cells.block_corner_share(ids, 8, 7, 7).first()["corner_share"]]
    assert min(shares) < 0.9
    with pytest.raises(ValueError, match="block"):
        cells.check_grid(ids, 8, 7, 7)


def test_rollup_without_any_member_is_refused(spark):
    table = spark.createDataFrame([("x", date(2024, 1, 1), 0, 1.0)], "block_id string, date date, slot int, pred double")
    members = spark.createDataFrame([("gp", "g", "a"), ("arc", "1", "x")], "kind string, id string, cell string")
    with pytest.raises(ValueError, match="no cell"):
        network.rollup(table, members.where("cell = 'a'"), ["pred"])
    arcs = spark.createDataFrame([(1, "g", "h")], "arc_id long, from_gp string, to_gp string")
    rows = network.rollup(table, members, ["pred"], arcs).collect()
    assert [(r["kind"], r["from_gp"], r["to_gp"], r["pred_total"]) for r in rows] == [("arc", "g", "h", 1.0)]


@pytest.fixture(scope="module")
def many_cells(spark):
    """150 cells, more than the bins that trees start with."""
    data = [
        (f"c{c}", date(2026, 3, 2) + timedelta(days=d), h, (c % 7) * (h + 1), d % 7, 0, 1.0, 1.0, 1.0, 1.0) for c in range(150) for d in range(6) for h in range(2)
    ]
    return spark.createDataFrame(data, "cell string, date date, hour int, n int, dow int, is_weekend int, lag1 double, lag24 double, lag168 double, lag1_ma3 double")


@pytest.mark.parametrize("categorical", [(), ("cell",)])
def test_trees_take_any_number_of_cells(many_cells, categorical):
    found = folds.folds(many_cells, 2, "walk_forward")
    preds = models.walk_forward(many_cells, found, models.boosted_fit_predict(["hour", "cell_prior"], categorical, rounds=2, depth=2))
    assert preds.count() == many_cells.count() // 2


def test_glm_has_no_column_per_cell(many_cells):
    model = models.glm("poisson").fit(models.glm_columns(models.with_cell_prior(many_cells, many_cells)))
    assert model.stages[-1].numFeatures < 30


def test_the_level_of_trees_is_the_mean(many_cells):
    found = folds.folds(many_cells, 2, "walk_forward")
    train = found[0].train(many_cells)
    preds = models.boosted_fit_predict(["hour", "cell_prior"], rounds=3, depth=3)(train, train)
    sums = preds.agg(F.sum("n"), F.sum("pred")).first()
    assert sums[1] == pytest.approx(sums[0])


def test_boundary_limit_is_the_callers(spark):
    by_lon = spark.range(50).select((F.col("id") / 100).alias("lon"), F.lit(1.0).alias("min_lat"), F.lit(2.0).alias("max_lat"))
    assert len(boundary.ring_from_scanlines(by_lon)) == 100
    with pytest.raises(ValueError):
        boundary.ring_from_scanlines(by_lon, max_vertices=99)
