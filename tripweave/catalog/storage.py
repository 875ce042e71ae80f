"""Queries that write a table to the shared folder and read it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.catalog.base import query, raw_trips, rounded, sql_workday, trips_sql
from tripweave.catalog.cleaning import DROPS, raw_sql
from tripweave.catalog.forecast import CUT, LABELLED, TOP_UNITS, blocks, labelled, slot_rows, weather_table
from tripweave.catalog.panels import morning_panel, panel_sql
from tripweave.functions.clock import MORNING
from tripweave.operators import boosting, bundle, features, folds, models, qc, ranking, scoring, search
from tripweave.session import shared_path, side_by_side, write_through
from tripweave.sources import orders, tables


def _daily(df):
    return df.groupBy("date").agg(F.count("*").alias("n"), F.count_if("qc_same_geohash").alias("same_cell"))


@query(
    "sink_clean_trips",
    raw_sql(f"SELECT date, count(*) AS n, count(*) FILTER (qc_same_geohash) AS same_cell FROM flagged WHERE NOT ({DROPS['default']}) GROUP BY 1"),
)
def sink_clean_trips(spark, sf):
    """Clean trips by date, written under the policy's own name."""
    policy = qc.Policy()
    clean = qc.apply_policy(qc.flag_all(raw_trips(spark, sf), policy), policy)
    return _daily(orders.read_trips(spark, orders.write_trips(clean, shared_path(spark, "trips"), policy)))


@query(
    "sink_flagged_trips",
    raw_sql("SELECT date, count(*) AS n, count(*) FILTER (qc_same_geohash) AS same_cell FROM flagged GROUP BY 1"),
)
def sink_flagged_trips(spark, sf):
    """The audit copy: every row, flags included."""
    flagged = qc.flag_all(raw_trips(spark, sf))
    return _daily(orders.read_trips(spark, orders.write_trips(flagged, shared_path(spark, "trips"), kind="flagged")))


@query(
    "source_pruned_columns",
    raw_sql("SELECT date, count(*) AS n, round(avg(minutes), 6) AS mean_min FROM flagged WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1"),
)
def source_pruned_columns(spark, sf):
    """Two columns of three days of the written trips: partitions and columns are pruned."""
    path = orders.write_trips(qc.flag_all(raw_trips(spark, sf)), shared_path(spark, "trips"), kind="flagged")
    few = orders.read_columns(spark, path, ["date", "duration_min"])
    days = few.where("date between date'2024-01-10' and date'2024-01-12'")
    return rounded(days.groupBy("date").agg(F.count("*").alias("n"), F.avg("duration_min").alias("mean_min")), "mean_min")


@query(
    "source_raw_text",
    raw_sql("SELECT count(*) AS n, count(*) FILTER (order_key = '') AS blank_keys, count(*) FILTER (t0 IS NULL) AS bad_times, count(DISTINCT g0) AS start_cells FROM raw"),
)
def source_raw_text(spark, sf):
    """Raw text written as gzip CSV and read back without type inference."""
    path = shared_path(spark, "raw")
    raw_trips(spark, sf).write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)
    raw = orders.read_raw(spark, path)
    return raw.agg(
        F.count("*").alias("n"), F.count_if(F.col("order_id") == "").alias("blank_keys"),
        F.count_if(F.col("start_time") == "bad").alias("bad_times"), F.count_distinct("start_geohash").alias("start_cells"),
    )


@query(
    "source_panel_table",
    trips_sql(f"{panel_sql(sql_workday('date'))} SELECT block_id, date, slot, departures, arrivals FROM panel"),
)
def source_panel_table(spark, sf):
    """A panel written as a run's table, read back and checked against its contract."""
    path = tables.write_run(morning_panel(spark, sf), shared_path(spark, "runs"), "morning", "panel", "date")
    panel = tables.read_panel(spark, path, MORNING.n_slots)
    return panel.select("block_id", "date", "slot", "departures", "arrivals")


@query(
    "sink_result_csv",
    trips_sql(f"{panel_sql(sql_workday('date'))} SELECT CAST(slot AS VARCHAR) AS slot, CAST(CAST(sum(departures) AS BIGINT) AS VARCHAR) AS departures FROM panel GROUP BY slot"),
)
def sink_result_csv(spark, sf):
    sums = morning_panel(spark, sf).groupBy("slot").agg(F.sum("departures").alias("departures"))
    path = tables.write_result(sums, shared_path(spark, "results"), "csv")
    return spark.read.option("header", True).csv(path)


# ---- saved models -----------------------------------------------------------

#: Trees of a saved bundle here; see README for why fewer than in a production run.
ROUNDS = 8


def saved_bundle(spark, sf, panel, until=None, target="arrivals"):
    """Blocks and trees fitted on the days before `until`, or on all days, with the run's rows and weights."""
    train = slot_rows(spark, sf, panel).training(panel if until is None else panel.where(F.col("date") < F.lit(until)))
    chain = features.FeatureSet(blocks(spark, sf, target, weather_table(spark, sf))).fit(train.drop("weight"))
    columns = chain.columns
    prepared = models.boosted_columns(chain.transform_keeping(train), columns)
    model = boosting.fit(prepared, columns, (), target, "weight", rounds=ROUNDS, depth=4)
    first_day = train.agg(F.min("date")).first()[0]
    return bundle.Bundle(model, chain, MORNING, 1.0, {"target": target, "trained_before": str(until)}, first_day)


def reloaded(spark, sf, saved, target="arrivals"):
    path = shared_path(spark, "bundles")
    saved.save(path)
    fresh = blocks(spark, sf, target)
    fresh[4] = features.Weather(None, MORNING)
    return bundle.Bundle.load(spark, path, fresh, MORNING)


@query(
    "model_reload",
    trips_sql(
        f"""{LABELLED} SELECT target, count(*) AS n, CAST(0 AS BIGINT) AS unmatched, CAST(0 AS DOUBLE) AS max_difference
FROM panel, (VALUES ('arrivals'), ('departures')) AS t(target) GROUP BY 1"""
    ),
)
def model_reload(spark, sf):
    """For both targets: a bundle of the model refitted on all days predicts from bare keys exactly what it predicted before saving."""
    panel = labelled(spark, sf)
    parts = []
    for target in features.TARGETS:
        saved = saved_bundle(spark, sf, panel, target=target)
        again = reloaded(spark, sf, saved, target)
        gap = bundle.largest_difference(saved.predict(panel), again.predict(panel), ["block_id", "date", "slot"])
        parts.append(gap.select(F.lit(target).alias("target"), "*"))
    return parts[0].unionByName(parts[1])


_SAME = trips_sql(
    f"{LABELLED} SELECT count(*) AS n, CAST(0 AS BIGINT) AS unmatched, CAST(0 AS DOUBLE) AS max_difference FROM panel WHERE date = (SELECT max(date) FROM panel)"
)


@query("model_day_alone", _SAME)
def model_day_alone(spark, sf):
    """The last day predicted alone equals the same day predicted with all others."""
    panel = labelled(spark, sf)
    again = reloaded(spark, sf, saved_bundle(spark, sf, panel))
    last = F.col("date") == panel.agg(F.max("date")).scalar()
    return bundle.largest_difference(again.predict(panel).where(last), again.predict(panel.where(last)), ["block_id", "date", "slot"])


@query(
    "model_evaluate_bundle",
    trips_sql(f"{LABELLED} SELECT count(*) AS n, CAST(sum(arrivals) AS DOUBLE) AS obs_sum, true AS scored FROM panel WHERE date >= DATE '{CUT}'"),
)
def model_evaluate_bundle(spark, sf):
    """The reloaded bundle on its deployment days only: rows, observed total, and that every row has a score."""
    panel = labelled(spark, sf)
    again = reloaded(spark, sf, saved_bundle(spark, sf, panel, CUT))
    later = panel.where(F.col("date") >= F.lit(CUT))
    preds = again.predict(later).join(later.select("block_id", "date", "slot", F.col("arrivals").alias("actual")), ["block_id", "date", "slot"])
    return scoring.score(preds).select("n", "obs_sum", ((F.col("poisson_deviance") >= 0) & (F.col("pred_sum") > 0)).alias("scored"))


BLOCKS = ("calendar", "geometry", "trend", "profile", "weather")
# Days that the folds of three blocks validate: from the first cut, the Monday nearest to a third of the days.
_VALID = f"""{LABELLED}, dl AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS d FROM (SELECT DISTINCT date FROM panel)),
cut AS (SELECT p AS c FROM dl WHERE isodow(date) = 1 AND p < d - 1 AND p > 0 ORDER BY abs(p - d / 3e0), p LIMIT 1),
valid AS (SELECT * FROM panel WHERE date >= (SELECT date FROM dl JOIN cut ON p = c))"""


@query(
    "model_ablation",
    trips_sql(
        f"""{_VALID}, t AS (SELECT 'arrivals' AS target, arrivals AS v FROM valid UNION ALL SELECT 'departures', departures FROM valid)
SELECT target, dropped, count(*) AS n, CAST(sum(v) AS DOUBLE) AS obs_sum, true AS scored FROM t, (VALUES ('none'), {', '.join(f"('{b}')" for b in BLOCKS)}) AS b(dropped) GROUP BY 1, 2"""
    ),
)
def model_ablation(spark, sf):
    """All folds with every block and without each of the five in turn, for both targets."""
    panel, weather = labelled(spark, sf), weather_table(spark, sf)
    found = folds.folds(panel, 3, "week_forward")
    parts = [
        models.ablation(panel, found, lambda t=target: blocks(spark, sf, t, weather), target, rounds=2, depth=3).withColumn("target", F.lit(target))
        for target in features.TARGETS
    ]
    scored = (F.col("poisson_deviance") >= 0) & (F.col("pred_sum") > 0)
    return parts[0].unionByName(parts[1]).select("target", "dropped", "n", "obs_sum", scored.alias("scored"))


@query("model_ablation_scores")
def model_ablation_scores(spark, sf):
    """The scores of the ablation: deviances of each fold with every block and without each of the five, for both targets."""
    panel, weather = labelled(spark, sf), weather_table(spark, sf)
    found = folds.folds(panel, 3, "week_forward")
    parts = [
        models.ablation(panel, found, lambda t=target: blocks(spark, sf, t, weather), target, keys=["fold"], rounds=2, depth=3).withColumn("target", F.lit(target))
        for target in features.TARGETS
    ]
    return parts[0].unionByName(parts[1])


@query(
    "model_slot_rows",
    trips_sql(
        f"""{_VALID}, {TOP_UNITS}, t AS (SELECT 'arrivals' AS target, arrivals AS v, block_id FROM valid UNION ALL SELECT 'departures', departures, block_id FROM valid)
SELECT target, count(*) AS n, CAST(sum(v) AS DOUBLE) AS obs_sum, true AS scored FROM t WHERE block_id IN (SELECT block_id FROM chosen) GROUP BY 1"""
    ),
)
def model_slot_rows(spark, sf):
    """What is exact of the run on the slot panel: the scored rows of all folds and their observed totals, for both targets."""
    df = labelled(spark, sf)
    found, rows, weather = folds.folds(df, 3, "week_forward"), slot_rows(spark, sf, df), weather_table(spark, sf)
    parts = []
    for target in features.TARGETS:
        run = models.feature_fit_predict(lambda t=target: blocks(spark, sf, t, weather), target, rows, rounds=2, depth=3)
        preds = scoring.calibrate(write_through(models.walk_forward(df, found, run))).where("scored")
        scored = (F.col("poisson_deviance") >= 0) & (F.col("pred_sum") > 0)
        parts.append(scoring.score(preds).select(F.lit(target).alias("target"), "n", "obs_sum", scored.alias("scored")))
    return parts[0].unionByName(parts[1])


@query(
    "panel_export_order",
    trips_sql(f"{LABELLED} SELECT row_number() OVER (ORDER BY date, slot, block_id) AS place, date, slot, block_id FROM panel"),
)
def panel_export_order(spark, sf):
    """Place of each row in the export: the ordered panel written as CSV, its places counted over ranges."""
    exported = tables.write_result(tables.ordered(labelled(spark, sf)), shared_path(spark, "exports"), "csv")
    rows = spark.read.option("header", True).schema(labelled(spark, sf).schema).csv(exported).select("date", "slot", "block_id")
    return ranking.global_rank(rows, [F.col("date"), F.col("slot"), F.col("block_id")], "place")


@query(
    "selected_units",
    trips_sql(
        f"""{LABELLED}, {TOP_UNITS}, u AS (SELECT DISTINCT block_id FROM panel), listed AS (SELECT block_id FROM u ORDER BY block_id LIMIT 3)
SELECT 'all' AS rule, block_id FROM u UNION ALL SELECT 'top_n', block_id FROM chosen UNION ALL SELECT 'list', block_id FROM listed UNION ALL SELECT 'file', block_id FROM u WHERE block_id LIKE '%7'"""
    ),
)
def selected_units(spark, sf):
    """Units to train on by each rule: all, the busiest, a list, and a file of ids."""
    panel = labelled(spark, sf)
    units = panel.select("block_id").distinct()
    listed = [r["block_id"] for r in units.orderBy("block_id").limit(3).collect()]
    path = tables.write_result(units.where("block_id LIKE '%7'"), shared_path(spark, "unit_lists"), "csv")
    rules = {"all": "all", "top_n": "top_n", "list": listed, "file": spark.read.option("header", True).csv(path)}
    parts = [features.select_units(panel, rule, 20).select(F.lit(name).alias("rule"), "block_id") for name, rule in rules.items()]
    return reduce(DataFrame.unionByName, parts)


#: Trees of each fit of the grid search: those of a production run.
SEARCH_ROUNDS = 800


@query("model_search")
def model_search(spark, sf):
    """Loss of every combination of a small grid over all folds (fold null) and on each, for both targets, with the run's
    features, rows, weights and number of trees."""
    panel = labelled(spark, sf)
    found, rows, weather = folds.folds(panel, 3, "week_forward"), slot_rows(spark, sf, panel), weather_table(spark, sf)

    def losses(target):
        shared = models.SharedFolds()

        def make(depth, rounds):
            return models.feature_fit_predict(lambda: blocks(spark, sf, target, weather), target, rows, shared, depth=depth, rounds=rounds)

        found_losses = models.search(panel, found, make, {"depth": [2, 4], "rounds": [SEARCH_ROUNDS]}, lambda preds: models.run_loss(preds, 0.3), by_fold=True)
        return found_losses.withColumn("target", F.lit(target))

    parts = side_by_side(spark, [lambda t=target: losses(t) for target in features.TARGETS])
    return parts[0].unionByName(parts[1])


SPACE = {"rounds": search.Span(1, 4, step=1), "depth": search.Span(2, 7, step=1), "step": search.Span(0.05, 0.5, log=True), "share": search.Span(0.5, 1.0), "least_rows": search.Span(1, 20, step=1)}
TRIALS = 20


def random_search(spark, sf, target, trials=TRIALS, threads=4, keep=1.0):
    """Random points for a target over all folds of the slot panel, with the run's features, rows and weights."""
    panel, weather = labelled(spark, sf), weather_table(spark, sf)
    found, rows = folds.folds(panel, 3, "week_forward"), slot_rows(spark, sf, panel)

    def prepare(fold):
        return models.fold_tables(fold.train(panel), fold.valid(panel), blocks(spark, sf, target, weather), target, rows)

    def loss(tables, **point):
        return models.run_loss(tables.predictions(**point), 0.3).first()["loss"]

    return search.search(spark, found, prepare, loss, search.random_points(SPACE, trials, seed=1), threads, keep)


@query("model_random_search")
def model_random_search(spark, sf):
    """Loss of 20 random points on every fold, for both targets, and which one wins."""
    parts = [random_search(spark, sf, target).frame(spark).withColumn("target", F.lit(target)) for target in features.TARGETS]
    return parts[0].unionByName(parts[1])


@query("model_best_point_equals_run", "SELECT * FROM (VALUES ('arrivals', 4, true, true), ('departures', 4, true, true)) AS v(target, trials, one_best, equals_run)")
def model_best_point_equals_run(spark, sf):
    """For both targets a search with halving has one winner, and a run with its parameters has the losses that the search told."""
    panel, weather = labelled(spark, sf), weather_table(spark, sf)
    found, rows = folds.folds(panel, 3, "week_forward"), slot_rows(spark, sf, panel)
    made = []
    for target in features.TARGETS:
        result = random_search(spark, sf, target, trials=4, keep=0.5)
        best = result.best
        preds = models.walk_forward(panel, found, models.feature_fit_predict(lambda t=target: blocks(spark, sf, t, weather), target, rows, **best.params))
        again = {f.number: models.run_loss(preds.where(F.col("fold") == f.number), 0.3).first()["loss"] for f in found}
        same = all(abs(again[n] - loss) <= 1e-9 * abs(loss) for n, loss in best.losses.items())
        won = result.frame(spark).where("best").agg(F.count_distinct("trial")).first()[0] == 1
        made.append((target, len(result.trials), won, same))
    return spark.createDataFrame(made, "target string, trials int, one_best boolean, equals_run boolean")


@query("model_search_equals_run", "SELECT CAST(0 AS DOUBLE) AS difference, true AS known")
def model_search_equals_run(spark, sf):
    """The loss that a search reports for a combination against the loss of a run with it."""
    panel = labelled(spark, sf)
    found, rows = folds.folds(panel, 3, "week_forward"), slot_rows(spark, sf, panel)

    def make(depth):
        return models.feature_fit_predict(lambda: [blocks(spark, sf)[0]], "arrivals", rows, depth=depth, rounds=2)

    searched = models.search(panel, found, make, {"depth": [3]}, lambda preds: models.run_loss(preds, 0.3))
    run = models.run_loss(models.walk_forward(panel, found, make(3)), 0.3)
    both = searched.select(F.col("loss").alias("a")).join(F.broadcast(run.select(F.col("loss").alias("b"))), F.lit(True))
    return both.select(F.abs(F.col("a") - F.col("b")).alias("difference"), (F.col("a") > 0).alias("known"))
