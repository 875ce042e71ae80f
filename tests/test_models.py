"""Fitted models: sane, walk-forward, and identical after reloading."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tripweave.catalog import QUERIES, forecast
from tripweave.catalog.forecast import blocks, labelled
from tripweave.functions.clock import Horizon
from tripweave.operators import boosting, bundle, features, folds, models, negative_binomial, scoring, search
from tripweave.operators import binned


@pytest.fixture(scope="module")
def hourly(spark):
    """Two cells with a daily shape, 20 days; counts grow with the hour."""
    generator = random.Random(1)
    data = []
    for k in range(20):
        day = date(2026, 3, 2) + timedelta(days=k)
        for cell, level in (("a", 1.0), ("b", 4.0)):
            for hour in range(6):
                n = max(0, int(generator.gauss(level * (hour + 1), 1)))
                data.append((cell, day, hour, n, day.weekday(), int(day.weekday() >= 5), level, level, level, level))
    schema = "cell string, date date, hour int, n int, dow int, is_weekend int, lag1 double, lag24 double, lag168 double, lag1_ma3 double"
    return spark.createDataFrame(data, schema).persist()


def deviance(preds):
    return scoring.score(preds.withColumnRenamed("n", "actual")).first()["poisson_deviance"]


@pytest.mark.parametrize("family", ["poisson", "tweedie"])
def test_glm_beats_the_overall_mean(hourly, family):
    found = folds.folds(hourly, 2, "walk_forward")
    preds = models.walk_forward(hourly, found, models.glm_fit_predict(family))
    flat = models.walk_forward(hourly, found, lambda tr, va: va.withColumn("pred", tr.agg(F.avg("n")).scalar()))
    assert deviance(preds) < 0.5 * deviance(flat)


def test_pearson_dispersion(hourly):
    model = models.glm("poisson").fit(models.glm_columns(models.with_cell_prior(hourly, hourly)))
    assert 0 < models.pearson_dispersion(model) < 2


def test_boosted_trees_never_predict_below_zero(hourly):
    found = folds.folds(hourly, 2, "walk_forward")
    preds = models.walk_forward(hourly, found, models.boosted_fit_predict(["hour", "cell_prior"], rounds=5, depth=3))
    assert preds.where("pred < 0 or pred is null").count() == 0
    unseen = models.boosted_fit_predict(["hour"], rounds=2, depth=2)(hourly.where("cell = 'a'"), hourly)
    assert unseen.count() == hourly.count()


def test_one_newton_step_by_hand(spark):
    """A single split: each side's margin moves by rate * sum w (y - mu) / sum w mu."""
    rows = [(0.0, y, w) for y, w in ((1, 1.0), (3, 2.0), (0, 1.0))] + [(1.0, y, w) for y, w in ((8, 1.0), (10, 0.5))] + [(1.0, None, 1.0), (0.0, 4, 0.0)]
    df = spark.createDataFrame(rows, "x double, n int, w double")
    model = boosting.fit(df, ["x"], weight="w", rounds=1, depth=1, step=0.3)
    used = [r for r in rows if r[1] is not None and r[2] > 0]
    mean = sum(y * w for _, y, w in used) / sum(w for *_, w in used)
    for side in (0.0, 1.0):
        own = [(y, w) for x, y, w in used if x == side]
        leaf = sum(w * (y - mean) for y, w in own) / sum(w * mean for _, w in own)
        made = model.transform(df).where(F.col("x") == side).first()["pred"]
        assert made == pytest.approx(mean * 2.718281828459045 ** (0.3 * leaf), rel=1e-9)


def test_newton_rounds_by_hand(spark):
    """Full trees on a category: the margins of both values follow the recursion, for as many rounds as are written in between."""
    rows = [("a", 1), ("a", 2), ("b", 6), ("b", 9), ("b", 9)]
    model = boosting.fit(spark.createDataFrame(rows, "c string, n int"), [], ["c"], rounds=9, depth=2, step=0.5)
    mean = sum(n for _, n in rows) / len(rows)
    mu = {"a": mean, "b": mean}
    level = {c: sum(n for x, n in rows if x == c) / sum(x == c for x, _ in rows) for c in mu}
    for _ in range(9):
        mu = {c: m * 2.718281828459045 ** (0.5 * (level[c] - m) / max(m, 0.05 * mean)) for c, m in mu.items()}
    made = {r["c"]: r["pred"] for r in model.transform(spark.createDataFrame([("a", 0), ("b", 0)], "c string, n int")).collect()}
    assert made == pytest.approx(mu, rel=1e-9)
    assert model.transform(spark.createDataFrame([("new", 0)], "c string, n int")).first()["pred"] > 0


def test_poisson_loss_beats_log_counts(hourly):
    """Lower deviance than the squared loss of log counts on every fold, with the same trees."""
    found = folds.folds(hourly, 3, "walk_forward")
    options = {"rounds": 12, "depth": 3, "step": 0.3}
    own = models.walk_forward(hourly, found, models.poisson_fit_predict(["hour", "cell_prior"], **options))
    logs = models.walk_forward(hourly, found, models.boosted_fit_predict(["hour", "cell_prior"], **options))
    for f in found:
        assert deviance(own.where(F.col("fold") == f.number)) < deviance(logs.where(F.col("fold") == f.number))


def test_no_events_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, n int")
    for train in (df, df.limit(0)):
        assert boosting.fit(train, ["x"], rounds=3).transform(df).agg(F.max("pred")).first()[0] < 1e-8


def test_gini_of_real_values(spark):
    from tripweave.operators import ranking

    values = [0.5, 0.5, 2.25, 7.0, 0.0, 11.125, 3.5, 3.5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    got = ranking.gini(df, "v").first()
    apart = sum(abs(a - b) for a in values for b in values) / (2 * len(values) * sum(values))
    assert (got["holders"], got["total"]) == (len(values), sum(values)) and got["gini"] == pytest.approx(apart)


def test_naive_walk_equals_fold_by_fold(hourly):
    found = folds.folds(hourly, 4, "walk_forward")
    keys, coarse = ["cell", "hour", "dow"], ["cell", "hour"]
    loop = models.walk_forward(hourly, found, lambda tr, va: models.seasonal_naive(tr, va, keys, coarse))
    blocked = hourly.join(folds.equal_blocks(hourly, 4).select("date", "block"), "date")
    once = models.seasonal_naive_walk(blocked, keys, coarse)
    gap = bundle.largest_difference(loop, once, ["fold", "cell", "date", "hour"]).first()
    assert gap["unmatched"] == 0 and gap["max_difference"] < 1e-9


def test_weights_average_one_in_group_balance(spark):
    df = spark.range(100).select((F.col("id") < 10).alias("g"), F.lit(True).alias("scored"))
    out = features.with_row_weights(df, 1.0, "g", 0.3).agg(F.avg("weight"), F.sum(F.when(F.col("g"), F.col("weight")))).first()
    assert out[0] == pytest.approx(1.0) and out[1] == pytest.approx(30.0)


def test_bundle_round_trip_and_refusals(spark, hourly, tmp_path):
    panel = hourly.select(F.col("cell").alias("block_id"), "date", F.col("hour").alias("slot"), F.col("n").alias("arrivals"), F.lit(0).alias("departures"))
    from tripweave.functions.clock import DayTypes

    def made():
        return [features.Calendar(DayTypes()), features.Trend(), features.Profile()]

    chain = features.FeatureSet(made())
    chain.fit(panel)
    model = boosting.fit(models.boosted_columns(chain.transform_keeping(panel), chain.columns), chain.columns, label="arrivals", rounds=2, depth=2)
    morning = Horizon(390, 180, 30)
    with pytest.raises(ValueError, match="first day"):
        bundle.Bundle(model, chain, morning, 1.2).save(str(tmp_path / "a"))
    saved = bundle.Bundle(model, chain, morning, 1.2, first_day=date(2026, 3, 2))
    saved.save(str(tmp_path / "b"))
    again = bundle.Bundle.load(spark, str(tmp_path / "b"), made(), morning)
    for other in (Horizon(0, 360, 60), Horizon(420, 180, 30)):
        with pytest.raises(ValueError, match="saved for"):
            bundle.Bundle.load(spark, str(tmp_path / "b"), made(), other)
    with pytest.raises(ValueError, match="outside the 6 slots"):
        again.predict(panel.withColumn("slot", F.col("slot") + 1))
    one_day = panel.where("date = date'2026-03-15'")
    gap = bundle.largest_difference(saved.predict(one_day), again.predict(one_day), ["block_id", "date", "slot"]).first()
    assert gap["unmatched"] == 0 and gap["max_difference"] == 0.0
    with pytest.raises(ValueError):
        bundle.Bundle.load(spark, str(tmp_path / "b"), made()[:2], morning)
    other = [features.Calendar(DayTypes(holidays=(date(2026, 3, 3),))), *made()[1:]]
    with pytest.raises(ValueError, match="holidays"):
        bundle.Bundle.load(spark, str(tmp_path / "b"), other, morning)


def test_units_and_slots(spark):
    panel = spark.createDataFrame([("a", 0, 5, 0), ("b", 0, 1, 0), ("c", 1, 2, 0)], "block_id string, slot int, arrivals int, departures int")
    assert [r[0] for r in features.select_units(panel, "top_n", 2).collect()] == ["a", "c"]
    assert features.select_units(panel, "all").count() == 3
    assert features.select_units(panel, ["b"]).count() == 1
    with pytest.raises(ValueError):
        features.select_units(panel, ["zz"])
    assert features.keep_slots(panel, [1]).count() == 1
    masked = features.with_score_mask(panel, features.select_units(panel, ["a", "c"]), [0])
    assert {r["block_id"]: r["scored"] for r in masked.collect()} == {"a": True, "b": False, "c": False}


def test_search_gives_each_fold_and_target(spark, sf):
    """The search uses the run's features for both targets and says what each fold lost."""
    rows = QUERIES["model_search"](spark, sf).collect()
    numbers = {r.fold for r in rows} - {None}
    assert len(numbers) > 1 and len(rows) == 2 * 2 * (len(numbers) + 1)
    assert len({(r.target, r.depth, r.rounds, r.fold) for r in rows}) == len(rows) and {r.target for r in rows} == {"arrivals", "departures"}
    assert all(r.loss > 0 for r in rows)


def test_ablation_gives_deviances_by_fold(spark, sf):
    panel = labelled(spark, sf)
    found = folds.folds(panel, 3, "week_forward")
    own = lambda: blocks(spark, sf)[:2]
    rows = models.ablation(panel, found, own, "arrivals", keys=["fold"], rounds=1, depth=2).collect()
    assert {(r.fold, r.dropped) for r in rows} == {(f.number, d) for f in found for d in ("none", "calendar", "geometry")}
    sizes = {f.number: f.valid(panel).count() for f in found}
    assert all(r.n == sizes[r.fold] and r.poisson_deviance > 0 for r in rows)


def test_points_are_seeded_and_stay_in_range():
    space = {"rounds": search.Span(200, 1200, step=100), "step": search.Span(0.01, 0.2, log=True), "share": search.Span(0.5, 1.0), "kind": ["a", "b"]}
    points = search.random_points(space, 200, seed=3)
    assert points[:5] == search.random_points(space, 5, seed=3) and points != search.random_points(space, 200, seed=4)
    assert {p["rounds"] for p in points} == set(range(200, 1201, 100)) and {p["kind"] for p in points} == {"a", "b"}
    assert all(0.01 <= p["step"] <= 0.2 and 0.5 <= p["share"] <= 1 for p in points)
    assert sum(p["step"] < 0.0448 for p in points) == pytest.approx(100, abs=25)
    for bad in ((2, 1), (0.0, 1.0, None, True), (1, 5, 0)):
        with pytest.raises(ValueError):
            search.Span(*bad)


def test_search_gives_the_same_winner_with_any_number_of_threads(spark, hourly):
    found = folds.folds(hourly, 3, "walk_forward")
    points = search.random_points({"rounds": search.Span(1, 6, step=1), "depth": search.Span(1, 4, step=1), "step": search.Span(0.05, 0.6, log=True)}, 6, seed=2)

    def prepare(fold):
        columns = ["hour", "cell_prior"]
        train = models.boosted_columns(models.with_cell_prior(fold.train(hourly), fold.train(hourly)), columns)
        return boosting.assemble(train, columns), models.boosted_columns(models.with_cell_prior(fold.train(hourly), fold.valid(hourly)), columns).persist()

    def loss(prepared, **point):
        return deviance(boosting.grow(prepared[0], **point).transform(prepared[1]))

    runs = [search.search(spark, found, prepare, loss, points, threads=n) for n in (1, 3)]
    assert runs[0].best.number == runs[1].best.number and all(len(t.losses) == len(found) for t in runs[0].trials)
    for a, b in zip(runs[0].trials, runs[1].trials):
        assert a.losses == pytest.approx(b.losses, rel=1e-9)
    own = models.walk_forward(hourly, found, models.poisson_fit_predict(["hour", "cell_prior"], **runs[0].best.params))
    for f in found:
        assert deviance(own.where(F.col("fold") == f.number)) == pytest.approx(runs[0].best.losses[f.number], rel=1e-9)
    halved = search.search(spark, found, prepare, loss, points, threads=3, keep=0.5)
    assert sum(len(t.losses) for t in halved.trials) < sum(len(t.losses) for t in runs[0].trials) and len(halved.best.losses) == len(found)
    table = runs[0].frame(spark)
    assert table.count() == len(points) * len(found) and table.where("best").select("trial").distinct().count() == 1
    with pytest.raises(ValueError):
        search.search(spark, found, prepare, loss, [])


def test_log_gamma(spark):
    values = [1e-6, 1e-3, 0.3, 1.0, 2.5, 17.0, 1e3, 1e6, 1e9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(negative_binomial.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-10, abs=1e-9)


def _negative_binomial_by_numpy(x, y, w):
    """Alternating least squares and a golden-section search on the log of alpha, all rows in memory."""
    import numpy as np

    lgamma = np.vectorize(math.lgamma)
    design = np.column_stack([np.ones(len(y)), x])

    def coefficients(alpha):
        eta = np.log((y + np.average(y, weights=w)) / 2)
        for _ in range(200):
            mu = np.exp(eta)
            weight = w * mu / (1 + alpha * mu)
            beta = np.linalg.solve(design.T * weight @ design, design.T * weight @ (eta + (y - mu) / mu))
            eta = design @ beta
        return beta, np.exp(eta)

    def value(alpha, mu):
        r = 1 / alpha
        return float(np.sum(w * (lgamma(y + r) - lgamma(r) + y * np.log(alpha * mu) - (y + r) * np.log1p(alpha * mu))))

    alpha = 0.0
    for _ in range(30):
        beta, mu = coefficients(alpha)
        low, high = math.log(1e-6), math.log(1e3)
        ratio = (5**0.5 - 1) / 2
        for _ in range(80):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if value(math.exp(a), mu) > value(math.exp(b), mu) else (a, high)
        alpha = math.exp((low + high) / 2)
    return alpha, beta, value(alpha, mu)


@pytest.mark.parametrize("true_alpha", [0.6, 0.0])
def test_negative_binomial_equals_numpy(spark, true_alpha):
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    g = np.random.default_rng(5)
    x = np.column_stack([g.normal(size=1500), g.integers(0, 2, 1500)])
    mu = np.exp(0.4 + 0.5 * x[:, 0] - 0.8 * x[:, 1])
    y = g.poisson(mu * g.gamma(1 / true_alpha, true_alpha, 1500) if true_alpha else mu)
    w = g.choice([0.5, 1.0, 2.0], 1500)
    rows = [(float(a), float(b), int(n), float(k)) for (a, b), n, k in zip(x, y, w)] + [(0.0, 0.0, None, 1.0), (9.0, 9.0, 400, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, n int, w double")
    design = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")]).fit(df)
    model = negative_binomial.fit(df, design, "n", "w", tolerance=1e-5)
    alpha, beta, value = _negative_binomial_by_numpy(x, y, w)
    assert model.alpha == pytest.approx(alpha, rel=1e-3, abs=2e-3) and model.likelihood == pytest.approx(value, rel=1e-7)
    assert [model.line.intercept, *model.line.coefficients] == pytest.approx(list(beta), abs=1e-4)
    if true_alpha:
        assert model.alpha == pytest.approx(true_alpha, rel=0.25)
    else:
        assert model.alpha < 0.1
    assert model.transform(df).agg(F.min("pred")).first()[0] > 0


def test_negative_binomial_needs_events(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(1.0, 0), (2.0, None)], "a double, n int")
    design = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features")]).fit(df)
    with pytest.raises(ValueError, match="no events"):
        negative_binomial.fit(df, design)


@pytest.fixture(scope="module")
def own_events(spark, tmp_path_factory):
    """Events of four weeks, as the queries read them."""
    at = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(2400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 1009).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 50).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 9, F.lit("}")).alias("props"),
    )
    rows.write.parquet(f"{at}/events.parquet")
    return at


def _calls(monkeypatch, module, name):
    """A list that grows with every call of a function of the module."""
    made, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: made.append(a) or real(*a, **k))
    return made


def test_search_reads_the_events_once_for_weather_and_fits_a_fold_once(spark, own_events, monkeypatch):
    read, fitted = _calls(monkeypatch, forecast, "readings"), _calls(monkeypatch, models, "fold_tables")
    rows = QUERIES["model_search"](spark, own_events).collect()
    numbers = {r.fold for r in rows} - {None}
    assert len(rows) == 2 * 2 * (len(numbers) + 1) and all(r.loss > 0 for r in rows)
    assert len(read) == 1 and len(fitted) == 2 * len(numbers)


def test_runs_with_shared_folds_predict_what_they_predict_alone(spark, own_events):
    panel, weather = labelled(spark, own_events), forecast.weather_table(spark, own_events)
    found, rows = folds.folds(panel, 3, "week_forward"), forecast.slot_rows(spark, own_events, panel)
    shared = models.SharedFolds()
    for depth in (2, 3):
        both = []
        for common in (None, shared):
            run = models.feature_fit_predict(lambda: blocks(spark, own_events, "arrivals", weather), "arrivals", rows, common, depth=depth, rounds=2)
            both.append(models.walk_forward(panel, found, run).withColumnRenamed("pred_raw", "pred"))
        gap = bundle.largest_difference(*both, ["fold", "block_id", "date", "slot"]).first()
        assert gap["unmatched"] == 0 and gap["max_difference"] < 1e-9
    assert len(shared.held) == len(found)


def test_slot_features_read_the_events_once_for_weather(spark, own_events, monkeypatch):
    read = _calls(monkeypatch, forecast, "readings")
    rows = QUERIES["model_slot_features"](spark, own_events).collect()
    assert {r.target for r in rows} == {"arrivals", "departures"} and len({r.fold for r in rows}) * 2 == len(rows)
    assert len(read) == 1 and all(r.n > 0 and r.pred_sum > 0 for r in rows)


def test_search_fits_as_many_trees_as_a_production_run(spark, own_events, monkeypatch):
    """Every fit of the search is asked for 800 trees; one each is grown here."""
    asked, real = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda rows, **o: asked.append((o["depth"], o["rounds"])) or real(rows, **{**o, "rounds": 1}))
    rows = QUERIES["model_search"](spark, own_events).collect()
    folds_found = {r.fold for r in rows} - {None}
    assert set(asked) == {(2, 800), (4, 800)} and len(asked) == 2 * 2 * len(folds_found)
    assert {r.rounds for r in rows} == {800}


@pytest.fixture(scope="module")
def counted(spark):
    """Assembled rows with weights; one column has more values than bins."""
    g = random.Random(7)
    data = []
    for _ in range(900):
        a, b, c = g.randint(0, 5), g.random(), float(g.randint(0, 1))
        data.append((float(a), b, c, -999.0, max(0, int(g.gauss(a * (1 + c) + 4 * b, 1.5))), g.choice([0.25, 1.0, 2.0])))
    df = spark.createDataFrame(data, "a double, b double, c double, d double, n int, w double").repartition(3).persist()
    return df, boosting.assemble(df, ["a", "b", "c", "d"], weight="w")


def _predicted(model, df):
    return [r["pred"] for r in model.transform(df).orderBy("a", "b").collect()]


def test_columns_cut_once_give_the_trees_of_mllib(counted, monkeypatch, spark, tmp_path):
    """Bins for all values: the same predictions, in one task, in many pieces, and after saving."""
    df, rows = counted
    for options in ({"depth": 3}, {"depth": 4, "least_rows": 25, "step": 0.3}, {"depth": 0}):
        options |= {"rounds": 6, "bins": 1024}
        monkeypatch.setattr(boosting, "BINNED_FROM", 50)
        expected = _predicted(boosting.grow(rows, **options), df)
        monkeypatch.setattr(boosting, "BINNED_FROM", 1)
        model = boosting.grow(rows, **options)
        assert _predicted(model, df) == pytest.approx(expected, rel=1e-9)
    model = boosting.grow(rows, rounds=6, depth=3)
    model.stages.write().save(str(tmp_path / "m"))
    again = boosting.CountTrees(type(model.stages).load(str(tmp_path / "m")), model.intercept)
    assert _predicted(again, df) == _predicted(model, df)


def test_pieces_in_many_tasks_give_the_trees_of_one_task(counted, monkeypatch):
    df, rows = counted
    for name, value in (("ADVANCED_EVERY", 2), ("WRITTEN_EVERY", 2)):
        monkeypatch.setattr(binned, name, value)
    monkeypatch.setattr(boosting, "BINNED_FROM", 1)
    for share in (1.0, 0.6):
        made = []
        for piece in (8_000_000, 900):
            monkeypatch.setattr(binned, "PIECE", piece)
            made.append(_predicted(boosting.grow(rows, rounds=7, depth=3, share=share), df))
        assert made[0] == pytest.approx(made[1], rel=1e-9)
    whole, part = (_predicted(boosting.grow(rows, rounds=7, depth=3, share=share), df) for share in (1.0, 0.6))
    assert whole != pytest.approx(part, rel=1e-3)


def test_many_rounds_by_hand(spark):
    """A split on two values: 120 rounds follow the recursion of their margins."""
    rows = [(0.0, 1), (0.0, 2), (1.0, 6), (1.0, 9), (1.0, 9)]
    df = spark.createDataFrame(rows, "x double, n int")
    model = boosting.fit(df, ["x"], rounds=120, depth=2, step=0.1)
    mean = sum(n for _, n in rows) / len(rows)
    mu = {0.0: mean, 1.0: mean}
    level = {x: sum(n for a, n in rows if a == x) / sum(a == x for a, _ in rows) for x in mu}
    for _ in range(120):
        mu = {x: m * math.exp(0.1 * (level[x] - m) / max(m, 0.05 * mean)) for x, m in mu.items()}
    assert {r["x"]: r["pred"] for r in model.transform(df).collect()} == pytest.approx(mu, rel=1e-7)
