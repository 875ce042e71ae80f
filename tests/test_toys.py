"""Small frames with answers worked out by hand."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripweave.functions import clock, polygon
from tripweave.functions import geohash as gh
from tripweave.operators import domain, features, flows, folds, hotspots, network, panel, qc, region, scoring, stock, temporal

TYPES = clock.DayTypes(
    tuple(date(2026, 4, d) for d in (4, 5, 6)) + tuple(date(2026, 5, d) for d in range(1, 6)), (date(2026, 5, 9),)
)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def at(minute):
    return datetime(2026, 4, 1) + timedelta(minutes=minute)


def test_half_open_slots(spark):
    grid = clock.Horizon(450, 180, 30)
    df = spark.createDataFrame([(k, at(m)) for k, m in enumerate((449, 450, 479, 480, 629, 630))], "k int, ts timestamp")
    assert rows(df.orderBy("k").select(grid.slot(F.col("ts")).alias("s")), "s") == [(-1,), (0,), (0,), (1,), (5,), (-1,)]
    assert grid.n_slots == 6
    with pytest.raises(ValueError):
        clock.Horizon(450, 100, 30)


def test_slot_label_and_timestamp(spark):
    grid = clock.Horizon(390, 240, 30)
    df = spark.createDataFrame([(date(2026, 4, 1), 3)], "d date, s int")
    got = df.select(grid.label(F.col("s")).alias("l"), grid.timestamp(F.col("d"), F.col("s")).alias("t")).first()
    assert got["l"] == "08:00" and got["t"] == datetime(2026, 4, 1, 8, 0)


def test_day_rules(spark):
    days = [date(2026, 4, 3), date(2026, 4, 4), date(2026, 4, 5), date(2026, 4, 6), date(2026, 4, 7), date(2026, 4, 11), date(2026, 5, 9)]
    df = spark.createDataFrame([(d,) for d in days], "d date").orderBy("d")
    keep = lambda rule: [r[0] for r in rows(df.select(TYPES.keep(F.col("d"), rule).alias("k")), "k")]
    assert keep("labelled") == [True, True, True, True, True, False, True]
    assert keep("workday") == [True, False, False, False, True, False, True]
    assert keep("weekend") == [not k for k in keep("workday")]
    assert sum(keep([date(2026, 4, 5)])) == 1
    with pytest.raises(ValueError):
        keep("sundays")


def test_unpadded_and_junk_times(spark):
    df = spark.createDataFrame([("2026/3/2 7:05",), ("2026/03/02 07:05",), ("bad",), ("",)], "t string")
    got = [r[0] for r in rows(df.select(clock.parse_minute(F.col("t")).alias("t")), "t")]
    assert got == [datetime(2026, 3, 2, 7, 5)] * 2 + [None, None]


def dirty(spark):
    good = ("2026/3/2", "{}", "b", "2026/3/2 7:00", "2026/3/2 7:10", "wx4eqtke", "wx4eqtkg")
    def row(key, **changes):
        base = dict(zip(qc.REQUIRED, good))
        base["order_id"] = key
        return tuple({**base, **changes}[c] for c in qc.REQUIRED)

    data = [
        row("ok"), row(""), row("twice"), row("twice"), row("junk", start_time="bad"), row("letter", start_geohash="wx4eqtka"),
        row("short", end_geohash="wx4eq"), row("back", end_time="2026/3/2 6:50"), row("zero", end_time="2026/3/2 7:00"),
        row("long", end_time="2026/3/2 10:20"), row("hour", end_time="2026/3/2 8:01"), row("same", end_geohash="wx4eqtke"),
        row("fast", end_geohash="wx5eqtkg"),
    ]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in qc.REQUIRED))


def test_one_row_per_flag(spark):
    policy = qc.Policy(min_prefix_share=0.05)
    flagged = qc.flag_all(dirty(spark), policy)
    hits = {r["order_id"]: {f for f in qc.FLAGS if r[f]} for r in flagged.collect()}
    assert hits["ok"] == set()
    assert hits[""] == {"qc_null_required"}
    assert hits["twice"] == {"qc_dup_order"}
    assert hits["junk"] == {"qc_unparsed"}
    assert hits["letter"] == {"qc_bad_geohash"}
    assert hits["back"] == {"qc_neg_dur"}
    assert hits["zero"] == {"qc_zero_dur"}
    assert hits["long"] == {"qc_dur_gt_60", "qc_dur_gt_180"}
    assert hits["hour"] == {"qc_dur_gt_60"}
    assert hits["same"] == {"qc_same_geohash"}
    assert hits["fast"] == {"qc_speed_gt_30", "qc_cross_region"}
    kept = {r["order_id"] for r in qc.apply_policy(flagged, policy).collect()}
    assert kept == {"ok", "hour", "same"}
    wider = qc.Policy(min_prefix_share=0.05, released=("qc_zero_dur",))
    assert {r["order_id"] for r in qc.apply_policy(flagged, wider).collect()} == {"ok", "hour", "same", "zero"}
    assert wider.tag() == "keepzerodur"


def test_missing_column_refused(spark):
    with pytest.raises(ValueError):
        qc.structural(dirty(spark).drop("bike_id"))


def test_low_day(spark):
    counts = [10, 10, 10, 2, 10, 10, 10]
    data = [(date(2026, 3, 2) + timedelta(days=k),) for k, n in enumerate(counts) for _ in range(n)]
    rated = qc.daily_baseline(spark.createDataFrame(data, "date date"))
    assert [r["date"] for r in rated.where("low").collect()] == [date(2026, 3, 5)]


def test_square_ring(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    points = [(2.0, 2.0), (5.0, 2.0), (0.0, 2.0), (2.0, 0.0), (4.0, 2.0), (2.0, 4.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = [r[0] for r in rows(df.select(polygon.inside(F.col("lat"), F.col("lon"), ring).alias("i")), "i")]
    # Even-odd with half-open comparisons: south and west borders are in, north and east are out.
    assert got == [True, False, True, True, False, False]


def test_first_crossing_prefers_lowest_edge(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    df = spark.createDataFrame([(2.0, 2.0, 2.0, 8.0), (2.0, 2.0, 6.0, 6.0), (1.0, 1.0, 2.0, 2.0)], "a double, b double, c double, d double")
    hit = polygon.first_crossing(*[F.col(c) for c in "abcd"], ring)
    got = [r["h"] for r in df.select(hit.alias("h")).collect()]
    assert (got[0]["edge"], round(got[0]["t"], 6)) == (1, round(1 / 3, 6))
    assert (got[1]["edge"], got[1]["t"]) == (1, 0.5)  # the corner belongs to edges 1 and 2
    assert got[2] is None


def test_arcs_reach_their_length(spark):
    ring = [(39.97, 116.30 + 0.001 * k) for k in range(10)] + [(39.98, 116.309 - 0.001 * k) for k in range(10)]
    edges = region.edge_table(spark, ring, 300.0).orderBy("edge").collect()
    lengths = {}
    for e in edges:
        lengths[e["arc"]] = lengths.get(e["arc"], 0.0) + e["length_m"]
    assert [e["arc"] for e in edges] == sorted(e["arc"] for e in edges)
    assert all(v >= 300.0 for k, v in lengths.items() if k < max(lengths))


def test_geohash_inverse(spark):
    import random

    generator = random.Random(7)
    for level in (4, 5, 6, 7, 8):
        lat_bits, lon_bits = gh.axis_bits(level)
        pairs = [(generator.randrange(2**lat_bits), generator.randrange(2**lon_bits)) for _ in range(200)]
        df = spark.createDataFrame(pairs, "i long, j long").withColumn("c", gh.encode(F.col("i"), F.col("j"), level))
        back = df.select("i", "j", gh.lat_index(F.col("c"), level).alias("i2"), gh.lon_index(F.col("c"), level).alias("j2"), F.length("c").alias("n"))
        assert all((r["i"], r["j"], level) == (r["i2"], r["j2"], r["n"]) for r in back.collect())


def test_known_geohash(spark):
    df = spark.createDataFrame([("ezs42",)], "c string")
    i, j = gh.lat_index(F.col("c"), 5), gh.lon_index(F.col("c"), 5)
    got = df.select(gh.centre_lat(i, 5).alias("lat"), gh.centre_lon(j, 5).alias("lon")).first()
    assert got["lat"] == pytest.approx(42.605, abs=1e-3) and got["lon"] == pytest.approx(-5.603, abs=1e-3)


def test_members_wrap(spark):
    df = spark.createDataFrame([(0, 0)], "i long, j long").select(gh.encode(F.col("i"), F.col("j"), 4).alias("u"))
    cells = df.select(F.explode(gh.member_cells(F.col("u"), 4, 3, 3, aligned=False)).alias("c"))
    got = {(r["i"], r["j"]) for r in cells.select(gh.lat_index(F.col("c"), 4).alias("i"), gh.lon_index(F.col("c"), 4).alias("j")).collect()}
    assert got == {(a % 1024, b % 1024) for a in (-1, 0, 1) for b in (-1, 0, 1)}


def test_densify_keeps_idle_units_and_drops_foreign_days(spark):
    counts = spark.createDataFrame(
        [("a", date(2026, 3, 2), 1, 5), ("a", date(2026, 3, 4), 0, 2), ("a", date(2026, 3, 9), 0, 9), ("z", date(2026, 3, 2), 0, 1)],
        "u string, date date, slot int, n long",
    )
    days = domain.numbered(spark.createDataFrame([(date(2026, 3, d),) for d in (2, 3, 4)], "date date"))
    units = spark.createDataFrame([("a",), ("b",)], "u string")
    dense = domain.densify(counts, ["u"], days, "slot", 2, ["n"], units)
    got = {(r["u"], r["date"].day, r["slot"]): r["n"] for r in dense.collect()}
    assert len(got) == 2 * 3 * 2 == dense.count()
    assert {k: v for k, v in got.items() if v} == {("a", 2, 1): 5, ("a", 4, 0): 2}


def test_sides_are_selected_by_their_own_time(spark):
    trips = spark.createDataFrame(
        [(datetime(2026, 4, 1, 10, 20), datetime(2026, 4, 1, 10, 40), date(2026, 4, 1), "wx4eqtke", "wx4eqtkg")],
        "start_time timestamp, end_time timestamp, date date, start_geohash string, end_geohash string",
    )
    counts = panel.slot_counts(trips, clock.Horizon(390, 240, 30), TYPES).collect()
    assert [(r["block_id"], r["slot"], r["departures"], r["arrivals"]) for r in counts] == [("wx4eqtke", 7, 1, 0)]


def test_panel_contract(spark):
    good = [("a", "2026-03-02", 0, 1, 2, 0.0, 0.0), ("a", "2026-03-02", 1, 0, 0, 0.0, 0.0)]
    schema = "block_id string, date string, hour int, arrivals int, departures int, lat double, lon double"
    assert panel.validate_panel(spark.createDataFrame(good, schema), 2).count() == 2
    for bad in (good + [good[0]], good + [("a", "2026-03-02", 2, 0, 0, 0.0, 0.0)], good + [("b", "2026-03-02", 0, -1, 0, 0.0, 0.0)]):
        with pytest.raises(ValueError):
            panel.validate_panel(spark.createDataFrame(bad, schema), 2)
    with pytest.raises(ValueError):
        panel.validate_panel(spark.createDataFrame(good, schema).drop("lat"), 2)


def business_days(start, n):
    days, day = [], start
    while len(days) < n:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    return days


def test_monday_folds(spark):
    days = business_days(date(2026, 5, 4), 25)
    df = spark.createDataFrame([(d,) for d in days], "date date")
    found = folds.folds(df, 4, "week_forward")
    assert len(found) == 3 and all(f.start.weekday() == 0 for f in found)
    folds.check_forward(folds.fold_table(df, found))
    plain = spark.createDataFrame([(date(2026, 5, 1) + timedelta(days=k),) for k in range(23)], "date date")
    assert [f.start.day for f in folds.folds(plain, 4, "walk_forward")] == [6, 12, 18]
    assert [f.end.day for f in folds.folds(plain, 4, "walk_forward")] == [11, 17, 23]
    few = spark.createDataFrame([(d,) for d in business_days(date(2026, 5, 5), 10)], "date date")
    with pytest.raises(ValueError, match="Mondays"):
        folds.folds(few, 4, "week_forward")
    with pytest.raises(ValueError):
        folds.folds(df, 30, "walk_forward")


def test_gamma_is_a_mean_of_means(spark):
    data = [(0, 1.0, True)] * 8 + [(0, 3.0, False)] * 2
    preds = spark.createDataFrame(data, "actual int, pred double, g boolean")
    losses = scoring.group_losses(preds, "g")
    by = lambda mode, gamma: scoring.blend(losses, [gamma], mode).first()["loss"]
    assert by("group_mean", 0.5) == pytest.approx(0.5 * 2 + 0.5 * 6)
    assert by("group_mean", 1.0) == pytest.approx(2.0) and by("group_mean", 0.0) == pytest.approx(6.0)
    assert by("row_weighted", 0.5) == pytest.approx((8 * 2 + 2 * 6) / 10)
    assert by("off", 0.3) == pytest.approx(2.8)
    alone = scoring.blend(scoring.group_losses(preds.where("g"), "g"), [0.2]).first()
    assert alone["mode"] == "group_mean_empty" and alone["loss"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        scoring.blend(losses, [1.5])


def test_calibration_uses_the_fold_before(spark):
    preds = spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, 1.0), (3, 1.0, 1.0)], "fold int, actual double, pred_raw double")
    plain = {r["fold"]: r["factor"] for r in scoring.forward_factors(preds).collect()}
    compound = {r["fold"]: r["factor"] for r in scoring.forward_factors(preds, compound=True).collect()}
    assert plain == {1: 1.0, 2: 2.0, 3: 3.0}
    assert compound == {1: 1.0, 2: 2.0, 3: 1.5}


def toy_network(spark):
    gp = spark.createDataFrame([("A", "c1"), ("A", "c2"), ("B", "c3"), ("B", "c4")], "gp_id string, cell string")
    arc = spark.createDataFrame([(1, "c1"), (1, "c2"), (1, "s1"), (2, "c3"), (2, "c4"), (2, "s1")], "arc_id long, cell string")
    cells = [(c, date(2026, 3, d), s, 1.0) for c in ("c1", "c2", "c3", "c4", "s1") for d in (2, 3) for s in (0, 1)]
    return network.membership(gp, arc), spark.createDataFrame(cells, "block_id string, date date, slot int, pred double")


def test_groups_add_up_and_arcs_overlap(spark):
    members, preds = toy_network(spark)
    rolled = network.rollup(preds, members, ["pred"])
    sums = {r["kind"]: r["s"] for r in rolled.groupBy("kind").agg(F.sum("pred_total").alias("s")).collect()}
    assert sums == {"gp": 16.0, "arc": 24.0}  # five cells sum to 20: the shared one counts twice
    part = network.rollup(preds.where("block_id <> 'c2'"), members, ["pred"]).where("id = 'A'").first()
    assert (part["n_cells"], part["missing_cells"]) == (1, 1)
    both = network.with_actuals(rolled, preds.withColumnRenamed("pred", "arrivals"), members, "arrivals")
    assert both.where("actual_total <> pred_total or actual_total is null").count() == 0


def test_votes_purity_and_leftovers(spark):
    other = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "z")], "gp_id long, cell string")
    own = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "Q"), ("d", "Q")], "cell string, gp string")
    mapping = network.match_groups(other, own)
    got = {r["gp_id"]: (r["canonical"], r["standalone"], r["purity"]) for r in mapping.collect()}
    assert got[1] == ("P", False, pytest.approx(2 / 3)) and got[2] == ("Q", False, 1.0) and got[3] == ("R3", True, None)
    arcs = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 1, 9)], "arc_id long, from_gp long, to_gp long")
    assert {r["arc_id"]: r["fate"] for r in network.remap_arcs(arcs, mapping).collect()} == {1: "kept", 2: "self_loop", 3: "unmapped"}
    with pytest.raises(ValueError):
        network.check_contained(spark.createDataFrame([("q",)], "cell string"), own)


def test_weather_gap_stays_unknown(spark):
    table = spark.createDataFrame([(datetime(2026, 4, 1, 8), 0.0, 5.0, 1.0, 50.0)], "ts timestamp, precip_mm double, temp_c double, wind_ms double, cloud_pct double")
    block = features.Weather(table, clock.Horizon(450, 180, 30))
    df = spark.createDataFrame([("u", date(2026, 4, 1), 0), ("u", date(2026, 4, 1), 1)], "block_id string, date date, slot int")
    got = {r["slot"]: r for r in block.transform(df).collect()}
    assert all(got[0][c] is None for c in block.columns)
    assert got[1]["is_raining"] == 0.0 and got[1]["is_cold"] == 0.0 and got[1]["log_precip"] == 0.0


def test_features_never_see_targets(spark):
    class Spy(features.FeatureBlock):
        name, columns = "spy", ()
        seen = None

        def transform(self, df):
            self.seen = set(df.columns)
            return df

    spy = Spy()
    df = spark.createDataFrame([("u", date(2026, 4, 1), 0, 3, 4)], "block_id string, date date, slot int, arrivals int, departures int")
    out = features.FeatureSet([spy]).transform_keeping(df)
    assert not spy.seen & {"arrivals", "departures"} and out.first()["arrivals"] == 3


def test_trend_borrows_missing_day_type(spark):
    data = [("u", date(2026, 4, 1) + timedelta(days=k), 0, 10, 0) for k in range(5)]
    df = spark.createDataFrame(data, "block_id string, date date, slot int, arrivals int, dow int")
    block = features.Trend().fit(df)
    rows = {r["weekend"]: r for r in block.table.collect()}
    assert rows[True]["borrowed"] and not rows[False]["borrowed"] and block.notes()
    assert rows[True]["intercept"] == rows[False]["intercept"] and rows[True]["slope"] == rows[False]["slope"]


def test_trend_needs_no_calendar(spark):
    """Without the calendar's columns the weekday decides; the lines are those with the columns."""
    data = [("u", date(2026, 4, 1) + timedelta(days=k), 0, 10 + k, 0) for k in range(20)]
    df = spark.createDataFrame(data, "block_id string, date date, slot int, arrivals int, departures int")
    bare = features.FeatureSet([features.Trend()]).fit(df).transform(df)
    dated = features.FeatureSet([features.Calendar(clock.DayTypes()), features.Trend()]).fit(df).transform(df)
    left, right = ({r["date"]: r["trend_scale"] for r in x.select("date", "trend_scale").collect()} for x in (bare, dated))
    assert left == pytest.approx(right) and len(left) == 20 and len(set(left.values())) > 5


def test_previous_workday_skips_the_weekend(spark):
    days = spark.createDataFrame([(date(2026, 4, 2),), (date(2026, 4, 3),), (date(2026, 4, 7),)], "date date")
    pairs = stock.previous_workdays(days, days).orderBy("date").collect()
    assert [(r["date"].day, r["previous"].day) for r in pairs] == [(3, 2), (7, 3)]


def solve_by_bisection(m, w, total):
    weight = [max(x / sum(w), 1e-9) for x in w]
    a = [total * x / sum(weight) for x in weight]
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(max(x, y * mid) for x, y in zip(m, a)) < total else (low, mid)
    return [max(x, y * high) for x, y in zip(m, a)]


def test_allocation_matches_bisection(spark):
    import random

    generator = random.Random(3)
    m = [generator.uniform(0, 20) for _ in range(60)]
    w = [generator.choice([0.0, generator.uniform(0, 10)]) for _ in range(60)]
    for factor in (1.0, 1.3, 3.0):
        total = factor * sum(m)
        data = [(factor, f"g{k:02d}", m[k], w[k], total) for k in range(60)]
        out = stock.allocate(spark.createDataFrame(data, "factor double, gp string, m double, w double, total double"), ["factor"])
        got = [r["stock"] for r in out.orderBy("gp").collect()]
        assert sum(got) == pytest.approx(total) and all(x >= y - 1e-9 for x, y in zip(got, m))
        assert got == pytest.approx(solve_by_bisection(m, w, total), abs=1e-6)
    with pytest.raises(ValueError):
        stock.check_feasible(spark.createDataFrame([("a", 2.0)], "gp string, m double"), 1.0)


def test_allocation_without_weights_floors_or_groups(spark):
    schema = "f double, gp string, m double, w double, total double"
    data = [(1.0, "a", 0.0, 0.0, 6.0), (1.0, "b", 0.0, 0.0, 6.0), (1.0, "c", 4.0, 0.0, 6.0), (2.0, "a", 3.0, 1.0, 4.0), (2.0, "b", 3.0, 1.0, 4.0), (None, "a", 1.0, 2.0, 2.0)]
    got = {(r["f"], r["gp"]): (r["stock"], r["pinned"]) for r in stock.allocate(spark.createDataFrame(data, schema), ["f"]).collect()}
    assert got[1.0, "a"] == got[1.0, "b"] == (1.0, False) and got[1.0, "c"] == (4.0, True)
    assert got[2.0, "a"] == got[2.0, "b"] == (3.0, True) and got[None, "a"] == (2.0, False)
    assert stock.allocate(spark.createDataFrame([], schema), ["f"]).count() == 0


def test_group_flows_balance(spark):
    od = spark.createDataFrame([(date(2026, 4, 1), "A", "B", 3), (date(2026, 4, 2), "B", "C", 1)], "date date, sgp string, egp string, n long")
    days = domain.numbered(od.select("date").distinct())
    gps = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "gp string")
    out = flows.daily_group_flows(od, gps, days)
    total = out.agg(F.sum("dep"), F.sum("arr"), F.sum("net_out"), F.count("*")).first()
    assert tuple(total) == (4, 4, 0, 8)


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (10.0,), (10.1,)], "v double")
    got = {r["bin"]: r["n"] for r in temporal.histogram(df, "v", [1, 5, 10]).collect()}
    assert got == {0: 1, 1: 2}


def test_weekday_input_is_checked(spark):
    schema = "start_geohash string, end_geohash string, hour int, is_weekend boolean"
    hotspots.check_weekday_input(spark.createDataFrame([("wx4eqtke", "wx4eqtkg", 7, False)], schema))
    with pytest.raises(ValueError):
        hotspots.check_weekday_input(spark.createDataFrame([("wx4eqtka", "wx4eqtkg", 7, False)], schema))


def test_too_few_disjoint_places(spark):
    rows_ = spark.createDataFrame([("am", "inflow", "a", 1, 1, 5), ("am", "inflow", "b", 2, 2, 4)], "peak string, direction string, cell string, i long, j long, score long")
    picks = hotspots.disjoint_top(rows_, 2)
    assert [r["cell"] for r in picks.collect()] == ["a"]
    with pytest.raises(ValueError):
        hotspots.require_full(picks, 2)
