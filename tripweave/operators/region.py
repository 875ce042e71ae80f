"""Flows across a ring: trip classes, balances over time, gateways, boundary crossings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripweave.functions import geohash as gh
from tripweave.functions import polygon
from tripweave.functions.once import compute_once
from tripweave.operators.ranking import exact_quantiles

Ring = polygon.Ring


def classify(trips: DataFrame, ring: Ring) -> DataFrame:
    """Tag each trip internal, outflow, inflow or external; each end is tested once."""
    tested = compute_once(
        trips,
        {
            "start_inside": polygon.inside(F.col("start_lat"), F.col("start_lon"), ring),
            "end_inside": polygon.inside(F.col("end_lat"), F.col("end_lon"), ring),
        },
    )
    return tested.withColumn("class", polygon.trip_class(F.col("start_inside"), F.col("end_inside")))


def class_counts(classified: DataFrame) -> DataFrame:
    """Trips and share per class; four rows at most."""
    counts = classified.groupBy("class").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def _in(condition: str = "inflow") -> Column:
    return F.count_if(F.col("class") == condition)


def _balance(grouped) -> DataFrame:
    flows = grouped.agg(_in("inflow").alias("inflow"), _in("outflow").alias("outflow"))
    return flows.withColumn("net_in", F.col("inflow") - F.col("outflow"))


def crossing(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("class").isin("inflow", "outflow"))


def hourly_balance(classified: DataFrame) -> DataFrame:
    """Inflow and outflow per hour and day type, per observed day of that type."""
    across = crossing(classified)
    counts = across.groupBy("is_weekend", "hour").agg(_in("inflow").alias("inflow"), _in("outflow").alias("outflow"))
    # At most one row per calendar day.
    days = across.select("is_weekend", "date").distinct().groupBy("is_weekend").agg(F.count("*").alias("days"))
    per_day = counts.join(F.broadcast(days), "is_weekend")
    return per_day.select(
        "is_weekend",
        "hour",
        (F.col("inflow") / F.col("days")).alias("inflow"),
        (F.col("outflow") / F.col("days")).alias("outflow"),
        ((F.col("inflow") - F.col("outflow")) / F.col("days")).alias("net_in"),
    )


def daily_balance(classified: DataFrame) -> DataFrame:
    return _balance(crossing(classified).groupBy("date"))


def weekly_balance(daily: DataFrame) -> DataFrame:
    """Net inflow per week ending on Sunday; a week without crossings is zero.

    At most one row per calendar week.
    """
    ending = F.date_add("date", 6 - F.weekday("date"))
    weeks = daily.groupBy(ending.alias("week_ending")).agg(F.sum("net_in").alias("net_in"))
    span = weeks.agg(F.min("week_ending").alias("lo"), F.max("week_ending").alias("hi"))
    calendar = span.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week_ending"))
    return calendar.join(weeks, "week_ending", "left").fillna(0, ["net_in"])


def one_sample_t(df: DataFrame, column: str) -> DataFrame:
    """Mean, standard error, degrees of freedom and t against zero."""
    return df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")
    ).select(
        "n",
        "mean",
        "sd",
        (F.col("sd") / F.sqrt("n")).alias("std_error"),
        (F.col("n") - 1).alias("df"),
        F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("t"),
    )


def gateways(classified: DataFrame) -> DataFrame:
    """Crossings per outside cell: origin of an inflow, destination of an outflow; one aggregation.

    The centre is the mean outside endpoint of the inflows, or of the outflows where there are none.
    """
    incoming = F.col("class") == "inflow"
    outside = crossing(classified).select(
        "class",
        F.when(incoming, F.col("start_cell6")).otherwise(F.col("end_cell6")).alias("cell"),
        F.when(incoming, F.col("start_lat")).otherwise(F.col("end_lat")).alias("at_lat"),
        F.when(incoming, F.col("start_lon")).otherwise(F.col("end_lon")).alias("at_lon"),
    )

    def centre(axis: str) -> Column:
        return F.coalesce(F.avg(F.when(incoming, F.col(axis))), F.avg(axis))

    return outside.groupBy("cell").agg(
        _in("inflow").alias("n_inflow"),
        _in("outflow").alias("n_outflow"),
        (_in("inflow") - _in("outflow")).alias("net_in"),
        centre("at_lat").alias("lat"),
        centre("at_lon").alias("lon"),
    )


def crossings(classified: DataFrame, ring: Ring) -> DataFrame:
    """Crossing trips with the first ring edge they meet and the crossing point."""
    across = compute_once(
        crossing(classified),
        {
            "hit": polygon.first_crossing(
                F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"), ring
            )
        },
    )
    t = F.col("hit.t")
    return across.select(
        *[c for c in across.columns if c != "hit"],
        F.col("hit.edge").alias("edge"),
        (F.col("start_lat") + t * (F.col("end_lat") - F.col("start_lat"))).alias("x_lat"),
        (F.col("start_lon") + t * (F.col("end_lon") - F.col("start_lon"))).alias("x_lon"),
    )


def edge_lengths(ring: Ring, latitude: float = gh.STUDY_LATITUDE) -> list[float]:
    """Length of every ring edge in metres, in the local projection."""
    lon_metres = gh.METRES_PER_DEGREE_LON_EQUATOR * math.cos(math.radians(latitude))
    return [
        math.hypot((b[0] - a[0]) * gh.METRES_PER_DEGREE_LAT, (b[1] - a[1]) * lon_metres)
        for a, b in polygon.edges_of(ring)
    ]


def edge_table(spark, ring: Ring, target_m: float = 300.0, latitude: float = gh.STUDY_LATITUDE) -> DataFrame:
    """One row per ring edge: ends, length and the arc it belongs to.

    Consecutive edges join an arc until it is at least `target_m` long. The ring is a parameter of at
    most a few thousand vertices, so the table is folded once as an ordered array.
    """
    lengths = edge_lengths(ring, latitude)
    edges = polygon.literal_structs(
        {"edge": k, "lat1": a[0], "lon1": a[1], "lat2": b[0], "lon2": b[1], "length_m": lengths[k]}
        for k, (a, b) in enumerate(polygon.edges_of(ring))
    )
    start = F.struct(
        F.lit(0).alias("arc"), F.lit(0.0).alias("metres"), F.array().cast("array<int>").alias("arcs")
    )

    def extend(state: Column, e: Column) -> Column:
        full = state["metres"] >= target_m
        arc = state["arc"] + full.cast("int")
        return F.struct(
            arc.alias("arc"),
            (F.when(full, F.lit(0.0)).otherwise(state["metres"]) + e["length_m"]).alias("metres"),
            F.array_append(state["arcs"], arc).alias("arcs"),
        )

    one = spark.range(1).select(edges.alias("edges"))
    folded = one.select("edges", F.aggregate("edges", start, extend)["arcs"].alias("arcs"))
    paired = folded.select(F.explode(F.arrays_zip("edges", "arcs")).alias("p"))
    return paired.select("p.edges.*", F.col("p.arcs").alias("arc"))


def crossings_per_edge(crossed: DataFrame, edges: DataFrame) -> DataFrame:
    """Crossings, per direction and per kilometre, of each edge with traffic."""
    counts = crossed.where("edge is not null").groupBy("edge").agg(
        F.count("*").alias("n"), _in("inflow").alias("n_in"), _in("outflow").alias("n_out")
    )
    # Both sides have at most one row per ring edge.
    return counts.join(F.broadcast(edges), "edge").select(
        "edge",
        ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"),
        ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"),
        "length_m", "n", "n_in", "n_out",
        F.try_divide("n", F.col("length_m") / 1000.0).alias("per_km"),
    )


def arc_table(edges: DataFrame) -> DataFrame:
    """One row per arc: length, middle edge's centre, extent."""
    return edges.groupBy("arc").agg(
        F.sum("length_m").alias("length_m"),
        F.floor((F.min("edge") + F.max("edge")) / 2).cast("int").alias("edge"),
        F.least(F.min("lat1"), F.min("lat2")).alias("south"),
        F.greatest(F.max("lat1"), F.max("lat2")).alias("north"),
        F.least(F.min("lon1"), F.min("lon2")).alias("west"),
    ).join(
        edges.select("edge", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon")),
        "edge",
    ).drop("edge")


def crossings_per_arc(crossed: DataFrame, edges: DataFrame) -> DataFrame:
    """Crossings of every arc, also of the ones nobody crosses, with density and share."""
    counts = crossed.where("edge is not null").groupBy("edge").agg(
        F.count("*").alias("n"), _in("inflow").alias("n_in"), _in("outflow").alias("n_out")
    )
    per_arc = counts.join(F.broadcast(edges.select("edge", "arc")), "edge").groupBy("arc").agg(
        F.sum("n").alias("n"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")
    )
    arcs = arc_table(edges).join(per_arc, "arc", "left").fillna(0, ["n", "n_in", "n_out"])
    return arcs.withColumns(
        {
            "per_km": F.col("n") / (F.col("length_m") / 1000.0),
            "share_pct": 100.0 * F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())),
        }
    )


def crossings_per_side(arcs: DataFrame, north_of: float, south_of: float, east_of: float) -> DataFrame:
    """Arcs rolled up to the four sides of the perimeter, against the share of its length."""
    side = (
        F.when(F.col("south") > north_of, "north")
        .when(F.col("north") < south_of, "south")
        .when(F.col("west") > east_of, "east")
        .otherwise("west")
    )
    sides = arcs.groupBy(side.alias("side")).agg(F.sum("n").alias("crossings"), F.sum("length_m").alias("length_m"))
    whole = W.partitionBy()
    return sides.withColumns(
        {
            "share_pct": 100.0 * F.try_divide(F.col("crossings"), F.sum("crossings").over(whole)),
            "length_pct": 100.0 * F.col("length_m") / F.sum("length_m").over(whole),
        }
    )


def trip_shape(classified: DataFrame, columns: list[str]) -> DataFrame:
    """Median, mean and size of trip measures per class; medians are exact at any size."""
    known = classified.where(F.col("class") != "external")
    shapes = known.groupBy("class").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )
    for c in columns:
        median = exact_quantiles(known, c, {f"median_{c}": 0.5}, ["class"])
        shapes = shapes.join(F.broadcast(median), "class", "left")
    return shapes


def ring_area_km2(vertices: DataFrame) -> DataFrame:
    """Spherical-excess area of an ordered vertex table (position, lat, lon).

    The window sees one boundary's vertices.
    """
    order = W.orderBy("position")
    closed = vertices.select(
        F.radians("lat").alias("y1"), F.radians("lon").alias("x1"),
        F.radians(F.coalesce(F.lead("lat").over(order), F.first("lat").over(order))).alias("y2"),
        F.radians(F.coalesce(F.lead("lon").over(order), F.first("lon").over(order))).alias("x2"),
    )
    excess = F.sum((F.col("x2") - F.col("x1")) * (F.lit(2.0) + F.sin("y1") + F.sin("y2")))
    return closed.agg(
        F.count("*").alias("vertices"), (F.abs(excess) * gh.EARTH_RADIUS_KM**2 / 2.0).alias("area_km2")
    )


def scanline_ring(by_lon: DataFrame) -> DataFrame:
    """Ordered vertices traced from scanlines (lon, min_lat, max_lat): south side east, north side back."""
    south = by_lon.select(F.lit(0).alias("part"), F.col("lon").alias("along"), F.col("min_lat").alias("lat"), "lon")
    north = by_lon.select(F.lit(1).alias("part"), (-F.col("lon")).alias("along"), F.col("max_lat").alias("lat"), "lon")
    position = F.row_number().over(W.orderBy("part", "along"))
    return south.unionByName(north).select(position.alias("position"), "lat", "lon")


def spell_out(scanlines: DataFrame, key: str, low: str, high: str, step: float, key_is_lat: bool) -> DataFrame:
    """Grid points a scanline table covers, as integer multiples of `step` from its own low ends."""
    count = F.round((F.col(high) - F.col(low)) / step).cast("int")
    points = scanlines.select(
        F.round(key, 6).alias("k"), F.explode(F.transform(F.sequence(F.lit(0), count), lambda n: F.round(F.col(low) + n * step, 6))).alias("v")
    )
    lat, lon = ("k", "v") if key_is_lat else ("v", "k")
    return points.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()


def compare_scanlines(by_lon: DataFrame, by_lat: DataFrame, step: float) -> DataFrame:
    """Two encodings of one polygon: points of both, shared, and of one only.

    Every point is tagged by its encodings in one aggregation instead of three set operations.
    """
    a = spell_out(by_lon, "lon", "min_lat", "max_lat", step, False).withColumns({"a": F.lit(1), "b": F.lit(0)})
    b = spell_out(by_lat, "lat", "min_lon", "max_lon", step, True).withColumns({"a": F.lit(0), "b": F.lit(1)})
    tagged = a.unionByName(b).groupBy("lat", "lon").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return tagged.agg(
        F.sum("a").alias("from_lon"), F.sum("b").alias("from_lat"),
        F.count_if(F.expr("a = 1 and b = 1")).alias("shared"),
        F.count_if(F.expr("a = 1 and b = 0")).alias("only_lon"),
        F.count_if(F.expr("a = 0 and b = 1")).alias("only_lat"),
    )
