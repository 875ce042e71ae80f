"""Polygon predicates as folds over a literal edge array.

A ring is a list of (lat, lon) vertices, closed implicitly. Its edges travel inside the expression, so
classifying a table of any size needs no join and no shuffle. They are sorted into bands of latitude, and a row meets
the edges of its own band only, so the work for each row does not grow with the number of vertices.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripweave.functions.geohash import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON_EQUATOR

Ring = list[tuple[float, float]]


@dataclass(frozen=True)
class Bands:
    """Equal bands of latitude across a ring, each with the edges that reach into it."""

    south: float
    height: float
    members: list[list[int]]
    starting: list[list[int]]  # the edges whose lowest band it is

    @classmethod
    def of(cls, ring: Ring, per_edge: int = 6) -> "Bands":
        """As many bands as edges, or fewer where long edges would be listed more than per_edge times on average."""
        spans = [sorted((a[0], b[0])) for a, b in edges_of(ring)]
        south, north = min(low for low, _ in spans), max(high for _, high in spans)
        count = len(spans)
        while True:
            height = (north - south) / count or 1.0
            # Rounded subtraction, division and floor keep the order of latitudes, so a point between an edge's ends lies
            # in a band between theirs.
            reach = [(math.floor((low - south) / height), math.floor((high - south) / height)) for low, high in spans]
            if count == 1 or sum(high - low + 1 for low, high in reach) <= per_edge * len(spans):
                break
            count = max(1, count // 2)
        members: list[list[int]] = [[] for _ in range(max(high for _, high in reach) + 1)]
        starting: list[list[int]] = [[] for _ in members]
        for k, (low, high) in enumerate(reach):
            starting[low].append(k)
            for band in range(low, high + 1):
                members[band].append(k)
        return cls(south, height, members, starting)

    def number(self, lat: Column) -> Column:
        """Band of a latitude, counted from one; the first or last beyond the ring."""
        band = F.floor((lat - F.lit(self.south)) / F.lit(self.height))
        return (F.least(F.greatest(band, F.lit(0)), F.lit(len(self.members) - 1)) + 1).cast("int")

    def at(self, lat: Column, rows: list[dict]) -> Column:
        """The rows of the edges that reach into a latitude's band."""
        return F.element_at(_nested(self.members, rows), self.number(lat))

    def between(self, low: Column, high: Column, rows: list[dict]) -> Column:
        """The rows of the edges that reach into the bands of two latitudes, those between, and one on either side; each once."""
        first = F.greatest(self.number(low) - 1, F.lit(1))
        last = F.least(self.number(high) + 1, F.lit(len(self.members)))
        earlier = [sorted(set(own) - set(new)) for own, new in zip(self.members, self.starting)]
        started = F.flatten(F.slice(_nested(self.starting, rows), first, last - first + 1))
        return F.concat(F.element_at(_nested(earlier, rows), first), started)


def _nested(groups: list[list[int]], rows: list[dict]) -> Column:
    """Literal array of the rows of each group."""
    return _literal([[rows[k] for k in group] for group in groups], f"array<array<{_struct_type(rows[0])}>>")


def literal_structs(rows) -> Column:
    """Literal array of structs of ints and floats."""
    rows = list(rows)
    return _literal(rows, f"array<{_struct_type(rows[0])}>")


def _literal(value, kind: str) -> Column:
    """A constant as one text that the optimizer reads once, not thousands of expressions; doubles keep all digits."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _struct_type(row: dict) -> str:
    return "struct<" + ", ".join(f"{k}: {'int' if isinstance(v, int) else 'double'}" for k, v in row.items()) + ">"


def edges_of(ring: Ring) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """Ends of every edge, the closing one included."""
    ends = [(float(lat), float(lon)) for lat, lon in ring]
    return list(zip(ends, ends[1:] + ends[:1]))


def ring_box(ring: Ring) -> tuple[float, float, float, float]:
    """(south, west, north, east)."""
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    return min(lats), min(lons), max(lats), max(lons)


def inside(lat: Column, lon: Column, ring: Ring) -> Column:
    """Even-odd rule. The box test first keeps the fold off rows that cannot be inside."""
    rows = [
        {"lat1": a[0], "lon1": a[1], "lat2": b[0], "run": b[1] - a[1], "rise": b[0] - a[0]}
        for a, b in edges_of(ring)
    ]
    bands = Bands.of(ring)
    edges = bands.at(lat, rows)

    def flip(state: Column, e: Column) -> Column:
        # A level edge straddles nothing.
        straddles = (e["lat1"] > lat) != (e["lat2"] > lat)
        crosses = straddles & (lon < e["lon1"] + F.try_divide((lat - e["lat1"]) * e["run"], e["rise"]))
        return state != crosses

    low_lat, low_lon, high_lat, high_lon = ring_box(ring)
    in_box = lat.between(low_lat, high_lat) & lon.between(low_lon, high_lon)
    return F.when(in_box, F.aggregate(edges, F.lit(False), flip)).otherwise(F.lit(False))


def trip_class(start_inside: Column, end_inside: Column) -> Column:
    """internal, outflow, inflow or external, from which ends lie inside."""
    return (
        F.when(start_inside & end_inside, "internal")
        .when(start_inside, "outflow")
        .when(end_inside, "inflow")
        .otherwise("external")
    )


def first_crossing(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ring: Ring) -> Column:
    """Struct (t, edge) of the first ring edge the segment meets; NULL if it meets none.

    Equal parameters resolve to the lowest edge index. Only edges of the bands that the segment passes, and of one more on
    either side for rounded ends, are met.
    """
    bands = Bands.of(ring)
    rows = [
        {"edge": k, "lat1": a[0], "lon1": a[1], "lat2": b[0], "lon2": b[1]}
        for k, (a, b) in enumerate(edges_of(ring))
    ]
    passed = bands.between(F.least(lat1, lat2), F.greatest(lat1, lat2), rows)
    rise, run = lat2 - lat1, lon2 - lon1

    def meet(e: Column) -> Column:
        e_rise, e_run = e["lat2"] - e["lat1"], e["lon2"] - e["lon1"]
        d_lat, d_lon = e["lat1"] - lat1, e["lon1"] - lon1
        cross = rise * e_run - run * e_rise
        usable = F.when(F.abs(cross) > 1e-15, cross)
        t = (d_lat * e_run - d_lon * e_rise) / usable
        u = (d_lat * run - d_lon * rise) / usable
        return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct(t.alias("t"), e["edge"].alias("edge")))

    return F.array_min(F.filter(F.transform(passed, meet), lambda hit: hit.isNotNull()))


def padded_box(lat: Column, lon: Column, ring: Ring, pad_km: float) -> Column:
    """Within pad_km of the ring's bounding box."""
    low_lat, low_lon, high_lat, high_lon = ring_box(ring)
    d_lat = pad_km * 1000.0 / METRES_PER_DEGREE_LAT
    mid = math.radians((low_lat + high_lat) / 2)
    d_lon = pad_km * 1000.0 / (METRES_PER_DEGREE_LON_EQUATOR * math.cos(mid))
    return lat.between(low_lat - d_lat, high_lat + d_lat) & lon.between(low_lon - d_lon, high_lon + d_lon)


def completeness(inside_fraction: Column) -> Column:
    """complete, straddle or outside, from the share of the cell inside the ring."""
    return (
        F.when(inside_fraction >= 0.999, "complete").when(inside_fraction > 0, "straddle").otherwise("outside")
    )
