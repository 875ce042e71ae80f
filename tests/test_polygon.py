"""Bands of a ring against folds over all of its edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.functions import polygon


def star(n, seed):
    rng = random.Random(seed)
    return [(40 + math.sin(2 * math.pi * k / n) * rng.uniform(0.3, 1), 116 + math.cos(2 * math.pi * k / n) * rng.uniform(0.3, 1)) for k in range(n)]


RINGS = {
    "star": star(300, 1), "triangle": [(0, 0), (3.0, 1), (1.0, 4.0)], "square": [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)],
    "comb": [p for k in range(40) for p in ((0.0, k / 10), (5.0, k / 10 + 0.03))] + [(-1.0, 4.0), (-1.0, 0.0)], "level": [(1.0, 0.0), (1.0, 2.0), (1.0, 1.0)],
}


def edges_of(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def inside(lat, lon, ring):
    found = False
    for (a, b), (c, d) in edges_of(ring):
        if (a > lat) != (c > lat) and lon < b + (lat - a) * (d - b) / (c - a):
            found = not found
    return found


def first_hit(lat1, lon1, lat2, lon2, ring):
    hits = []
    for k, ((a, b), (c, d)) in enumerate(edges_of(ring)):
        cross = (lat2 - lat1) * (d - b) - (lon2 - lon1) * (c - a)
        if abs(cross) > 1e-15:
            t = ((a - lat1) * (d - b) - (b - lon1) * (c - a)) / cross
            u = ((a - lat1) * (lon2 - lon1) - (b - lon1) * (lat2 - lat1)) / cross
            if 0 <= t <= 1 and 0 <= u <= 1:
                hits.append((t, k))
    return min(hits, default=None)


@pytest.mark.parametrize("name", RINGS)
def test_bands_change_no_answer(spark, name):
    ring, rng = RINGS[name], random.Random(3)
    south, west, north, east = polygon.ring_box(ring)
    spot = lambda: (rng.uniform(south - 0.2, north + 0.2), rng.uniform(west - 0.2, east + 0.2))
    points = [spot() for _ in range(400)] + [(float(a), float(b)) for a, b in ring] + [(float(a[0]), rng.uniform(west, east)) for a in ring]
    ends = [rng.choice(points) for _ in points]
    df = spark.createDataFrame([(k, *p, *q) for k, (p, q) in enumerate(zip(points, ends))] + [(-1, None, 1.0, 1.0, None)], "k int, a double, b double, c double, d double")
    a, b, c, d = (F.col(x) for x in "abcd")
    got = {r["k"]: r for r in df.select("k", polygon.inside(a, b, ring).alias("inside"), polygon.first_crossing(a, b, c, d, ring).alias("hit")).collect()}
    for k, (p, q) in enumerate(zip(points, ends)):
        in_box = south <= p[0] <= north and west <= p[1] <= east
        assert got[k]["inside"] == (in_box and inside(*p, ring))
        hit = first_hit(*p, *q, ring)
        assert (None if got[k]["hit"] is None else tuple(got[k]["hit"])) == hit
    assert got[-1]["inside"] is False and got[-1]["hit"] is None


def test_a_row_meets_few_edges():
    ring = star(2000, 5)
    bands = polygon.Bands.of([(40 + math.sin(2 * math.pi * k / 2000), math.cos(2 * math.pi * k / 2000)) for k in range(2000)])
    assert max(len(m) for m in bands.members) < 200 and sum(map(len, bands.members)) / len(bands.members) < 8
    assert sum(map(len, polygon.Bands.of(ring).members)) <= 6 * len(ring)
