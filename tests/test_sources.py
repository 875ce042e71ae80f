"""Files written and read back."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tripweave.operators import qc
from tripweave.sources import boundary, network, orders, ownership, tables, weather


def test_raw_text_keeps_na_and_blanks(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("action_dt,order_id,bike_id,start_time,end_time,start_geohash,end_geohash\n2026/3/2,NA,,2026/3/2 7:05,nan,wx4eqtke,null\n")
    row = orders.read_raw(spark, str(path)).first()
    assert (row["order_id"], row["bike_id"], row["end_time"], row["end_geohash"]) == ("NA", "", "nan", "null")


def test_policy_paths_never_collide():
    assert orders.sink_path("r", qc.Policy()) != orders.sink_path("r", qc.Policy(released=("qc_zero_dur",)))


@pytest.mark.parametrize(
    "blob",
    [
        ["a", "b"], [{"cells": ["a"]}, {"cell_ids": ["b"]}], {"gps": [{"gp_id": "x", "cells": ["a", "b"]}]},
        {"groups": [{"geohashes": ["a"]}, {"members": ["b"]}]}, {"cells": ["a", "b"]}, {"gathering_points": ["a", "b"]},
    ],
)
def test_id_lists(spark, tmp_path, blob):
    path = tmp_path / "ids.json"
    path.write_text(json.dumps(blob))
    assert {r["id"] for r in network.read_ids(spark, str(path)).collect()} == {"a", "b"}


def test_ids_by_key_and_csv(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps({"deep": {"list": ["a"]}}))
    assert [r["id"] for r in network.read_ids(spark, str(tmp_path / "ids.json"), "deep.list").collect()] == ["a"]
    (tmp_path / "ids.csv").write_text("cell,other\nq,1\nr,2\n")
    assert {r["id"] for r in network.read_ids(spark, str(tmp_path / "ids.csv")).collect()} == {"q", "r"}
    with pytest.raises(ValueError):
        network.read_ids(spark, str(tmp_path / "ids.csv"), "none")


def test_documents_in_lines(spark, tmp_path):
    shapes = [["a", None], {"cells": ["b"]}, {"groups": [{"cells": ["c", "d"]}]}, {"groups": [{"x": 1}], "units": ["e"]}, [{"units": ["f"]}], 7, []]
    (tmp_path / "ids.jsonl").write_text("".join(json.dumps(x) + "\n" for x in shapes) + "no json\n")
    assert sorted(r["id"] for r in network.read_ids(spark, str(tmp_path / "ids.jsonl")).collect()) == list("abcdef")
    lines = [{"gps": [{"gp_id": "A", "cells": ["c1"]}]}, {"arcs": [{"arc_id": 1, "service_cells": ["s1", "s2"]}]}]
    (tmp_path / "net.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    gp_cells, arcs, arc_cells = network.read_network(spark, str(tmp_path / "net.jsonl"), lines=True)
    assert (gp_cells.count(), arcs.count(), arc_cells.count()) == (1, 1, 2)
    (tmp_path / "net.jsonl").write_text('{"other": 1}\n')
    with pytest.raises(ValueError):
        network.read_network(spark, str(tmp_path / "net.jsonl"), lines=True)


def test_members_must_overlap(spark):
    panel = spark.createDataFrame([("a",), ("b",)], "block_id string")
    assert network.resolve_members(spark.createDataFrame([("a",), ("z",)], "id string"), panel).count() == 1
    with pytest.raises(ValueError):
        network.resolve_members(spark.createDataFrame([("z",)], "id string"), panel)


def test_network_file(spark, tmp_path):
    blob = {
        "version": "1", "gps": [{"gp_id": "A", "cells": ["c1", "c2"], "lat": 1.0}],
        "arcs": [{"arc_id": 7, "from_gp": "A", "to_gp": "B", "length_m": 3.5, "service_cells": ["c1", "s1"]}],
        "rows": [{"row_id": "c1", "kind": "gp", "gp_id": "A", "geohash": "c1"}],
    }
    path = tmp_path / "network.json"
    path.write_text(json.dumps(blob, indent=1))
    gp_cells, arcs, arc_cells = network.read_network(spark, str(path))
    assert gp_cells.count() == 2 and arcs.first()["length_m"] == 3.5 and {r["cell"] for r in arc_cells.collect()} == {"c1", "s1"}
    path.write_text(json.dumps({"gps": []}))
    with pytest.raises(ValueError):
        network.read_network(spark, str(path))


def test_ring_from_scanlines(spark, tmp_path):
    (tmp_path / "lon.csv").write_text("Longitude,Min_latitude,Max_latitude\n1,0,2\n2,0,3\n")
    (tmp_path / "lat.csv").write_text("Latitude,Min_longitude,Max_longitude\n0,1,2\n2,1,2\n")
    by_lon, _ = boundary.read_scanlines(spark, str(tmp_path / "lon.csv"), str(tmp_path / "lat.csv"))
    assert boundary.ring_from_scanlines(by_lon) == [(0.0, 1.0), (0.0, 2.0), (3.0, 2.0), (2.0, 1.0)]
    with pytest.raises(ValueError):
        boundary.read_scanlines(spark, str(tmp_path / "lat.csv"), str(tmp_path / "lon.csv"))


def test_weather_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,precipitation,temperature_2m,wind_speed_10m,cloud_cover\n2026-04-01T08:00,1,5,2,10\n2026-04-01T08:00,1,5,2,10\n")
    table = weather.read_weather(spark, str(tmp_path / "w.csv"))
    assert table.count() == 1 and table.first()["temp_c"] == 5.0
    with pytest.raises(ValueError):
        weather.normalise(table.drop("wind_ms"))


def test_ownership_tables(spark, tmp_path):
    (tmp_path / "own.csv").write_text("geohash,gp,lon,lat\na,A,1,2\nb,A,3,4\nc,UNASSIGNED,0,0\n")
    (tmp_path / "gp.csv").write_text("gp,lat,lon\nA,,\n")
    own, master = ownership.read_tables(spark, str(tmp_path / "own.csv"), str(tmp_path / "gp.csv"))
    centre = ownership.with_centroids(master, own).first()
    assert (centre["lat"], centre["lon"], centre["n_cells"]) == (3.0, 2.0, 2)
    (tmp_path / "gp.csv").write_text("gp,lat,lon\nA,,\nA,,\n")
    with pytest.raises(ValueError):
        ownership.read_tables(spark, str(tmp_path / "own.csv"), str(tmp_path / "gp.csv"))
    (tmp_path / "gp.csv").write_text("gp,lat,lon\nB,,\n")
    with pytest.raises(ValueError):
        ownership.read_tables(spark, str(tmp_path / "own.csv"), str(tmp_path / "gp.csv"))


def test_panel_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", date(2026, 3, 2), 0, 1, 2, 0.0, 0.0)], "block_id string, date date, slot int, arrivals int, departures int, lat double, lon double")
    path = tables.write_run(df, str(tmp_path), "run", "panel", "date")
    assert tables.ordered(tables.read_panel(spark, path, 8)).first()["departures"] == 2
    csv = tables.write_result(df, str(tmp_path / "panel.csv"), "csv")
    assert tables.read_panel(spark, csv, 8).agg(F.sum("arrivals")).first()[0] == 1
