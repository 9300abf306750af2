"""The row that arrived last wins an import: pages of one and of several deliveries."""

import json
import os

import pytest

from citylake.functions import geometry as G
from citylake.plans import imports as I
from citylake.sources import files

COLUMNS = ["Gebruiksfunctie", "RegioS", "Perioden", "EindstandVoorraad_22", "VergundeNieuwbouw_2"]


def page(folder, name, supply, demand, time):
    row = dict(zip(COLUMNS, ["A045364", "GM0001", "2020KW04", supply, demand]))
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"value": [row]}))
    os.utime(folder / name, (time, time))


def imported(spark, path, **kw):
    city = spark.createDataFrame([(1,)], "id long")
    target = spark.createDataFrame([], "city_id long, year int, supply long, demand long")
    odata = files.read_odata(spark, str(path), select=COLUMNS, **kw)
    return [tuple(r) for r in I.housing_lifecycle(odata, city, target).collect()]


@pytest.mark.parametrize("newer", [True, False])
def test_a_correction_in_the_tenth_page_wins(spark, tmp_path, newer):
    for k in range(1, 13):
        page(tmp_path, f"page-{k}.json", k, 10 * k, 1_700_000_000 + (k if newer else 0))
    assert imported(spark, tmp_path) == [(1, 2020, 12, 120)]


def test_the_later_file_wins_whatever_its_name(spark, tmp_path):
    page(tmp_path, "z.json", 1, 1, 1_700_000_000)
    page(tmp_path, "a.json", 2, 2, 1_700_000_100)
    assert imported(spark, tmp_path) == [(1, 2020, 2, 2)]


def test_a_delivery_number_goes_before_the_time(spark, tmp_path):
    """Copies may have any time."""
    page(tmp_path / "delivery-9", "page-2.json", 9, 9, 1_700_000_900)
    page(tmp_path / "delivery-10", "page-1.json", 10, 10, 1_700_000_000)
    assert imported(spark, tmp_path / "*") == [(1, 2020, 9, 9)]
    assert imported(spark, tmp_path / "*", delivery=r"/delivery-(\d+)/") == [(1, 2020, 10, 10)]


def test_a_layer_takes_the_feature_that_arrived_last(spark, tmp_path):
    for k in (2, 9, 10):
        square = [[[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]]
        feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}, "properties": {"identificatie": "b", "status": f"from {k}"}}
        path = tmp_path / f"page-{k}.json"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
        os.utime(path, (1_700_000_000, 1_700_000_000))
    target = spark.createDataFrame([], f"bag_id string, construction_year int, status string, area_m2 double, geom {G.GEOM_TYPE}")
    snapshot, _ = I.import_layer(spark, "buildings", str(tmp_path), target)
    assert [(r["bag_id"], r["status"], r["geom"]["bbox"]["xmin"]) for r in snapshot.collect()] == [("b", "from 10", 10.0)]
