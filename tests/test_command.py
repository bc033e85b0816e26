"""The command line, task by task, on a small study area."""

import json

import pytest

from gridloom.__main__ import parser, run
from gridloom.workspace import TableExists


def square(x0, y0, x1, y1, **properties):
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    return {"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_study_area(spark, tmp_path):
    layers = {
        "district": [square(0, 0, 200, 100, people=30), square(0, 100, 200, 200, people=10)],
        "building": [square(0, 0, 100, 100, floors=1), square(100, 0, 150, 100, floors=2), square(0, 100, 100, 200, floors=3)],
    }
    do = lambda *words: run(spark, ["area", *map(str, words)])
    do("init")
    for name, found in layers.items():
        path = tmp_path / f"{name}.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "features": found}))
        do("import-layer", path, name)
    do("extent", "district")
    do("grid", "-s", 100)
    with pytest.raises(TableExists):
        do("grid", "-s", 100)
    do("grid", "-s", 100, "-o")
    assert do("features", "building", "cov") == ["feat_building"]
    assert do("features", "building", "dens") == ["feat_building_1"]
    assert do("features", "building", "cov", "-o") == ["feat_building"]
    do("neighbourhood", 1)
    assert {r["kind"] for r in do("list").collect()} == {"feature", "neighbourhood"}
    do("consolidate")
    do("target", "district", "people")
    do("train", "ols", "tgt_district", tmp_path / "model", "-r", "building.*")
    do("apply", tmp_path / "model", "weight")
    do("disaggregate", "district", "people", "weight", "people")
    assert spark.table("area.people").groupBy().sum("value").first()[0] == pytest.approx(40)
    logs = tmp_path / "logs"
    assert do("--log-folder", logs, "validate", "tgt_district", "people", "--report", tmp_path / "one.html").count() == 1
    assert "done" in (logs / "area_validate.log").read_text()
    assert "<svg" in (tmp_path / "one.html").read_text()
    with pytest.raises(Exception, match="no_such_table"):
        do("--log-folder", logs, "validate", "tgt_district", "no_such_table")
    assert "failed" in (logs / "area_validate.log").read_text()
    models = [r["model"] for r in do("validate-array", "tgt_district", "people", "--report", tmp_path / "pages").collect()]
    assert models and {p.stem for p in (tmp_path / "pages").iterdir()} == set(models)
    assert do("validate-multiscale", "tgt_district", "people", "-u", 2, "--csv", tmp_path / "levels").count() == 1
    assert next((tmp_path / "levels").glob("*.csv")).read_text().splitlines()[0].split(";")[0] == "multiple"
    assert do("introspect", tmp_path / "model").count() >= 1
    assert sorted(do("clear")) == ["feat_building", "feat_building_1", "feat_neigh_building_1_dens", "feat_neigh_building_cov"]


def test_wrong_requests():
    for words in ([], ["area"], ["area", "train", "no-such-model", "t", "f"]):
        with pytest.raises(SystemExit):
            parser().parse_args(words)
