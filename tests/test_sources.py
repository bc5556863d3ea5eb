import json
import os

import pytest

from regions import STATE_TO_REGION
from ratestat.functions import constants as K
from ratestat.sources import survey
from ratestat.sources.positional import positional_bind


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def test_headerless_csv_na_tokens(spark, tmp):
    p = os.path.join(tmp, "n.csv")
    with open(p, "w") as f:
        f.write("1.5,NA\n,2\nnan,null\n3,abc\n")
    df = survey.read_csv_columns(spark, p, ["a", "b"], numeric=["a", "b"])
    rows = df.collect()
    assert [r["a"] for r in rows] == [1.5, None, None, 3.0]
    assert [r["b"] for r in rows] == [None, 2.0, None, None]


def test_survey_positional_bind(spark, tmp):
    num = os.path.join(tmp, "num.csv")
    qual = os.path.join(tmp, "qual.csv")
    tags = os.path.join(tmp, "tags.csv")
    with open(num, "w") as f:
        for i in range(5):
            f.write(f"{i + 1},2,{i + 3},0,NA,0,1,0\n")
    with open(qual, "w") as f:
        for i in range(5):
            f.write(f"Math,U{i},NY\n")
    with open(tags, "w") as f:
        for i in range(5):
            f.write(",".join(str(i) for _ in range(20)) + "\n")
    df = survey.read_survey(spark, num, qual, tags)
    assert df.columns == ["row_idx", *K.NUMERIC_COLUMNS, *K.QUALITATIVE_COLUMNS, *K.TAG_COLUMNS]
    rows = df.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == list(range(5))
    assert [r["University"] for r in rows] == [f"U{i}" for i in range(5)]
    assert [r["Tough grader"] for r in rows] == [float(i) for i in range(5)]
    assert rows[0][K.AGAIN] is None


def test_positional_bind_pads_short_input(spark, tmp):
    a = os.path.join(tmp, "a.csv")
    b = os.path.join(tmp, "b.csv")
    with open(a, "w") as f:
        f.write("1\n2\n3\n")
    with open(b, "w") as f:
        f.write("x\n")
    out = positional_bind(survey.read_csv_columns(spark, a, ["v"], ["v"]),
                          survey.read_csv_columns(spark, b, ["s"])).orderBy("row_idx").collect()
    assert [(r["v"], r["s"]) for r in out] == [(1.0, "x"), (2.0, None), (3.0, None)]


def test_json_map_and_geojson(spark, tmp):
    m = os.path.join(tmp, "map.json")
    with open(m, "w") as f:
        f.write(json.dumps({"NY": "Northeast", "DC": "South", "CA": "West"}))
    got = {r["code"]: r["region"] for r in survey.read_json_map(spark, m, "code", "region").collect()}
    assert got == {"NY": "Northeast", "DC": "South", "CA": "West"}
    g = os.path.join(tmp, "geo.json")
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "NY", "properties": {"name": "New York"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "id": "CA", "properties": {"name": "California"},
         "geometry": {"type": "Polygon", "coordinates": [[[2, 2], [3, 2], [3, 3], [2, 2]]]}},
        {"type": "Feature", "id": "AK", "properties": {"name": "Alaska"},
         "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [6, 6], [5, 5]]]}}]}
    with open(g, "w") as f:
        json.dump(doc, f, indent=1)
    geo = {r["State"]: r for r in survey.read_geojson(spark, g).collect()}
    assert set(geo) == {"NY", "CA", "AK"}
    assert geo["NY"]["name"] == "New York"
    assert json.loads(geo["CA"]["geometry_json"])["type"] == "Polygon"


def test_fixed_values_shape():
    assert len(K.US_STATE_CODES) == 50 and "DC" not in K.US_STATE_CODES
    assert len(STATE_TO_REGION) == 51 and STATE_TO_REGION["DC"] == "South"
    regions = list(STATE_TO_REGION.values())
    assert (regions.count("Northeast"), regions.count("Midwest"), regions.count("South"),
            regions.count("West")) == (9, 12, 17, 13)
    assert len(K.adjusted_column_order()) == 55


def test_csv_round_trip(spark, tmp):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "x double, s string")
    out = os.path.join(tmp, "out")
    survey.write_csv(df, out, single_file=True)
    back = survey.read_csv_columns(spark, out, ["x", "s"], numeric=["x"], header=True)
    assert sorted(back.collect(), key=lambda r: r["s"]) == sorted(df.collect(), key=lambda r: r["s"])
    assert survey.counted_name(df, "adj") == "adj_2.csv"
