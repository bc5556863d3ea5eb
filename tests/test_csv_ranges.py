"""Quoted CSV in byte ranges against a plain reader, at every border."""

import csv
import json
import os
import random

import pytest

from ratestat.sources import csvranges, survey
from ratestat.sources.positional import positional_bind
from ratestat.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def slow_state(line, inside):
    state = "quoted" if inside else "start"
    i = 0
    while i < len(line):
        c = line[i]
        if state == "quoted":
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
        elif c == '"' and state == "start":
            state = "quoted"
        else:
            state = "start" if c == "," else "plain"
        i += 1
    return state == "quoted"


def test_line_states_match_a_character_machine():
    rng = random.Random(1)
    for _ in range(20000):
        line = "".join(rng.choice('a",') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            assert csvranges.ends_inside(line, inside) == slow_state(line, inside)


def test_compose_follows_states_over_files():
    def r(path, start, out, out_in, into, into_in):
        return {"path": path, "start": start, "records_out": out, "inside_out": out_in, "records_in": into, "inside_in": into_in}
    ranges = [r("b", 0, 4, False, 9, False), r("a", 100, 7, False, 3, True), r("a", 0, 5, True, 9, True), r("a", 200, 2, False, 1, False)]
    got = csvranges.compose(ranges, ["a", "b"], False)
    assert got == {("a", 0): (False, 0, 0), ("a", 100): (True, 5, 0), ("a", 200): (True, 8, 0), ("b", 0): (False, 9, 9)}
    assert csvranges.compose(ranges, ["a", "b"], True)["b", 0] == (False, 7, 8)


@pytest.fixture()
def small_ranges(spark):
    """Splits of 1,500 bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1500")
    spark.conf.set(names[1], "64")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


FIELDS = ["plain", "", 'say ""', 'a "quoted" word', "line one\nline two", "\n", '",\n"', "a,b", "x" * 400, "naïve 语言", '5" disk', "end\r\nnext",
          '"', "\n".join(f'part {i}, "{i}"' for i in range(80))]


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_borders(spark, tmp_path, small_ranges, end):
    rng = random.Random(7)
    rows = [[f"r{i}", rng.choice(FIELDS), rng.choice(FIELDS) + "."] for i in range(400)]
    cuts = [0, 130, 131, 400]
    for k in range(3):
        write(tmp_path / f"part-{k}.csv", [["a", "b", "c"]] + rows[cuts[k]:cuts[k + 1]], end)
    open(tmp_path / "part-9.csv", "w").close()
    df = survey.read_csv_columns(spark, str(tmp_path), ["a", "b", "c"], header=True, na_tokens=(), idx="n")
    got = sorted(df.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(400))
    assert [[r["a"], r["b"] or "", r["c"]] for r in got] == rows
    paths = [str(tmp_path / f"part-{k}.csv") for k in (2, 0)]
    second = sorted(survey.read_csv_columns(spark, paths, ["a", "b", "c"], header=True, idx="n").collect(), key=lambda r: r["n"])
    assert [r["a"] for r in second] == [r[0] for r in rows[131:] + rows[:130]]
    with pytest.raises(ValueError):
        csvranges.read_records(spark, [paths[0], paths[0]])


def test_odd_files(spark, tmp_path, small_ranges):
    def read(text, header=False):
        path = tmp_path / f"f{len(os.listdir(tmp_path))}.csv"
        path.write_bytes(text.encode())
        df = survey.read_csv_columns(spark, str(path), ["a", "b"], na_tokens=(), idx="n", header=header)
        return [(r["n"], r["a"], r["b"]) for r in sorted(df.collect(), key=lambda r: r["n"])]
    assert read("") == [] and read("\n\r\n\n") == []
    assert read("1,2") == [(0, "1", "2")] and read("1,2\n\n3,4\n\n") == [(0, "1", "2"), (1, "3", "4")]
    assert read("a,b\n", header=True) == [] and read("", header=True) == []
    assert read('1,5" disk\n2,x\n') == [(0, "1", '5" disk'), (1, "2", "x")]
    got = read('1,x\n2,"open\n' + "y\n" * 400)
    assert [g[:2] for g in got] == [(0, "1"), (1, "2")]
    assert read("1\n2,3,4\n") == [(0, "1", None), (1, "2", "3")]


def test_documents_bind_by_position(spark, tmp_path, small_ranges):
    docs = read_table(spark, SF, "documents").orderBy("doc_id").select("doc_id", "text", "lang").collect()
    write(tmp_path / "text.csv", [[r["text"]] for r in docs[:100]])
    write(tmp_path / "text2.csv", [[r["text"]] for r in docs[100:]])
    write(tmp_path / "lang.csv", [[r["doc_id"], r["lang"]] for r in docs])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    texts = survey.read_csv_columns(spark, [str(tmp_path / "text.csv"), str(tmp_path / "text2.csv")], ["text"], na_tokens=())
    langs = survey.read_csv_columns(spark, str(tmp_path / "lang.csv"), ["id", "lang"], ["id"])
    got = positional_bind(texts, langs).orderBy("row_idx").collect()
    full = [r for r in docs if r["text"]]
    if len(full) == len(docs):  # an empty text is an empty line, which no reader counts
        assert [(int(r["id"]), r["text"]) for r in got] == [(r["doc_id"], r["text"]) for r in docs]
    assert len(got) == len(docs)


def test_geometry_is_the_files_own_text(spark, tmp_path):
    shapes = {"NY": {"type": "Polygon", "coordinates": [[[1.0, 2.0], [3.5, 2.0], [1.0, 2.0]]]},
              "AK": {"type": "MultiPolygon", "coordinates": [[[[1.0, 2.0], [3.5, 2.0], [1.0, 2.0]]], [[[9, 8], [7, 6], [9, 8]]]]},
              "HI": None}
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": k, "properties": {"name": k.lower(), "area": 3, "tags": ["x"]}, "geometry": g} for k, g in shapes.items()]}
    doc["features"].append({"type": "Feature", "properties": None, "geometry": {"type": "Point", "coordinates": [0, 1]}})
    path = str(tmp_path / "geo.json")
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)
    got = {r["State"]: r for r in survey.read_geojson(spark, path).collect()}
    assert {k: json.loads(got[k]["geometry_json"]) if got[k]["geometry_json"] else None for k in shapes} == shapes
    assert got["AK"]["name"] == "ak" and got[None]["name"] is None
    assert json.loads(got[None]["geometry_json"])["coordinates"] == [0, 1]
