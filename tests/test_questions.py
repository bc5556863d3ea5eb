"""End-to-end questions on a small seeded survey written as the three
headerless CSVs (the original files are not shipped)."""

import json
import math
import os

import numpy as np
import pytest

from regions import STATE_TO_REGION
from ratestat.functions import constants as K
from ratestat.plans import questions as Q
from ratestat.sources import survey

N = 600


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("survey")
    rng = np.random.default_rng(20)
    n_r = rng.integers(1, 40, N).astype(float)
    male = rng.integers(0, 2, N)
    female = np.where(rng.uniform(size=N) < 0.9, 1 - male, male)
    rating = np.clip(np.round(rng.normal(3.7 + 0.15 * male, 0.8, N), 1), 1, 5)
    diff = np.clip(np.round(rng.normal(2.9, 0.7, N), 1), 1, 5)
    again = np.round(rng.uniform(0, 100, N), 0)
    online = rng.integers(0, 3, N).astype(float)
    tags = rng.binomial(n_r[:, None].astype(int), rng.uniform(0.05, 0.5, 20)[None, :]).astype(float)
    pepper = ((rating + rng.normal(0, 0.6, N)) > 4.0).astype(float)
    states = rng.choice(["NY", "CA", "TX", "OH", "DC", "XX", "WA", "FL"], N)
    with open(d / "num.csv", "w") as f:
        for i in range(N):
            r = "NA" if i % 37 == 0 else f"{rating[i]}"
            a = "" if i % 11 == 0 else f"{again[i]}"
            f.write(f"{r},{diff[i]},{n_r[i]},{pepper[i]},{a},{online[i]},{male[i]},{female[i]}\n")
    with open(d / "qual.csv", "w") as f:
        for i in range(N):
            f.write(f"Field{i % 7},Univ{i % 13},{states[i]}\n")
    with open(d / "tags.csv", "w") as f:
        for i in range(N):
            row = tags[i].copy()
            if i % 53 == 0:
                row[3] = n_r[i] + 5  # over the bound
            f.write(",".join(str(v) for v in row) + "\n")
    # one exact duplicate row in all three files
    for name in ("num.csv", "qual.csv", "tags.csv"):
        lines = open(d / name).read().splitlines()
        with open(d / name, "a") as f:
            f.write(lines[1] + "\n")
    geo = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": s, "properties": {"name": s},
         "geometry": {"type": "Point", "coordinates": [0, 0]}} for s in ("NY", "CA", "TX", "OH", "WA", "FL", "AK")]}
    (d / "us.json").write_text(json.dumps(geo))
    (d / "regions.json").write_text(json.dumps(STATE_TO_REGION))
    return str(d)


@pytest.fixture(scope="module")
def raw(spark, files):
    return survey.read_survey(spark, os.path.join(files, "num.csv"), os.path.join(files, "qual.csv"),
                              os.path.join(files, "tags.csv"))


@pytest.fixture(scope="module")
def adj(raw):
    return Q.adjusted_table(raw)


def test_cleaning_counts(raw, adj):
    pdf = raw.toPandas().drop(columns=["row_idx"])
    pdf = pdf.dropna(subset=[K.RATING]).drop_duplicates()
    pdf = pdf[pdf[K.N_RATINGS] >= pdf[K.TAG_COLUMNS].max(axis=1)]
    assert adj.count() == len(pdf)
    assert len(adj.columns) == 55
    a = Q.audits(raw)
    assert a["duplicates"].first()[0] == 1


def test_adjusted_csv_round_trip(spark, adj, tmp_path):
    out = str(tmp_path / "adjusted")
    survey.write_csv(adj, out)
    back = survey.read_adjusted(spark, out)
    assert back.columns == adj.columns
    assert back.count() == adj.count()
    a = adj.agg(*[__import__("pyspark.sql.functions", fromlist=["sum"]).sum(f"`{c}`")
                  for c in (Q.ADJ_RATING, K.TOTAL_TAGS)]).first()
    b = back.agg(*[__import__("pyspark.sql.functions", fromlist=["sum"]).sum(f"`{c}`")
                   for c in (Q.ADJ_RATING, K.TOTAL_TAGS)]).first()
    assert list(a) == pytest.approx(list(b), rel=1e-12)


def test_q1_q2(adj):
    r1 = Q.q1_rating(adj)
    t = r1["test"].first()
    g = adj.toPandas()
    m = g[(g[K.MALE] == 1) & (g[K.FEMALE] == 0)][Q.ADJ_RATING]
    f = g[(g[K.MALE] == 0) & (g[K.FEMALE] == 1)][Q.ADJ_RATING]
    if t["method"] == "welch":
        expected = (m.mean() - f.mean()) / math.sqrt(m.var() / len(m) + f.var() / len(f))
    else:
        sp = ((len(m) - 1) * m.var() + (len(f) - 1) * f.var()) / (len(m) + len(f) - 2)
        expected = (m.mean() - f.mean()) / math.sqrt(sp * (1 / len(m) + 1 / len(f)))
    assert t["t"] == pytest.approx(expected, rel=1e-9)
    assert r1["histogram"].count() == 2 * 44
    assert Q.q2_spread(adj)["box"].count() == 2


def test_q3_q6_bootstrap(adj):
    r3 = Q.q3_effects(adj, replicates=40, draws=200)
    ci = {r["statistic"]: r for r in r3["ci"].collect()}
    assert ci["d_average"]["ci_lo"] <= ci["d_average"]["ci_hi"]
    assert r3["hist_d"].count() == 50
    r6 = Q.q6_effect(adj, replicates=30)
    assert r6["ci"].count() == 1 and r6["hist"].count() == 30


def test_q4_tags(adj):
    r = Q.q4_tags(adj)
    res = r["results"].collect()
    assert len(res) == 20
    ps = [x["p_value"] for x in res]
    assert ps == sorted(ps)
    assert r["most"].count() == 3 and r["least"].count() == 3
    assert all(not x["tag"].endswith(")") for x in res)


def test_q5(adj):
    r = Q.q5_difficulty(adj)
    assert r["welch"].count() == 1 and r["kde"].count() == 400


def test_q7_q8_q9(adj):
    adj_b = Q.adjusted_table(adj.select(*[c for c in adj.columns])
                             .select(*[c for c in adj.columns if c in K.NUMERIC_COLUMNS + K.QUALITATIVE_COLUMNS + K.TAG_COLUMNS]),
                             also_require=[K.AGAIN])
    r7 = Q.q7_numeric(adj_b)
    assert r7["sweep"].count() == 100 and r7["vif"].count() == 8
    best = r7["best"].first()
    sweep = r7["sweep"].collect()
    assert best["val_rmse"] == min(s["val_rmse"] for s in sweep)
    assert Q.q8_tags(adj_b)["coefficients"].count() == 21
    r9 = Q.q9_difficulty(adj_b)
    alphas = sorted(s["alpha"] for s in r9["sweep"].collect())
    assert alphas[0] == pytest.approx(1.0) and alphas[-1] == pytest.approx(1000.0)


def test_q10(adj):
    r = Q.q10_pepper(adj)
    auc = r["auc"].first()["auc"]
    assert 0.5 < auc <= 1.0
    conf = r["confusion"].collect()
    assert sum(c["count"] for c in conf) == r["report"].filter("label = 'accuracy'").first()["support"]


def test_extra_states(spark, adj, files):
    geo = survey.read_geojson(spark, os.path.join(files, "us.json"))
    regions = survey.read_json_map(spark, os.path.join(files, "regions.json"), "State", "Region")
    r = Q.extra_states(adj, geo, regions)
    choro = {x["State"]: x for x in r["choropleth"].collect()}
    assert choro["AK"][Q.ADJ_RATING] is None  # geometry without data stays
    kept = {x["State"] for x in r["state_means"].collect()}
    assert "DC" not in kept and "XX" not in kept
    assert r["anova"].count() == 1
