"""Operators against hand-made results and brute force."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from hexagrove.functions import hexgrid
from hexagrove.functions.scalars import class_of, parsed_value, percent_change, road_class, slug
from hexagrove.operators import allocation, context, factors, frames, potential, zones
from hexagrove.operators.statistics import BREAKS
from hexagrove.sources import sinks, tables
from hexagrove.streaming import recent


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_class_breaks_closed_top_and_last_for_the_rest(spark):
    want = {0.0: "very_low", 25.0: "low", 64.9: "medium", 100.0: "very_high", 101.0: "very_high", -1.0: "very_high"}
    assert {x: one(spark, class_of(F.lit(x), BREAKS)) for x in want} == want
    assert one(spark, class_of(F.lit(float("nan")), BREAKS)) == one(spark, class_of(F.lit(None).cast("double"), BREAKS)) == "very_high"


def test_acceptance_of_unknown_distances(spark):
    null = F.lit(None).cast("double")
    for kind, value in (("distance_conflict", 0.0), ("proximity_feasibility", 0.0), ("other", 1.0)):
        accepted, blocked = potential.acceptance(kind, null, F.lit(False), 100.0)
        assert (one(spark, accepted), one(spark, blocked)) == (value, False)
    assert [one(spark, potential.acceptance("distance_conflict", F.lit(d), F.lit(False), 100.0)[0]) for d in (50.0, 100.0, 150.0, 200.0, 300.0)] == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_values_slugs_and_roads(spark):
    def got(t):
        v = one(spark, parsed_value(F.lit(t).cast("string")))
        return v and (v["rule"], round(v["value"], 6), *(x and round(x, 6) for x in (v["low_km2_per_twh"], v["mid_km2_per_twh"], v["high_km2_per_twh"])), v["used_in_scenarios"])

    assert got("12,5") == ("single_value", 12.5, 80.0, 80.0, 80.0, True)
    assert got("5 ± 3") == ("plus_minus", 5.0, 125.0, 200.0, 500.0, True) and got("3 +/- 5")[2:5] == (125.0, 333.333333, 333.333333)
    assert got("8–2") == ("range", 4.0, 125.0, 250.0, 500.0, True) and got("0-4")[:4] == ("range", 2.0, 250.0, 500.0)
    assert got("ca. <5") == ("one_sided_bound", 5.0, None, 200.0, None, False) and got("0") == ("single_value", 0.0, None, None, None, False)
    assert got("") is None and got("NaN") is None and got(None) is None
    assert [one(spark, percent_change(F.lit(a), F.lit(b).cast("double"))) for a, b in ((1.0, -2.0), (1.0, None), (1.0, 0.0), (0.0, 0.0))] == [150.0, 0.0, None, 0.0]
    assert [one(spark, road_class(F.lit(t))) for t in ("primary road", "secondary", "minor", "little")] == ["large", "medium", "small", "other"]
    assert one(spark, slug(F.lit(" Ærø / Øst--7 "))) == "aro_ost_7" and one(spark, slug(F.lit("--"))) == "item"
    assert [one(spark, road_class(F.lit(t))) for t in ("Stor vej", "Mellem lille", "motor", None)] == ["large", "small", "large", "other"]


def test_cells_parents_children(spark):
    cells = spark.range(60).select(hexgrid.synthetic_cell(F.col("id")).alias("cell"))
    kids = hexgrid.children(cells, "cell", 11, 9)
    assert kids.count() == 60 * 49 == kids.select("child").distinct().count()
    assert kids.where(hexgrid.parent(F.col("child"), 9) != F.col("cell")).count() == 0
    assert hexgrid.child_count(5, 6, pentagon=True) == 6 and hexgrid.child_count(7, 9) == 49
    assert kids.where(F.col("child") == hexgrid.center_child(F.col("cell"), 11)).count() == 60


def test_allocation_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.0, 1.5, 2.0, 7.25]), rng.randint(0, 5)) for i in range(300)]
    out = allocation.allocate(spark.createDataFrame(rows, "id int, area double, score int"), 333.0, "area", [F.desc("score"), F.col("id")])
    left, want = 333.0, {}
    for i, area, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if area > 0 and left > 0:
            want[i] = min(area, left)
            left -= want[i]
    assert {r["id"]: r["allocated_area"] for r in out.collect()} == want


def test_zones_and_depth_of_a_disk(spark):
    disk = [(q, r) for q in range(-2, 3) for r in range(-2, 3) if abs(q + r) <= 2]
    cells = spark.createDataFrame([(100 + i, q, r, 1) for i, (q, r) in enumerate(disk)] + [(1, 9, 9, 1)], "cell long, q int, r int, cls int")
    out = {r["cell"]: r for r in zones.core_label(zones.core_zones(cells)).collect()}
    assert out[1]["core_label"] == "single" and out[1]["zone"] == 1
    assert {r["zone_size"] for c, r in out.items() if c != 1} == {19}
    centre = next(100 + i for i, p in enumerate(disk) if p == (0, 0))
    assert out[centre]["core_distance"] == 2 and out[centre]["core_label"] == "deep core" and out[centre]["center_mass_rank"] == 1


def test_context_of_five_points(spark):
    rows = [(1, 0.0, 0.0, 1.0, 10.0), (2, 1.0, 0.0, 1.0, 20.0), (3, 2.0, 0.0, 2.0, 30.0), (4, 0.0, 5.0, 1.0, 40.0), (5, 9.0, 9.0, 1.0, 50.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, w double, v double")
    got = {(r["id"], r["k"]): r for r in context.weighted_context(df, ["v"], [1.0, 2.0, 3.0], 1.0).collect()}
    assert len(got) == 15
    assert (got[1, 2.0]["total"], got[1, 2.0]["mean_v"], got[1, 2.0]["std_v"], got[1, 2.0]["radius"]) == (2.0, 15.0, 5.0, 1.0)
    assert (got[1, 3.0]["total"], got[1, 3.0]["mean_v"]) == (4.0, 22.5) and got[5, 1.0]["radius"] == 0.0


def test_line_length_is_kept_by_the_cells(spark):
    rng = random.Random(1)
    lines = [tuple(rng.uniform(-3, 3) for _ in range(4)) for _ in range(40)]
    out = context.line_length_per_hex(spark.createDataFrame(lines, "x1 double, y1 double, x2 double, y2 double"), 0.5)
    want = sum(math.dist(p[:2], p[2:]) for p in lines)
    assert math.isclose(out.agg(F.sum("length")).first()[0], want, rel_tol=1e-9)


def test_factors_recover_a_planted_structure(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(2000, 2))
    x = np.hstack([f[:, :1] * 0.9 + rng.normal(size=(2000, 3)) * 0.3, f[:, 1:] * 0.8 + rng.normal(size=(2000, 3)) * 0.4])
    loading = factors.varimax(factors.principal_axes(np.corrcoef(x.T), 2))
    truth = np.repeat(np.eye(2), 3, axis=0)
    assert (np.abs(factors.congruence(loading, truth)).max(axis=0) > 0.98).all()


def test_layers_merge_and_upsert(spark):
    a, b = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, value double"), spark.createDataFrame([("y", 5.0), ("z", 6.0)], "k string, value double")
    assert sorted(map(tuple, frames.merge_layers([("a", a), ("b", b)], "k").collect())) == [("x", 1.0, None), ("y", 2.0, 5.0), ("z", None, 6.0)]
    assert sorted(map(tuple, frames.upsert(a, b, "k").collect())) == [("x", 1.0), ("y", 5.0), ("z", 6.0)]


def test_sources_and_sinks(spark, tmp_path):
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"h3_address": "8a", "class_k8": 3}}, {"type": "Feature", "geometry": None, "properties": {"hex_id": "8b", "class_km": 4, "landscape_type": "coast"}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(collection))
    features = tables.geojson_features(spark, str(tmp_path / "a.geojson"))
    assert sorted(map(tuple, tables.landscape_attributes(features).collect())) == [("8a", 3, None), ("8b", 4, "coast")]
    assert tables.distance_table(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "d.csv").write_text("cell,distance_m,intersects\na,5.5,true\nb,,\n")
    assert [tuple(r) for r in tables.distance_table(spark, str(tmp_path / "d.csv")).orderBy("cell").collect()] == [("a", 5.5, True), ("b", None, False)]
    sinks.write_features(features, str(tmp_path / "out"), "Point", "coordinates", ["hex_id"])
    written = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert written == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"hex_id": "8a"}}]
    assert tables.files(spark, str(tmp_path), "*.geojson").first()["name"] == "a.geojson"


def test_stream_equals_table(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{h}:1{m}:00", "click", float(h + m)) for h in range(4) for m in range(5)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = recent.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, recent.windowed_counts(events).collect()))


def test_nearest_of_far_points(spark):
    rng = random.Random(4)
    schema = "id int, x double, y double"
    near = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(8)] + [(8, 5000.0, -3000.0), (9, 90.0, 0.0)]
    others = [(100 + i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(5)] + [(200, 95.0, 95.0)]
    want = {i: min((math.dist((x, y), o[1:]), o[0]) for o in others) for i, x, y in near}
    got = {r["id"]: r for r in context.nearest(spark.createDataFrame(near, schema), spark.createDataFrame(others, schema), 0.5).collect()}
    assert set(got) == set(want) and all(got[i]["oid"] == o and math.isclose(got[i]["distance"], d) for i, (d, o) in want.items())


def test_context_of_far_points_uses_all(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 10.0), (2, 900.0, 0.0, 1.0, 20.0), (3, 0.0, 5000.0, 1.0, 60.0)], "id int, x double, y double, w double, v double")
    got = {(r["id"], r["k"]): r for r in context.weighted_context(df, ["v"], [2.0, 9.0], 1.0).collect()}
    assert [(got[i, 9.0]["total"], got[i, 9.0]["mean_v"]) for i in (1, 2, 3)] == [(3.0, 30.0)] * 3
    assert (got[1, 2.0]["radius"], got[3, 2.0]["total"], got[3, 2.0]["radius"]) == (900.0, 2.0, 5000.0)


def test_score_rounds_half_to_even_of_the_scaled_double(spark):
    """29.549999999999997 and 51.650000000000006 are halves once scaled; both go to the even decimal."""
    df = spark.createDataFrame([("PROMO", 1.35, 0.99), ("ECONOMY", 1.7, 0.92), ("", 0.15, 0.99)], "t string, f1 double, f2 double")
    out = potential.score(df, 20.0, "t", {"ECONOMY": 12.0, "PROMO": -8.0}, [(["f1", "f2"], 30.0)])
    assert [r["score"] for r in out.collect()] == [29.6, 51.6, 28.6]


def test_parsed_value_reads_a_text_once(spark):
    from hexagrove.functions.scalars import parsed_value

    df = spark.createDataFrame([("5-20",), ("nan",)], "t string").select(parsed_value(F.col("t")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r["v"] and (r["v"]["rule"], r["v"]["value"], r["v"]["low_km2_per_twh"]) for r in df.collect()] == [("range", 10.0, 50.0), None]


def test_silhouette_in_blocks(spark):
    """Blocks of three rows give what one block gives; no pair of rows is a row of the plan."""
    from hexagrove.operators import statistics

    rows = [(i, [float(i % 5), float(i // 5) ** 0.5], i % 3) for i in range(20)] + [(20, None, 1)]
    df = spark.createDataFrame(rows, "k long, v array<double>, c int")
    small, large = ({r["cluster"]: (round(r["silhouette"], 9), r["n"]) for r in statistics.silhouette(df, "k", "v", "c", side).collect()} for side in (3, 2048))
    known = [r for r in rows if r[1]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[1], b[1])) ** 0.5
    mean = lambda a, c: sum(far(a, b) for b in known if b[2] == c and b[0] != a[0]) / sum(b[2] == c and b[0] != a[0] for b in known)
    each = {c: [(min(mean(a, o) for o in range(3) if o != c) - mean(a, c)) / max(mean(a, o) for o in [c, min((o for o in range(3) if o != c), key=lambda o: mean(a, o))]) for a in known if a[2] == c] for c in range(3)}
    assert small == large == {c: (round(sum(v + [0.0] * (c == 1)) / (len(v) + (c == 1)), 9), len(v) + (c == 1)) for c, v in each.items()}


def test_silhouette_shuffles_sums_not_pairs(spark):
    """Ten times the blocks: what is shuffled grows with the rows, not with the pairs of blocks. Copies are at distance 0, and rows of one key no pair."""
    from hexagrove.operators import statistics

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), i % 2) for i in range(400)]
    rows += [(1000 + i, rows[i][1], i % 2) for i in range(40)] + [(i, rng.normal(size=4).tolist(), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, v array<double>, c int").persist()

    def shuffled(side: int) -> tuple[int, list]:
        tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext.setJobGroup(f"silhouette {side}", "")
        out = sorted((r["cluster"], round(r["silhouette"], 9), r["n"]) for r in statistics.silhouette(df, "k", "v", "c", side).collect())
        stages = {s for j in tracker.getJobIdsForGroup(f"silhouette {side}") for s in tracker.getJobInfo(j).stageIds}
        spark.sparkContext.setJobGroup("others", "")
        return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages), out

    (few, large), (many, small) = shuffled(2048), shuffled(40)
    v, k, c = np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    away, pair = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), k[:, None] != k[None]
    known = {}
    for key, own in dict.fromkeys(zip(k.tolist(), c.tolist())):
        at = (k == key) & (c == own)
        mean = [away[at][:, c == o][pair[at][:, c == o]].mean() for o in (own, 1 - own)]
        known.setdefault(own, []).append((mean[1] - mean[0]) / max(mean))
    assert many < 2 * few
    assert small == large == [(o, round(float(np.mean(known[o])), 9), len(known[o])) for o in (0, 1)]
    df.unpersist()


def test_bins_fit_the_density(spark):
    """A dense square starts with small bins; copies of one place stop at once, and results don't change."""
    from hexagrove.operators import context

    dense = spark.range(10000).selectExpr("id", "(id % 100) / 100D AS x", "floor(id / 100) / 100D AS y", "1D AS w", "cast(id as double) AS v")
    assert context.fitting(dense, 1.0, 4.0) <= 1 / 64 and context.fitting(dense.withColumn("x", F.lit(0.5)).withColumn("y", F.lit(0.5)), 1.0, 4.0) == 1.0
    out = {r["id"]: (r["oid"], round(r["distance"], 9)) for r in context.nearest(dense.where("id % 7 = 0"), dense.where("id % 7 <> 0"), 1.0).collect()}
    assert len(out) == 1429 and out[0] == (1, 0.01) and out[350] == (250, 0.01)


def test_runs_of_kmeans_share_their_passes(spark):
    """Sizes and costs are those of MLlib's own runs, in far fewer jobs than one a round of each run."""
    rng = np.random.default_rng(5)
    points = [(i, (rng.normal(size=4) + 100 * (i % 3)).tolist()) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(points, "id int, e array<double>").repartition(3, "id").persist()
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("kmeans together", "")
    found = factors.kmeans(df, "e", (3, 6, 9), (1, 2, 3)).collect()
    spark.sparkContext.setJobGroup("kmeans alone", "")
    rows, want = factors.vectors(df, "e").cache(), []
    for k in (3, 6, 9):
        best = min((KMeans(k=k, seed=seed, maxIter=50).fit(rows).summary for seed in (1, 2, 3)), key=lambda s: s.trainingCost)
        want += [(k, i, n, best.trainingCost) for i, n in enumerate(sorted(best.clusterSizes, reverse=True))]
    spark.sparkContext.setJobGroup("others", "")
    assert [tuple(r)[:3] for r in found] == [w[:3] for w in want]
    assert [r["cost"] for r in found] == pytest.approx([w[3] for w in want], rel=1e-9)
    assert jobs("kmeans together") < 0.8 * jobs("kmeans alone")
    df.unpersist()


def test_starts_of_kmeans_are_rows_and_all_run(spark, monkeypatch):
    """Every start begins at distinct rows, and the least cost of all, each settled alone in numpy, is the result."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(300, 3))
    points[200:] = points[:100]
    df = spark.createDataFrame([(p.tolist(),) for p in points] + [(None,)], "e array<double>")
    begun, plain = [], factors._pass
    monkeypatch.setattr(factors, "_pass", lambda rows, runs: begun.append([r.centres for r in runs]) or plain(rows, runs))
    found = factors.kmeans(df, "e", (3, 5), starts=6, rounds=500).collect()
    least = {}
    assert [len(c) for c in begun[0]] == [3] * 6 + [5] * 6 and len({c.tobytes() for c in begun[0]}) == 12
    for centres in begun[0]:
        assert len({tuple(c) for c in centres}) == len(centres) and all((points == c).all(axis=1).any() for c in centres)
        for moved in range(500):
            away = ((points[:, None] - centres) ** 2).sum(axis=2)
            new = np.array([points[away.argmin(axis=1) == i].mean(axis=0) for i in range(len(centres))])
            if ((new - centres) ** 2).sum(axis=1).max() <= 1e-8:
                break
            centres = new
        least[len(centres)] = min(least.get(len(centres), math.inf), away.min(axis=1).sum())
    assert {r["k"]: r["cost"] for r in found} == pytest.approx(least, rel=1e-9)


def test_kmeans_query_runs_fifty_starts(spark, monkeypatch):
    from hexagrove.plans import domain

    asked, begun, plain = {}, [], factors._pass
    monkeypatch.setattr(factors, "_pass", lambda rows, runs: begun.append([r.k for r in runs]) or plain(rows, runs))
    whole = factors.kmeans
    monkeypatch.setattr(factors, "kmeans", lambda *a, **o: asked.update(o) or whole(*a, **{**o, "rounds": 1}))
    domain.x9(spark, "/root/testdata/sf0.001")
    assert begun[0] == [k for k in range(5, 11) for _ in range(50)] and asked["rounds"] == 500
