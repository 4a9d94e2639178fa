"""Feature matrix, siting and audit on fixtures of a few rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from hexagrove.operators import audit, features, shapes, siting, stage_one, statistics


def test_feature_matrix_keeps_one_row_per_cell(spark):
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "hex_id string")
    rows = [("a", 1.0), ("b", 2.0)]
    protected, wind, people, heights = (spark.createDataFrame(rows, f"hex_id string, {c} double") for c in ("protected_share", "dist_turbine_log", "persons_log", "relief"))
    out = {r["hex_id"]: r for r in features.feature_matrix(cells, "hex_id", protected, wind, people, heights).collect()}
    assert len(out) == 3 and out["a"][1:] == (1.0, 1.0, 1.0, 1.0) and out["c"][1:] == (0.0, None, None, None)


def test_heights_need_a_known_column(spark):
    assert features.elevation_column(["x", "kote", "HEIGHT"]) == "kote"
    with pytest.raises(KeyError):
        features.elevation_column(["x"])


def test_no_features_give_zeros(spark):
    cells = shapes.squares_as_shapes(spark.createDataFrame([(0, 0), (1, 0)], "bx long, by long"), 1.0).select(F.col("bx").alias("cell"), "square")
    none = spark.createDataFrame([], "at struct<kind:string,paths:array<array<struct<x:double,y:double>>>>, height double")
    out = features.elevation(cells, none, "cell", "square", "at", 1.0).collect()
    assert [(r["elev_min"], r["relief"]) for r in out] == [(None, 0.0)] * 2
    assert {r["protected_share"] for r in features.protected_share(cells, none, "cell", "square", "at", 1.0).collect()} == {0.0}


def test_group_layer_of_unknown_distances(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "cell long")
    distances = spark.createDataFrame([(1, "g", 50.0, False), (2, "g", 250.0, None)], "cell long, group_id string, distance_m double, intersects boolean")
    df, summary = siting.group_layer(base, distances, "g", "Group", "distance_conflict", 100.0, ["one"])
    out = {r["cell"]: (r["group_acceptance"], r["group_blocked"]) for r in df.collect()}
    assert out == {1: (0.0, 1), 2: (1.0, 0), 3: (0.0, 0)}
    assert summary.first()["blocked_share"] == pytest.approx(1 / 3)


def test_group_quantiles_with_ties_and_unknown_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0), ("a", 2.0), ("a", 10.0), ("b", None)]
    out = statistics.group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"mid": (0.5, 7), "top": (0.9, 7)})
    assert {r["g"]: (r["mid"], pytest.approx(r["top"])) for r in out.collect()} == {None: (2.0, 2.8), "a": (2.0, 7.6)}


def test_equal_parts(spark):
    rows = [(g, i) for g, n in (("a", 10), ("b", 3), (None, 4)) for i in range(n)]
    out = statistics.ntile_of(spark.createDataFrame(rows, "g string, i int").repartition(3), ["g"], [F.col("i")], 4, "part")
    parts = {}
    for r in out.collect():
        parts.setdefault(r["g"], {})[r["i"]] = r["part"]
    assert [parts["a"][i] for i in range(10)] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert list(map(parts["b"].get, range(3))) == [1, 2, 3] and list(map(parts[None].get, range(4))) == [1, 2, 3, 4]


def test_stage_one_rules_at_their_limits(spark):
    names = ["settlement", "road_large", "road_medium", "culture", "protected", "bird", "electrical"]
    flags = ["culture", "protected", "military", "approach", "strand", "coastal"]
    free = {"settlement": 5000.0, "road_large": 5000.0, "road_medium": 5000.0, "culture": 5000.0, "protected": 5000.0, "bird": math.inf, "electrical": 0.0}
    cases = [free, free | {"settlement": 250.0}, free | {"settlement": 251.0}, free | {"bird": 2000.0}, free | {"electrical": 3001.0}, free | {"settlement": None}]
    rows = [(i, *(c[n] for n in names), *([i == 5 and f == "coastal" for f in flags]), 2, 1.0, 1.0) for i, c in enumerate(cases)]
    schema = "id int, " + ", ".join(f"dist_{n} double" for n in names) + ", " + ", ".join(f"in_{f} boolean" for f in flags) + ", class_km int, plateau double, slope double"
    out = {(r["id"], r["scenario"]): r for r in stage_one.acceptance(spark.createDataFrame(rows, schema), "id").collect()}
    assert len(out) == 18 and out[0, "low_acceptance"]["score"] == pytest.approx(100 * (0.35 + 0.45 + 0.2 * 0.85))
    allowed = {k: [i for i in range(6) if out[i, k]["allowed"]] for k in stage_one.SCENARIOS}
    assert allowed == {"high_acceptance": [0, 2, 3, 4, 5], "medium_acceptance": [0, 3, 4], "low_acceptance": [0]}
    assert out[1, "high_acceptance"]["class"] == stage_one.EXCLUDED and out[1, "high_acceptance"]["reason"] == stage_one.REASONS["settlement"]


def test_audit_leaves_bookkeeping_out(spark):
    assert audit.auditable("mb_type") and audit.auditable("Use_Flag") and not audit.auditable("objectid") and not audit.auditable("colour") and not audit.auditable("status")
    rows = [(["a", "b", " NA ", None][i % 4], i % 3 == 0, float(i), 1.0) for i in range(40)]
    out = {r["field"]: r for r in audit.split_candidates(spark.createDataFrame(rows, "type string, use_flag boolean, power double, m double"), "m").collect()}
    assert {f: (r["field_type"], r["n_categories"], r["suggested_split"]) for f, r in out.items()} == {"type": ("categorical", 2, True), "use_flag": ("logical", 2, True), "power": ("numeric_binned", 3, True)}
    assert out["type"]["top_values"] == "a (50.0%); b (50.0%)"
    assert audit.split_candidates(spark.createDataFrame([(1, 1.0)], "colour int, m double"), "m").count() == 0
