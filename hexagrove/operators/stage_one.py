"""Stage-one wind acceptance (D23): ten blocking rules in three scenarios, weighted scores, quartile classes and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.functions.scalars import clip
from hexagrove.operators.statistics import group_quantiles, ntile_of

# Fixed values of the model: limits by scenario in metres, weights of the three scores, preferences of landscape clusters, the
# parts of the clearance and landscape scores, classes from the lowest quarter up, and reasons in the order of the rules.
SCENARIOS = {
    "high_acceptance": {"settlement": 250, "road_large": 75, "road_medium": 25, "bird": 0, "electrical": 7000, "coastal": False},
    "medium_acceptance": {"settlement": 300, "road_large": 100, "road_medium": 50, "bird": 0, "electrical": 5000, "coastal": True},
    "low_acceptance": {"settlement": 600, "road_large": 175, "road_medium": 100, "bird": 2000, "electrical": 3000, "coastal": True},
}
WEIGHTS = {"grid": 0.35, "clearance": 0.45, "landscape": 0.20}
PREFERENCE = {"1": 0.10, "2": 1.00, "3": 0.35, "4": 0.50, "5": 0.25}
CLASSES = ("Lag", "Medel", "Hog", "Mycket hog")
EXCLUDED, NO_REASON = "Exkluderad", "Ingen blockerande regel utloste"
REASONS = {
    "settlement": "For nara bosattning eller bebyggelse", "transport": "For nara transportinfrastruktur", "culture": "For nara kulturmiljo", "protected": "I skyddat omrade",
    "military": "I militart omrade", "approach": "I inflygningszon", "strand": "I strandskydd", "coastal": "I 3 km kustzone", "bird": "For nara fagelkollisionszon",
    "electrical": "For langt fran elinfrastruktur",
}


def _rising(x: Column, low: float, high: float) -> Column:
    """0 to 1 between two distances; no feature at all, an infinite distance, is 1."""
    return F.when(x == float("inf"), 1.0).otherwise(clip((x - low) / (high - low), 0.0, 1.0))


def _falling(x: Column, high: float) -> Column:
    return F.when(x == float("inf"), 0.0).otherwise(clip((high - x) / high, 0.0, 1.0))


def scored(df: DataFrame) -> DataFrame:
    """``df`` with the grid, clearance (without and with birds) and landscape scores.

    Columns: dist_settlement, dist_road_large, dist_road_medium, dist_culture, dist_protected, dist_bird and dist_electrical in metres,
    infinite where the layer has no feature; class_km, plateau, slope. Plateau and slope are cut at their 0.95 quantiles.
    """
    one = df.withColumn("__all", F.lit(1))
    caps = {}
    for column in ("plateau", "slope"):
        found = group_quantiles(one, ["__all"], column, {"cap": (0.95, 7)}).first()
        caps[column] = float(found["cap"]) if found and found["cap"] and found["cap"] > 0 else 1.0
    d = {n: F.col(f"dist_{n}") for n in ("settlement", "road_large", "road_medium", "culture", "protected", "bird", "electrical")}
    parts = {
        "settlement": _rising(d["settlement"], 250, 4000), "transport": _rising(F.least(d["road_large"], d["road_medium"]), 25, 1500),
        "culture": _rising(d["culture"], 0, 1500), "protected": _rising(d["protected"], 0, 1500), "bird": _rising(d["bird"], 0, 2000),
    }
    calm = 0.30 * parts["settlement"] + 0.15 * parts["transport"] + 0.20 * parts["culture"] + 0.20 * parts["protected"]
    cluster = reduce(lambda c, kv: c.when(F.col("class_km").cast("string") == kv[0], kv[1]), PREFERENCE.items(), F.when(F.lit(False), 0.0)).otherwise(0.5)
    landscape = 0.60 * cluster + 0.25 * F.least(F.col("plateau") / caps["plateau"], F.lit(1.0)) + 0.15 * (1 - F.least(F.col("slope") / caps["slope"], F.lit(1.0)))
    return df.withColumns({"score_grid": _falling(d["electrical"], 7000), "score_clearance": calm / 0.85, "score_clearance_bird": calm + 0.15 * parts["bird"], "score_landscape": landscape})


def conflicts(limits: dict) -> dict[str, Column]:
    """The ten rules of a scenario; unknown flags and distances don't block."""
    at = lambda n: F.col(f"dist_{n}")
    rules = {
        "settlement": at("settlement") <= limits["settlement"],
        "transport": (at("road_large") <= limits["road_large"]) | (at("road_medium") <= limits["road_medium"]),
        **{n: F.col(f"in_{n}") for n in ("culture", "protected", "military", "approach", "strand")},
        "coastal": F.col("in_coastal") if limits["coastal"] else F.lit(False),
        "bird": at("bird") <= limits["bird"] if limits["bird"] > 0 else F.lit(False),
        "electrical": at("electrical") > limits["electrical"],
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}


def acceptance(df: DataFrame, key: str, scenarios: dict[str, dict] | None = None) -> DataFrame:
    """Rows (key, scenario, blocking_rule_count, allowed, score, class, reason) of every cell in every scenario.

    Allowed cells are ranked by score, equal ones by key, and cut into quarters by range partitions.
    """
    parts = []
    for name, limits in (scenarios or SCENARIOS).items():
        rules = conflicts(limits)
        count = reduce(lambda a, b: a + b, (c.cast("int") for c in rules.values()))
        reason = F.concat_ws("; ", *(F.when(c, F.lit(REASONS[n])) for n, c in rules.items()))
        clearance = F.col("score_clearance_bird") if limits["bird"] > 0 else F.col("score_clearance")
        score = 100 * (WEIGHTS["grid"] * F.col("score_grid") + WEIGHTS["clearance"] * clearance + WEIGHTS["landscape"] * F.col("score_landscape"))
        parts.append(F.struct(F.lit(name).alias("scenario"), count.alias("blocking_rule_count"), (count == 0).alias("allowed"), F.when(count == 0, score).otherwise(0.0).alias("score"), F.when(reason == "", NO_REASON).otherwise(reason).alias("reason")))
    long = scored(df).select(key, F.inline(F.array(*parts)).alias("scenario", "blocking_rule_count", "allowed", "score", "reason"))
    ranked = ntile_of(long.where("allowed and score is not null").select(key, "scenario", "score"), ["scenario"], [F.col("score"), F.col(key)], 4, "quarter").select(key, "scenario", "quarter")
    label = F.coalesce(F.get(F.array(*map(F.lit, CLASSES)), F.col("quarter") - 1), F.lit(EXCLUDED))
    return long.join(ranked, [key, "scenario"], "left").withColumn("class", label).drop("quarter")
