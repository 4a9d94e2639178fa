"""Siting of wind and solar on cells: scores, areas, group layers, roll-ups and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.functions import globe, hexgrid
from hexagrove.functions.scalars import bounded_class, class_of, clip, round_even
from hexagrove.operators import potential
from hexagrove.operators.allocation import running_totals
from hexagrove.operators.statistics import BREAKS, overall_quantile_type8

#: Points that the wind score starts with, gains and loses (fixed values; each may be overridden).
WIND = {
    "base_score": 54.0, "everyday_matrix_bonus": 12.0, "infrastructure_bonus": 6.0, "settlement_penalty": 22.0, "road_penalty": 6.0,
    "coastal_penalty": 14.0, "terrain_penalty": 10.0, "protected_penalty": 18.0, "factor_positive_cap": 2.0, "landscape_sensitivity": 1.0,
}
#: A core score from which a cell counts as deep in its zone (a fixed value).
DEEP_CORE = 0.72


def wind_score(df: DataFrame, cluster: str, everyday: list[str], roles: dict[str, list[str]], params: dict[str, float] | None = None, breaks=BREAKS) -> DataFrame:
    """The raw wind score, and cut to 0..100 with one decimal with its class. ``roles``: factor columns of settlement, coastal,
    terrain and protected landscapes; ``everyday``: clusters of which any earns the bonus. Landscape penalties, not those of
    settlement and roads, scale with the sensitivity."""
    p = WIND | (params or {})
    part = {role: potential.positive_mean(columns, p["factor_positive_cap"]) if columns else F.lit(0.0) for role, columns in roles.items()}
    raw = F.lit(p["base_score"]) + F.when(F.col(cluster).cast("string").isin(everyday), p["everyday_matrix_bonus"]).otherwise(0.0)
    raw = raw + part["settlement"] * (p["infrastructure_bonus"] - p["settlement_penalty"] - p["road_penalty"])
    for role in ("coastal", "terrain", "protected"):
        raw = raw - part[role] * p[f"{role}_penalty"] * p["landscape_sensitivity"]
    df = df.withColumn("wind_score_raw", raw).withColumn("wind_score", round_even(clip(F.col("wind_score_raw"), 0.0, 100.0), 1))
    return df.withColumn("wind_class", class_of(F.col("wind_score"), breaks))


def _area_m2(level: int) -> float:
    return globe.average_area_km2(level) * 1e6


def _shares(df: DataFrame, level: int, breaks) -> DataFrame:
    """Area in km2, share of the cell in percent, score and class of ``potential_area_m2``."""
    df = df.withColumn("potential_area_km2", F.col("potential_area_m2") / 1e6).withColumn("potential_area_share_pct", clip(F.col("potential_area_m2") / _area_m2(level) * 100, 0.0, 100.0))
    return df.withColumn("solar_score", round_even(F.col("potential_area_share_pct"), 1)).withColumn("solar_class", class_of(F.col("solar_score"), breaks))


def large_scale_solar(source: DataFrame, target: DataFrame, filters: DataFrame, source_level: int, level: int, share: str = "filter_share_pct", breaks=BREAKS) -> DataFrame:
    """Area left to large-scale solar: what the filters leave of each source cell, summed by target cell and cut to its area.

    Cells without a filter row are free; target cells without source cells have nothing. ``filters`` has one row a cell.
    """
    whole = _area_m2(source_level)
    taken = clip(F.coalesce(F.col(share), F.lit(0.0)), 0.0, 100.0)
    work = source.select("cell").join(filters.select("cell", share), "cell", "left")
    cell = hexgrid.parent(F.col("cell"), level) if level < source_level else F.col("cell")
    sums = work.select(cell.alias("cell"), ((100 - taken) / 100 * whole).alias("free"), (taken / 100 * whole).alias("taken")).groupBy("cell").agg(F.sum("free").alias("free"), F.sum("taken").alias("taken"))
    most = _area_m2(level)
    df = target.join(sums, "cell", "left").withColumn("potential_area_m2", clip(F.coalesce("free", F.lit(0.0)), 0.0, most))
    df = df.withColumn("protected_buffer_share_pct", clip(F.coalesce("taken", F.lit(0.0)) / most * 100, 0.0, 100.0)).drop("free", "taken")
    return _shares(df, level, breaks)


def combined_solar(base: DataFrame, small: DataFrame, large: DataFrame, level: int, breaks=BREAKS) -> DataFrame:
    """Small-scale (cell, score, area_m2) and large-scale areas on the base cells, their sum cut to the cell, and which is larger."""
    known = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    df = base.join(small.select("cell", F.col("score").alias("small_score"), F.col("area_m2").alias("small_area_m2")), "cell", "left")
    df = df.join(large.select("cell", F.col("solar_score").alias("large_score"), F.col("potential_area_m2").alias("large_area_m2")), "cell", "left")
    df = df.withColumns({"small_score": F.coalesce("small_score", F.lit(0.0)), "large_score": F.coalesce("large_score", F.lit(0.0)), "small_area_m2": known("small_area_m2"), "large_area_m2": known("large_area_m2")})
    df = df.withColumn("potential_area_m2", clip(F.col("small_area_m2") + F.col("large_area_m2"), 0.0, _area_m2(level)))
    group = F.when((F.col("small_area_m2") >= F.col("large_area_m2")) & (F.col("small_area_m2") > 0), "small").when(F.col("large_area_m2") > 0, "large").otherwise("none")
    return _shares(df.withColumn("solar_group", group), level, breaks)


def group_layer(base: DataFrame, distances: DataFrame, group: str, label: str, kind: str, threshold: float, sources: list[str], cell: str = "cell", unknown: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A group's acceptance on each base cell, with conflict, blocked flag and tooltip; and one row of its blocked share and mean.

    Cells without any distance have acceptance ``unknown`` (0 in the reference) and, but for hard exclusions of known distances, are not blocked.
    """
    own = potential.group_distances(distances.where(F.col("group_id") == group), cell).drop("group_id")
    value, blocked = potential.acceptance(kind, F.col("distance_m"), F.col("intersects"), threshold)
    names = ", ".join(sources)
    df = base.join(own, cell, "left").withColumns({"group_id": F.lit(group), "group_label": F.lit(label), "selected_sources": F.lit(names)})
    known = F.col("distance_m").isNotNull() | F.coalesce("intersects", F.lit(False))
    df = df.withColumn("group_acceptance", F.when(known, F.coalesce(value, F.lit(0.0))).otherwise(unknown)).withColumn("group_conflict", clip(1 - F.col("group_acceptance"), 0.0, 1.0)).withColumn("group_blocked", (known & blocked).cast("int"))
    text = F.concat(F.lit(f"Selected sources: {names}<br/>Analysis type: {kind}<br/>Threshold: {int(threshold)} m<br/>Nearest source: "), F.coalesce(round_even(F.col("distance_m"), 1).cast("string"), F.lit("nan")), F.lit(" m<br/>Acceptance: "), round_even(F.col("group_acceptance"), 2).cast("string"), F.lit("<br/>Blocked: "), F.col("group_blocked").cast("string"))
    df = df.withColumn("tooltip_title", F.lit(f"Group layer: {label}")).withColumn("tooltip_body", text)
    summary = df.agg(F.lit(group).alias("group_id"), F.count(F.lit(1)).alias("cells"), F.avg("group_blocked").alias("blocked_share"), F.avg("group_acceptance").alias("mean_acceptance"))
    return df, summary


def allocation_rollup(selected: DataFrame, level: int) -> DataFrame:
    """Allocated cells at a coarser resolution: least rank, summed areas and energy, largest core and ring, and whether more of
    the area lies outside the local plan than inside."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out_there = F.coalesce(F.col("outside"), F.lit(False))
    work = selected.withColumn("cell", hexgrid.parent(F.col("cell"), level))
    rolled = work.groupBy("cell").agg(
        F.min(F.coalesce("selected_rank", F.lit(0))).alias("selected_rank"),
        *(F.sum(number(c)).alias(c) for c in ("potential_area_km2", "allocated_area_km2", "allocated_twh")),
        F.sum(F.when(out_there, number("allocated_area_km2")).otherwise(0.0)).alias("outside_area_km2"),
        F.sum(F.when(out_there, 0.0).otherwise(number("allocated_area_km2"))).alias("inside_area_km2"),
        F.max(number("core_score")).alias("core_score"), F.sum(F.coalesce("zone_size", F.lit(0))).alias("zone_size"), F.max(F.coalesce("expansion_ring", F.lit(0))).alias("expansion_ring"),
    )
    whole = globe.average_area_km2(level)
    rolled = rolled.withColumn("outside", F.col("outside_area_km2") > F.col("inside_area_km2"))
    return rolled.withColumns({"potential_area_share_pct": clip(F.col("potential_area_km2") / whole * 100, 0.0, 100.0), "allocated_cell_share_pct": clip(F.col("allocated_area_km2") / whole * 100, 0.0, 100.0), "allocated_gwh": F.col("allocated_twh") * 1000})


def factor_rollup(df: DataFrame, level: int, factors: list[str], types: list[str]) -> DataFrame:
    """Means of factors and the most frequent of each type by parent cell, the least of equally frequent ones; null where all are.

    Types are counted by one grouping of (parent, column, value), so no buffer holds a cell's values.
    """
    up = df.withColumn("cell", hexgrid.parent(F.col("cell"), level))
    means = up.groupBy("cell").agg(*(F.avg(f).alias(f) for f in factors))
    if not types:
        return means
    long = up.select("cell", F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.col(t).cast("string").alias("value")) for t in types))).alias("e"))
    counts = long.where("e.value is not null").groupBy("cell", "e.type", "e.value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cell", "type").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    wide = best.groupBy("cell").pivot("type", types).agg(F.first("value"))
    typed = wide.select("cell", *(F.col(t).cast(df.schema[t].dataType).alias(t) for t in types))
    return means.join(typed, "cell", "left")


def core_class_summary(df: DataFrame) -> DataFrame:
    """Cells, mean share and deep-core cells by share class (class_index, class_id)."""
    index = F.coalesce(F.col("class_index").cast("int"), F.lit(999))
    work = df.withColumn("class_index", index).withColumn("share", F.coalesce(F.col("potential_area_share_pct"), F.lit(0.0)))
    deep = (F.coalesce("core_score", F.lit(0.0)) >= DEEP_CORE).cast("long")
    return work.groupBy("class_index", "class_id").agg(F.count("cell").alias("cells"), round_even(F.avg("share"), 1).alias("mean_share"), F.sum(deep).alias("deep_cores"))


def candidate_summary(df: DataFrame, candidate: str = "potential_area", acceptance: str = "acceptance") -> DataFrame:
    """One row: candidate cells, their share in percent and the mean acceptance; zeros without rows."""
    flag = F.coalesce(F.col(candidate), F.lit(False)).cast("double")
    return df.agg(F.coalesce(F.sum(flag), F.lit(0.0)).cast("long").alias("candidate_cells"), F.coalesce(F.avg(flag) * 100, F.lit(0.0)).alias("candidate_share"), F.coalesce(F.avg(acceptance), F.lit(0.0)).alias("mean_acceptance"))


def context_weights(df: DataFrame, layers: list[tuple[str, str, str, float]], strategy: str = "raw_sum", rescale: str = "none", by_theme: bool = False, geometry_weights: dict[str, float] | None = None, theme_weights: dict[str, float] | None = None, p: float = 0.99) -> DataFrame:
    """``df`` with ``raw_total``, the weight ``total`` of each cell, and with ``geometry_balanced_q99`` a score for each geometry type.

    ``layers``: (column, geometry type, theme, weight). Balanced, a layer is cut at its quantile ``p`` of positive values and scaled
    to 1; layers are averaged by weight within a geometry (or by theme within it), geometries by theirs. ``rescale``: ``none``,
    ``match_raw_total_sum``, ``n_input_layers`` or ``target_mean_1``. Quantiles come from range partitions, one for each layer.
    """
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = df.withColumn("raw_total", reduce(lambda a, b: a + b, (known(c) for c, *_ in layers)))
    if strategy == "raw_sum":
        return df.withColumn("total", F.col("raw_total"))
    if strategy != "geometry_balanced_q99":
        raise ValueError(f"unknown strategy {strategy}")
    if rescale not in ("none", "match_raw_total_sum", "n_input_layers", "target_mean_1"):
        raise ValueError(f"unknown rescaling {rescale}")
    scaled = {}
    for column, *_ in layers:
        cap = overall_quantile_type8(df.where(F.col(column) > 0), column, p).first()
        scaled[column] = clip(known(column) / float(cap[0]), 0.0, 1.0) if cap and cap[0] else F.lit(0.0)

    def mean(parts: list[tuple[Column, float]]) -> Column:
        total = sum(w for _, w in parts)
        return reduce(lambda a, b: a + b, (c * w for c, w in parts)) / (total if total > 0 else len(parts))

    scores = {}
    for geometry in sorted({g for _, g, _, _ in layers}):
        own = [(c, t, w) for c, g, t, w in layers if g == geometry]
        if by_theme:
            themes = [(mean([(scaled[c], w) for c, t, w in own if t == theme]), (theme_weights or {}).get(theme, 1.0)) for theme in sorted({t for _, t, _ in own})]
            scores[geometry] = mean(themes)
        else:
            scores[geometry] = mean([(scaled[c], w) for c, _, w in own])
    df = df.withColumns({f"weight_{g}": s for g, s in scores.items()})
    df = df.withColumn("total_base", mean([(F.col(f"weight_{g}"), (geometry_weights or {}).get(g, 1.0)) for g in scores]))
    base, raw, n = df.agg(F.sum("total_base"), F.sum("raw_total"), F.count(F.lit(1))).first()
    factor = 1.0 if not base or base <= 0 else {"none": 1.0, "match_raw_total_sum": raw / base, "n_input_layers": float(len(layers)), "target_mean_1": n / base}[rescale]
    return df.withColumn("total", F.col("total_base") * factor)


def scale_summary(contexts: DataFrame, families: dict[str, list[int]], k: str = "k", radius: str = "radius") -> DataFrame:
    """Radius statistics of each scale family (X12): (family, k) with mean, least and largest radius of the neighbourhoods."""
    rows = [(f, n) for f, ks in families.items() for n in ks]
    family = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(n).alias("k")) for f, n in rows))
    long = contexts.withColumn("f", F.explode(F.filter(family, lambda x: x["k"] == F.col(k))))
    return long.groupBy("f.family", F.col("f.k").alias("k")).agg(F.avg(radius).alias("mean_radius"), F.min(radius).alias("least_radius"), F.max(radius).alias("largest_radius"), F.count(F.lit(1)).alias("n"))



#: Upper bounds of the panel area classes in square metres (fixed values); more is very high.
PANEL_CLASSES = [(0.0, "none"), (25.0, "very_low"), (100.0, "low"), (250.0, "medium"), (1000.0, "high")]


def small_solar(base: DataFrame, population: DataFrame, m2_per_person: float) -> DataFrame:
    """Panel area of each base cell from its people, its score on a log scale to the largest area, and its class by area."""
    people = F.greatest(F.coalesce(F.col("population").cast("double"), F.lit(0.0)), F.lit(0.0))
    df = base.join(population.select("cell", "population"), "cell", "left").withColumn("population", people).withColumn("area_m2", F.col("population") * max(0.0, m2_per_person))
    top = F.broadcast(df.agg(F.max("area_m2").alias("__top")))
    score = F.when(F.col("__top") > 0, round_even(clip(F.log1p("area_m2") / F.log1p("__top") * 100, 0.0, 100.0), 1)).otherwise(0.0)
    return df.crossJoin(top).withColumn("score", score).withColumn("solar_class", bounded_class(F.col("area_m2"), PANEL_CLASSES, "very_high")).drop("__top")


def solar_allocation(small: DataFrame, large: DataFrame, need_km2: float, need_twh: float, km2_per_twh: float, cell_km2: float) -> tuple[DataFrame, DataFrame]:
    """Small-scale cells before large-scale ones, by falling score and area, until the need is met; and one row of totals.

    ``small`` and ``large``: cell, score, area_km2. Large areas are cut to the cell. Energy follows the area by
    ``km2_per_twh``, or where it is unknown by the share of the need. Ranks and sums come from range partitions.
    """
    known = lambda df, name, order: df.where("area_km2 > 0").select("cell", F.lit(name).alias("source_group"), F.lit(order).alias("sort_group"), F.coalesce("score", F.lit(0.0)).alias("potential_score"), F.col("area_km2").cast("double").alias("potential_area_km2"))
    both = known(small, "small", 0).unionByName(known(large.where("score > 0"), "large", 1).withColumn("potential_area_km2", F.least("potential_area_km2", F.lit(cell_km2))))
    ranked = running_totals(both, [F.col("sort_group"), F.desc("potential_score"), F.desc("potential_area_km2"), F.col("cell")], "potential_area_km2")
    left = F.lit(float(max(0.0, need_km2))) - F.col("__before")
    df = ranked.where(left > 1e-9).withColumn("allocated_area_km2", F.least("potential_area_km2", left)).withColumn("remaining_area_after_km2", F.greatest(F.lit(0.0), left - F.col("allocated_area_km2")))
    energy = F.col("allocated_area_km2") / km2_per_twh if 0 < km2_per_twh < float("inf") else F.col("allocated_area_km2") * (need_twh / need_km2 if need_km2 > 0 else 0.0)
    df = df.withColumn("allocated_twh", energy).withColumn("allocated_cell_share_pct", F.col("allocated_area_km2") / cell_km2 * 100).withColumnRenamed("__rank", "selected_rank").drop("__before")
    known_all = both.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum("potential_area_km2"), F.lit(0.0)).alias("candidate_area_km2"))
    sums = df.agg(F.coalesce(F.sum("allocated_area_km2"), F.lit(0.0)).alias("selected_area_km2"), F.count(F.lit(1)).alias("selected_cells"), F.coalesce(F.sum("allocated_twh"), F.lit(0.0)).alias("selected_twh"))
    totals = sums.crossJoin(known_all).withColumn("unmet_area_km2", F.greatest(F.lit(0.0), F.lit(float(need_km2)) - F.col("selected_area_km2")))
    return df, totals


def establishment(base: DataFrame, wind: DataFrame, solar: DataFrame) -> DataFrame:
    """Base cells with both technologies' allocations (cell, allocated_area_km2, outside_area_km2), the combined class, whether area
    outside the local plan is needed, and for what."""
    df = base.select("cell").distinct()
    for name, chosen in (("wind", wind), ("solar", solar)):
        own = chosen.groupBy("cell").agg(F.sum("allocated_area_km2").alias(f"{name}_area_km2"), F.sum("outside_area_km2").alias(f"{name}_outside_km2"))
        df = df.join(own, "cell", "left").withColumn(f"{name}_suitable", F.col(f"{name}_area_km2").isNotNull())
        df = df.withColumns({f"{name}_area_km2": F.coalesce(f"{name}_area_km2", F.lit(0.0)), f"{name}_outside_km2": F.greatest(F.coalesce(f"{name}_outside_km2", F.lit(0.0)), F.lit(0.0))})
    w, s, wo, so = F.col("wind_suitable"), F.col("solar_suitable"), F.col("wind_outside_km2") > 0, F.col("solar_outside_km2") > 0
    df = df.withColumn("establishment_class", F.when(w & s, "wind_and_solar").when(w, "wind_only").when(s, "solar_only").otherwise("not_suitable"))
    return df.withColumn("outside_shortage", wo | so).withColumn("outside_reason", F.when(wo & so, "vind + sol").when(wo, "vind").when(so, "sol").otherwise(""))
