"""Audit of fields by which a layer could be split (X15), and the helpers that it rests on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexagrove.functions.scalars import round_even
from hexagrove.operators.classes import binned, quantile_breaks

# Parts of field names that carry meaning, those of bookkeeping fields, and texts that count as unknown.
SEMANTIC = (
    "kategori klasse class type mb_type navn name operator ref$ bred width kw power effekt kapac rotor hoejd height netvaerk network vandloeb water natyp natur "
    "anvendelse faldret synlig route ferry habitat bird ramsar reservat zone funktion formaal use"
).split()
METADATA = (
    "^fid$ ^id$ _id$ ^gid$ objectid globalid uuid shape_ ^h3$ ^hex_ gmlid lokalid registrer registre registreri forret plannoe plansted vertikal applik virkning kommentar "
    "aendr sagsbeh vedlige indsam godkend ksstatus ^status$ statuskode oprind geometriop service specifik created updated dato date timestamp minim"
).split()
UNKNOWN = ("", "NA", "NULL", "<NA>")
MOST_CATEGORIES = 8


def auditable(field: str) -> bool:
    name = field.lower()
    return not re.search("|".join(METADATA), name) and bool(re.search("|".join(SEMANTIC), name))


def profiles(df: DataFrame, metric: str) -> DataFrame:
    """Rows (field, field_type, category, metric): each auditable field's categories with the sum of ``metric``.

    Truth values and texts of 2 to 8 categories stay; numbers of more than 8 values are cut at their thirds. Distinct
    values are counted in the long form of all fields at once; categories are at most eight a field from there on.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name != metric and auditable(f.name)}
    numbers = [c for c, t in kinds.items() if isinstance(t, T.NumericType)]
    texts = [c for c, t in kinds.items() if isinstance(t, (T.StringType, T.BooleanType))]

    def text(c: str):
        v = F.trim(F.upper(F.col(c).cast("string")) if isinstance(kinds[c], T.BooleanType) else F.col(c).cast("string"))
        v = F.when(~v.isin(*UNKNOWN), v)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), v) if c in numbers and isinstance(kinds[c], (T.DoubleType, T.FloatType)) else v

    fields = [*texts, *numbers]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, field_type string, category string, metric double")
    long = df.select(F.col(metric).cast("double").alias("m"), F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text(c).alias("category")) for c in fields))).alias("e"))
    sums = long.where("e.category is not null").groupBy("e.field", "e.category").agg(F.sum("m").alias("metric"))
    n = dict(sums.groupBy("field").agg(F.count(F.lit(1))).collect())
    kept = {c: "logical" if isinstance(kinds[c], T.BooleanType) else "numeric_group" if c in numbers else "categorical" for c in fields if 2 <= n.get(c, 0) <= MOST_CATEGORIES}
    name = F.create_map(*(F.lit(x) for kv in (kept or {"": ""}).items() for x in kv))
    out = sums.where(F.col("field").isin(*kept)).select("field", name[F.col("field")].alias("field_type"), "category", "metric")
    for c in (c for c in numbers if n.get(c, 0) > MOST_CATEGORIES):
        breaks = quantile_breaks(df, c, 3)
        if len(breaks) < 4:
            continue
        label = F.get(F.array(*(F.lit(f"{a:g}-{b:g}") for a, b in zip(breaks, breaks[1:]))), F.col("__bin") - 1)
        cut = binned(df.select(c, F.col(metric).cast("double").alias("m")), c, breaks, "__bin").where("__bin is not null")
        out = out.union(cut.groupBy(F.lit(c).alias("field"), F.lit("numeric_binned").alias("field_type"), label.alias("category")).agg(F.sum("m").alias("metric")))
    return out


def split_candidates(df: DataFrame, metric: str) -> DataFrame:
    """One row for each auditable field with a positive total: shares of its largest categories, score, and whether a split is
    suggested (a score of 4 or more).

    Two points for 2 to 4 categories (one for 5 or 6), two for two categories of 5 % or more, one for a largest
    share of 85 % or less, one for anything but grouped numbers.
    """
    whole, by = Window.partitionBy("field"), Window.partitionBy("field").orderBy(F.desc("metric"), "category")
    ranked = profiles(df, metric).withColumn("total", F.sum("metric").over(whole)).where("total > 0").withColumn("share", F.col("metric") / F.col("total")).withColumn("place", F.row_number().over(by))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "category", "share")))), lambda x: F.concat(x["category"], F.lit(" ("), F.format_number(x["share"] * 100, 1), F.lit("%)"))), "; ")
    out = ranked.groupBy("field", "field_type").agg(
        F.count(F.lit(1)).alias("n_categories"), round_even(F.max("share"), 4).alias("dominant_share"), round_even(F.coalesce(F.max(F.when(F.col("place") == 2, F.col("share"))), F.lit(0.0)), 4).alias("second_share"),
        F.count_if(F.col("share") >= 0.05).alias("significant_categories"), F.max("share").alias("__top"), top.alias("top_values"),
    )
    n = F.col("n_categories")
    score = F.when(n.between(2, 4), 2).when(n.between(5, 6), 1).otherwise(0) + F.when(F.col("significant_categories") >= 2, 2).otherwise(0) + F.when(F.col("__top") <= 0.85, 1).otherwise(0) + F.when(F.col("field_type") != "numeric_group", 1).otherwise(0)
    return out.withColumn("score", score).withColumn("suggested_split", F.col("score") >= 4).drop("__top")
