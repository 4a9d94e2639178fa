"""Scalar functions: clipping, scaling, classes, text parsing, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null: ``greatest`` and ``least`` alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round_even(x: Column, digits: int) -> Column:
    """Half to even of the scaled double, as SQL and numpy round: ``bround`` takes the decimal text, in which 29.549999999999997 is below the half."""
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def finite(x: Column) -> Column:
    """Infinity and NaN become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rescale01(x: Column, low: Column, high: Column, reverse: bool = False, flat: float = 0.0) -> Column:
    """0-1 over ``low``..``high``; infinity is 1 (0 reversed), a flat range gives ``flat``."""
    inside = F.when(high > low, clip((x - low) / (high - low), 0.0, 1.0)).otherwise(flat)
    scaled = F.when(x == float("inf"), 1.0).otherwise(inside)
    return 1 - scaled if reverse else scaled


def transformed(x: Column, how: str) -> Column:
    """log1p, sqrt, asinh or none, of the non-negative part."""
    positive = F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    return {"log1p": F.log1p, "sqrt": F.sqrt, "asinh": F.asinh, "none": lambda c: x}[how](positive)


def class_of(score: Column, breaks: list[tuple[str, float, float]]) -> Column:
    """First ``[low, high)`` that holds the score, 100 closed; anything else is the last class."""
    out = None
    for name, low, high in breaks:
        hit = (score >= low) & (score < high) & ~F.isnan(score)
        if high == 100:
            hit = hit | (score == 100)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(breaks[-1][0])


def bounded_class(x: Column, bounds: list[tuple[float, str]], above: str) -> Column:
    """Ordered upper bounds: the first one that ``x`` does not exceed."""
    out = None
    for bound, name in bounds:
        out = F.when(x <= bound, name) if out is None else out.when(x <= bound, name)
    return out.otherwise(above)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y")


#: Letters without a plain decomposition that names are reduced by (fixed values).
FOLD = ("åäáàâãæöóòôõøéèêëíìîïúùûüñçÅÄÁÀÂÃÆÖÓÒÔÕØÉÈÊËÍÌÎÏÚÙÛÜÑÇ", "aaaaaaaooooooeeeeiiiiuuuuncAAAAAAAOOOOOOEEEEIIIIUUUUNC")


def folded(text: Column) -> Column:
    return F.translate(text, *FOLD)


def slug(text: Column, default: str = "item") -> Column:
    """ASCII letters and digits, other runs as one underscore, none at the ends."""
    plain = F.regexp_replace(F.lower(folded(text)), "[^a-z0-9]+", "_")
    trimmed = F.btrim(plain, F.lit("_"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(default)).otherwise(trimmed)


#: Words that tell a road's class (fixed values).
ROADS = (("large", "stor|motor|major|primary"), ("medium", "mellem|mellan|medium|secondary"), ("small", "lille|small|minor|local|residential"))


def road_class(text: Column) -> Column:
    """Later patterns win over earlier ones, so the chain asks for them first."""
    t = F.lower(folded(F.trim(text)))
    found = None
    for name, pattern in reversed(ROADS):
        found = F.when(t.rlike(pattern), name) if found is None else found.when(t.rlike(pattern), name)
    return found.otherwise("other")


def code_point_hash(text: Column, digits: int = 6) -> Column:
    """Sum of place times code point, modulo 16**digits, as hexadecimal."""
    total = F.aggregate(F.transform(F.split(text, ""), lambda c, i: F.ascii(c).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.lpad(F.lower(F.hex(F.pmod(total, F.lit(16**digits)))), digits, "0")


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


#: Characters that broken encodings and typography put for plain ones, in order (fixed values).
PLAIN = (("\u00a0", " "), ("Ãƒâ€šÃ‚Â±", "+/-"), ("Ã„â€¦", "+/-"), ("ÃƒÂ¢Ã¢â€šÂ¬Ã¢â‚¬Å“", "-"), ("Ã¢â‚¬â€œ", "-"), ("Ã¢Ë†â€™", "-"), ("Ã‚Â±", "+/-"), ("±", "+/-"), ("–", "-"))
#: White space at the ends, as a class of Unicode spaces.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def clean_text(text: Column) -> Column:
    """Trimmed, with plain dashes and "+/-"; a null text and the text "nan" are empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    out = trimmed
    for old, new in PLAIN:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.lower(trimmed) == "nan", "").otherwise(out)


def numbers(text: Column) -> Column:
    """All unsigned numbers of a text; a comma is a decimal point."""
    return _numbers(clean_text(text))


def _numbers(cleaned: Column) -> Column:
    plain = F.translate(cleaned, ",", ".")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def parsed_value(text: Column, unit: str = "gwh_km2") -> Column:
    """A struct of rule, source value and the low, mid and high area for a terawatt hour.

    One-sided bounds anywhere in the text count for the middle alone and not in scenarios; a plus-minus
    goes from the centre less the spread, where positive, to the centre plus it; the middle of a range is
    geometric, arithmetic if an end is 0. A text without numbers gives null.
    """
    # Arrays of one: the cleaned text, its numbers and the rule are computed once a row, not wherever they are named.
    cleaned = F.transform(F.array(clean_text(text)), lambda t: F.struct(t.alias("t"), _numbers(t).alias("n")))
    ruled = F.transform(cleaned, lambda v: F.struct(v["n"].alias("n"), _rule(v["t"], v["n"]).alias("rule")))
    return F.transform(ruled, lambda v: _parsed(v["n"], v["rule"], unit))[0]


def _rule(t: Column, n: Column) -> Column:
    two = F.size(n) >= 2
    return F.when(t.rlike("[<>≤≥]"), "one_sided_bound").when(two & t.contains("+/-"), "plus_minus").when(two & t.contains("-"), "range").otherwise("single_value")


def _parsed(n: Column, rule: Column, unit: str) -> Column:
    first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    low, high = F.least(first, second), F.greatest(first, second)
    middle = F.when(rule == "range", F.when(low > 0, F.sqrt(low * high)).otherwise((low + high) / 2)).otherwise(first)
    values = F.when(rule == "plus_minus", F.array(first, F.when(first > second, first - second), first + second)).when(rule == "range", F.array(low, middle, high)).when(rule == "single_value", F.array(first))
    areas = F.transform(values, lambda v: km2_per_twh(v, F.lit(unit)))
    mid = km2_per_twh(middle, F.lit(unit))
    parsed = F.struct(
        rule.alias("rule"),
        middle.alias("value"),
        F.array_min(areas).alias("low_km2_per_twh"),
        mid.alias("mid_km2_per_twh"),
        F.array_max(areas).alias("high_km2_per_twh"),
        ((rule != "one_sided_bound") & mid.isNotNull()).alias("used_in_scenarios"),
    )
    return F.when(F.size(n) > 0, parsed)


#: Terawatt hours in one of each unit (fixed values).
TWH = {"twh": 1.0, "gwh": 1e-3, "mwh": 1e-6, "pj": 1 / 3.6, "tj": 1 / 3600}


def to_twh(value: Column, unit: Column) -> Column:
    factor = F.create_map(*(F.lit(x) for pair in TWH.items() for x in pair))
    return value * F.coalesce(F.try_element_at(factor, F.lower(F.trim(unit))), F.lit(1.0))


def km2_per_twh(value: Column, unit: Column) -> Column:
    """From GWh per square kilometre, or from watts per square metre over a year of 8760 hours."""
    return F.when((unit == "gwh_km2") & (value > 0), 1000 / value).when((unit == "w_m2") & (value > 0), 1000 / (value * 8.76))


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent of the size of ``before``; 0 without one, null from zero to anything else."""
    now = F.coalesce(now, F.lit(0.0))
    grown = F.when(F.abs(before) >= 1e-9, (now - before) / F.abs(before) * 100).when(F.abs(now) < 1e-9, 0.0)
    return F.when(before.isNull(), 0.0).otherwise(grown)


def mixed_colour(a: str, b: str, share: Column) -> Column:
    """``#rrggbb`` between two colours."""
    parts = [F.lpad(F.lower(F.hex(F.bround(F.lit(int(a[i : i + 2], 16)) * (1 - share) + F.lit(int(b[i : i + 2], 16)) * share).cast("long"))), 2, "0") for i in (1, 3, 5)]
    return F.concat(F.lit("#"), *parts)


# Letters that references fold, also as they look when read in a wrong encoding.
REFERENCE_LETTERS = {"\u00e5": "a", "\u00e4": "a", "\u00f6": "o", "\u00f8": "o", "\u00e6": "ae", "\u00e3\u00a5": "a", "\u00e3\u00a4": "a", "\u00e3\u00b6": "o", "\u00e3\u00b8": "o", "\u00e3\u00a6": "ae"}


def reference_key(text: Column) -> Column:
    """A reference's text in lower case with folded letters and single spaces."""
    out = F.lower(clean_text(text))
    for letter in sorted(REFERENCE_LETTERS, key=len, reverse=True):
        out = F.replace(out, F.lit(letter), F.lit(REFERENCE_LETTERS[letter]))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def datasource(text: Column) -> Column:
    """(path, layer) of a data source ``path|layername=...|...``; no layer is empty."""
    parts = F.split(text, r"\|")
    layer = F.get(F.filter(parts, lambda p: p.startswith("layername=")), F.lit(0))
    return F.struct(parts[0].alias("path"), F.coalesce(F.substring(layer, 11, 1_000_000), F.lit("")).alias("layer"))


def weight_spec(text: Column) -> Column:
    """Weights of ``key=value`` entries apart by ; or , as a map, and the first entry that is none or not above 0 as error."""
    entries = F.filter(F.transform(F.split(text, "[;,]"), lambda e: F.trim(e)), lambda e: e != "")

    def parsed(e: Column) -> Column:
        at = F.instr(e, "=")
        key = F.trim(F.when(at > 0, F.substring(e, F.lit(1), at - 1)))
        value = F.when(at > 0, F.trim(F.substring(e, at + 1, F.length(e)))).try_cast("double")
        ok = (key != "") & value.isNotNull() & ~F.isnan(value) & (value > 0) & (value != float("inf"))
        return F.struct(e.alias("entry"), key.alias("key"), value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))

    found = F.transform(entries, parsed)
    error = F.get(F.filter(found, lambda x: ~x["ok"]), F.lit(0))["entry"]
    weights = F.map_from_entries(F.transform(found, lambda x: F.struct(x["key"], x["value"])))
    return F.struct(F.when(error.isNull(), weights).alias("weights"), error.alias("error"))


def quality_warning(value: Column, key: Column, kind: Column, source: Column, raw: Column, low: Column, high: Column) -> Column:
    """The warning of a value outside its bounds (unknown ones: 0 and none), or an empty text."""
    outlier = (value < F.coalesce(low, F.lit(0.0))) | (value > F.coalesce(high, F.lit(float("inf"))))
    text = F.concat(F.lit("Outlier for "), key, F.lit(": "), F.format_string("%s", value), F.lit(" in "), kind, F.lit(" from "), source, F.lit(" (raw="), F.coalesce(clean_text(raw), F.lit("")), F.lit("). Excluded from scenario factors."))
    return F.when(outlier, text).otherwise("")


def nearest_colour(r: Column, g: Column, b: Column, palette: dict[str, tuple[float, float, float]], most: float = 0.16) -> Column:
    """(name, distance) of the palette's nearest colour, channels 0 to 1, the first of equally near ones; no name beyond ``most``."""
    each = [F.struct(F.sqrt((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).alias("distance"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, (x, y, z)) in enumerate(palette.items())]
    best = F.array_min(F.array(*each))
    return F.struct(F.when(best["distance"] <= most, best["name"]).alias("name"), best["distance"].alias("distance"))
