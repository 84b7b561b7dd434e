"""Text classifiers built from ordered rules, and start-time features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# Days per age unit.
AGE_UNIT_DAYS = {"day": 1.0, "week": 7.0, "month": 30.4375, "year": 365.25}

# Colour classes, first match wins.
COLOR_RULES: Rules = (
    ("black_or_dark", ("black", "sable")),
    ("brown_tan", ("brown", "chocolate", "liver", "seal")),
    ("white_light", ("white", "cream")),
    ("gray_blue", ("gray", "grey", "blue", "silver")),
    ("orange_yellow", ("orange", "yellow", "gold", "tan", "buff", "fawn")),
)
COLOR_DEFAULT = "mixed_other"

# Breed classes over the primary breed token, first match wins.
BREED_RULES: Rules = (
    ("domestic_cat", ("domestic_shorthair", "domestic_medium_hair", "domestic_longhair")),
    ("pit_bull_type", ("pit_bull", "staffordshire", "bulldog")),
    ("chihuahua_type", ("chihuahua",)),
    ("retriever_type", ("retriever", "labrador", "golden")),
    ("shepherd_type", ("shepherd",)),
    ("terrier_type", ("terrier",)),
    ("hound_type", ("hound",)),
)

# Location patterns.
AREA_AFTER_IN = r"(?i)\bin\s+([^()]+?)\s*\(tx\)\s*$"
AREA_WHOLE = r"(?i)^([^()]+?)\s*\(tx\)\s*$"
INTERSECTION = r"(?i)\bintersection\b|/|&|\band\b"
ADDRESS = r"^\s*\d+"
AIRPORT = r"(?i)\bairport\b|presidential\s+blvd"
OUTSIDE = "outside jurisdiction"
HOME_AREA = "austin"

# Regime start dates.
REGIME_CUTS = (("2020-03-01", "pre_covid"), ("2022-01-01", "covid"))
REGIME_LAST = "post_covid"

UNKNOWN = "unknown"


def _clean(text: Column) -> Column:
    return F.lower(F.trim(text.cast("string")))


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text.cast("string")) == "")


def first_matching(text: Column, rules: Rules, default: str) -> Column:
    """Label of the first rule one of whose words occurs in the text."""
    result = None
    for label, words in rules:
        test = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            test = test | F.contains(text, F.lit(word))
        result = F.when(test, label) if result is None else result.when(test, label)
    return result.otherwise(default)


def age_days(text: Column) -> Column:
    """Days of a text such as ``2 years``; null for negative ages and unknown units."""
    pattern = r"^(-?\d+(?:\.\d+)?)\s+([a-z]+)"
    lowered = _clean(text)
    amount = F.regexp_extract(lowered, pattern, 1).try_cast("double")
    unit = F.regexp_extract(lowered, pattern, 2)
    per_unit = None
    for name, days in AGE_UNIT_DAYS.items():
        test = unit.isin(name, name + "s")
        per_unit = F.when(test, F.lit(days)) if per_unit is None else per_unit.when(test, F.lit(days))
    return F.when(amount >= 0, amount * per_unit)


def age_group(days: Column) -> Column:
    return (
        F.when(days.isNull(), UNKNOWN)
        .when(days < 365.25, "baby")
        .when(days < 3 * 365.25, "young")
        .when(days < 8 * 365.25, "adult")
        .otherwise("senior")
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def regime(ts: Column, cuts: Sequence[tuple[str, str]] = REGIME_CUTS, last: str = REGIME_LAST) -> Column:
    """Period label from cut dates in ascending order."""
    result = F.when(ts.isNull(), UNKNOWN)
    for day, label in cuts:
        result = result.when(ts < F.lit(day).cast("timestamp_ntz"), label)
    return result.otherwise(last)


def color_group(text: Column, rules: Rules = COLOR_RULES, default: str = COLOR_DEFAULT) -> Column:
    return F.when(_blank(text), UNKNOWN).otherwise(first_matching(_clean(text), rules, default))


def primary_color(text: Column) -> Column:
    token = F.split_part(F.replace(_clean(text), F.lit(" "), F.lit("_")), F.lit("/"), F.lit(1))
    return F.when(_blank(text), UNKNOWN).otherwise(token)


def primary_breed(text: Column) -> Column:
    plain = F.replace(_clean(text), F.lit(" mix"), F.lit(""))
    token = F.replace(F.trim(F.split_part(plain, F.lit("/"), F.lit(1))), F.lit(" "), F.lit("_"))
    return F.when(_blank(text), UNKNOWN).otherwise(token)


def is_mixed_breed(text: Column) -> Column:
    lowered = F.lower(text.cast("string"))
    return F.coalesce(F.contains(lowered, F.lit("mix")) | F.contains(lowered, F.lit("/")), F.lit(False))


def breed_group(text: Column, rules: Rules = BREED_RULES) -> Column:
    token = primary_breed(text)
    return F.when(token == UNKNOWN, UNKNOWN).otherwise(first_matching(token, rules, "other"))


def slug(text: Column) -> Column:
    joined = F.regexp_replace(F.lower(F.trim(text)), r"[^0-9a-z]+", "_")
    trimmed = F.regexp_replace(joined, r"^_+|_+$", "")
    return F.when(trimmed == "", UNKNOWN).otherwise(trimmed)


def location_area(text: Column, after_in: str = AREA_AFTER_IN, whole: str = AREA_WHOLE) -> Column:
    """Slug of the area named at the end of a location text, else ``unknown``."""
    plain = F.trim(text.cast("string"))
    raw = F.when(F.regexp_like(plain, F.lit(after_in)), F.regexp_extract(plain, after_in, 1)).when(
        F.regexp_like(plain, F.lit(whole)), F.regexp_extract(plain, whole, 1)
    )
    return F.coalesce(F.when(raw.isNotNull(), slug(raw)), F.lit(UNKNOWN))


def location_flags(
    text: Column,
    *,
    home: str = HOME_AREA,
    outside: str = OUTSIDE,
    intersection: str = INTERSECTION,
    address: str = ADDRESS,
    airport: str = AIRPORT,
    area: Column | None = None,
) -> dict[str, Column]:
    plain = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    area = location_area(text) if area is None else area
    return {
        "is_austin_found_location": area == home,
        "is_outside_jurisdiction": F.lower(plain) == outside,
        "is_intersection_location": F.regexp_like(plain, F.lit(intersection)),
        "is_address_like_location": F.regexp_like(plain, F.lit(address)),
        "is_airport_location": F.regexp_like(plain, F.lit(airport)),
    }


def location_kind(text: Column, flags: dict[str, Column], area: Column, home_label: str = "austin_city") -> Column:
    return (
        F.when(_blank(text), "other")
        .when(flags["is_outside_jurisdiction"], "outside_jurisdiction")
        .when(flags["is_intersection_location"], "intersection")
        .when(flags["is_address_like_location"], "address_like")
        .when(flags["is_austin_found_location"], home_label)
        .when(area != UNKNOWN, "county_or_region")
        .otherwise("other")
    )


def has_text(text: Column) -> Column:
    return F.coalesce(F.trim(text.cast("string")) != "", F.lit(False))


def start_features(
    rows: DataFrame,
    *,
    ts: str,
    name: str = "name",
    age: str = "age_upon_intake",
    color: str = "color",
    breed: str = "breed",
    location: str = "found_location",
) -> DataFrame:
    """All features known at the start of an episode; absent inputs count as null."""

    def source(c: str) -> Column:
        return F.col(c) if c in rows.columns else F.lit(None).cast("string")

    when = F.col(ts)
    area = location_area(source(location))
    flags = location_flags(source(location), area=area)
    first = rows.withColumns(
        {
            "is_named": has_text(source(name)),
            "age_days": age_days(source(age)),
            "intake_year": F.year(when),
            "intake_month": F.month(when),
            "intake_quarter": F.quarter(when),
            "covid_period": regime(when),
            "color_group": color_group(source(color)),
            "primary_color": primary_color(source(color)),
            "primary_breed": primary_breed(source(breed)),
            "is_mixed_breed": is_mixed_breed(source(breed)),
            "simplified_breed_group": breed_group(source(breed)),
            "found_location_kind": location_kind(source(location), flags, area),
            "found_location_area": area,
            **flags,
        }
    )
    return first.withColumns(
        {
            "age_group": age_group(F.col("age_days")),
            "intake_season": season(F.col("intake_month")),
            "simplified_color_group": F.col("color_group"),
            "is_black_or_dark": F.col("color_group") == "black_or_dark",
        }
    )
