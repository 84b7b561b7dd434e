"""Cleaning and column-level expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.sources.contracts import require_columns

# Text forms of local timestamps other than ISO.
WALL_CLOCK_FORMATS = (
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy hh:mm a",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "MMMM d, yyyy hh:mm:ss a",
)


def parse_wall_clock(text: Column, formats: Sequence[str] = WALL_CLOCK_FORMATS) -> Column:
    """Local timestamp of a text; any zone suffix is dropped without moving the clock."""
    plain = F.regexp_replace(F.replace(F.trim(text.cast("string")), F.lit("T"), F.lit(" ")), r"(Z|[+-]\d{2}:?\d{2})$", "")
    attempts = [plain.try_cast("timestamp_ntz")]
    attempts += [F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*attempts)


def parse_time_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = {c: parse_wall_clock(F.col(c)) for c in columns if c in rows.columns}
    return rows.withColumns(present) if present else rows


def keep_values(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose trimmed, lower-cased value is allowed."""
    return rows.filter(F.lower(F.trim(F.col(column).cast("string"))).isin(*allowed))


def clean_events(
    rows: DataFrame,
    *,
    entity: str,
    entity_type: str,
    ts: str,
    allowed: Sequence[str],
    required: Sequence[str] = (),
    other_times: Sequence[str] = (),
    name: str = "events",
) -> DataFrame:
    """Required columns, exact duplicates, timestamps, null keys, allowed types, in that order."""
    require_columns(rows, {entity, entity_type, ts, *required}, name)
    return (
        rows.dropDuplicates()
        .transform(lambda d: parse_time_columns(d, [ts, *other_times]))
        .dropna(subset=[entity, entity_type, ts])
        .transform(lambda d: keep_values(d, entity_type, allowed))
    )


def clip(value: Column, low: Column, high: Column) -> Column:
    """Clamp, keeping nulls."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def log_days(value: Column, offset: float = 1.0, base: str = "natural") -> Column:
    """Logarithm of the value floored at ``offset``."""
    floored = F.when(value.isNotNull(), F.greatest(value.cast("double"), F.lit(float(offset))))
    return {"10": F.log10, "2": F.log2}.get(base, F.ln)(floored)


def recency_weight(year: Column, first: int, last: int, gain: float = 0.5) -> Column:
    """1 at the first year rising to 1 + gain at the last, clamped; 1 for a null year."""
    if last <= first:
        return F.lit(1.0)
    raw = 1.0 + gain * (year - first) / float(last - first)
    return F.when(year.isNull(), F.lit(1.0)).otherwise(F.least(F.greatest(raw, F.lit(1.0)), F.lit(1.0 + gain)))


def model_frame(rows: DataFrame, categorical: Sequence[str], numeric: Sequence[str], missing: str = "unknown") -> DataFrame:
    """Categorical nulls become a level of their own, everything else a number or null."""
    cats = {c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in categorical}
    nums = {}
    for c in numeric:
        kind = dict(rows.dtypes)[c]
        number = F.col(c).cast("int") if kind == "boolean" else F.col(c)
        value = number.try_cast("double") if kind == "string" else number.cast("double")
        nums[c] = F.when(~F.isnan(value), value)
    return rows.withColumns({**cats, **nums})


def volume_filter(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    return rows.filter(F.col(column) <= threshold)


def volume_filter_audit(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows before, removed and after the filter, from one aggregate."""
    kept = F.coalesce(F.col(column) <= threshold, F.lit(False))
    return rows.agg(
        F.lit(float(threshold)).alias("threshold_value"),
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~kept).alias("rows_removed"),
        F.count_if(kept).alias("rows_after"),
    )


def age_aliases(days: Column, per_month: float = 30.0, per_year: float = 365.0) -> Mapping[str, Column]:
    """Age in the units and under the names readers expect."""
    months, years = days / per_month, days / per_year
    return {
        "age_in_days": days,
        "age_months": months,
        "age_years": years,
        "age_in_months": months,
        "age_in_years": years,
    }
