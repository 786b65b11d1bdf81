"""Null-, NaN- and type-safe value expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once: an array of one binds it to a variable, which helps inside other lambdas, where nothing else does."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def safe_float(value: Column) -> Column:
    """The value as a double, or null if it isn't a number or is NaN (infinities stay)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def finite_float(value: Column) -> Column:
    """As `safe_float`, with infinities null as well."""
    number = safe_float(value)
    return F.when(~number.isin(float("inf"), float("-inf")), number)


def clean_text(value: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def optional_text(value: Column) -> Column:
    """Null for blank, 'none' and 'null' in any case; else the trimmed text."""
    text = clean_text(value)
    return F.when(~F.lower(text).isin("", "none", "null"), text)


def mean(value: Column) -> Column:
    """Mean of the values that aren't null or NaN; null if there are none."""
    return F.avg(safe_float(value))


def deviation(value: Column) -> Column:
    """Sample standard deviation; 0.0 for a single value, null for none."""
    number = safe_float(value)
    return F.when(F.count(number) == 1, F.lit(0.0)).otherwise(F.stddev_samp(number))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rate(condition: Column) -> Column:
    """Mean of a three-valued condition over the rows in which it is known."""
    return F.avg(condition.cast("double"))


def quantile(value: Column, q: float) -> Column:
    """Exact percentile with linear interpolation, over values that aren't null or NaN."""
    return F.percentile(safe_float(value), F.lit(q))


def job_key(trial: Column, file: Column, row: Column) -> Column:
    """SHA-256 of the canonical JSON object (sorted keys) that identifies a rollout job."""
    escaped = F.regexp_replace(F.regexp_replace(file, r"\\", r"\\\\"), '"', '\\\\"')
    text = F.concat(F.lit('{"resume_file_row_idx": '), row.cast("string"), F.lit(', "resume_val_file": "'), escaped, F.lit('", "trial_idx": '), trial.cast("string"), F.lit("}"))
    return F.sha2(text, 256)
