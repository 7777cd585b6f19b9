"""Lenient casts: timestamps in mixed forms, amounts with commas, ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.schema import AMOUNT_KEYS

_MILLIS_FLOOR = 1e12
_MILLIS_CEILING = 1e16


def number(col: Column) -> Column:
    """Double from text, ignoring thousands commas; null when unparsable."""
    return F.regexp_replace(F.trim(col.cast("string")), ",", "").try_cast("double")


def number_or_zero(col: Column) -> Column:
    return F.coalesce(number(col), F.lit(0.0))


def epoch_time(seconds_or_millis: Column) -> Column:
    """Timestamp from epoch seconds, or milliseconds when the value is above 1e12."""
    x = seconds_or_millis
    seconds = F.when(x > _MILLIS_FLOOR, x / 1000.0).otherwise(x)
    in_range = F.abs(x) < _MILLIS_CEILING
    return F.when(in_range, F.timestamp_seconds(seconds))


def out_of_range(text: Column) -> Column:
    """True for a number that no calendar has as a time, else null."""
    return F.when(F.abs(text.try_cast("double")) >= _MILLIS_CEILING, F.lit(True))


def any_time(text: Column) -> Column:
    """Timestamp from text: epoch digits, ISO 8601 or 'yyyy-MM-dd HH:mm:ss[.f]'."""
    text = F.trim(text.cast("string"))
    digits = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE]\d+)?$"), text.try_cast("double"))
    return F.when(digits.isNotNull(), epoch_time(digits)).otherwise(text.try_cast("timestamp"))


def first_time(*candidates: Column) -> Column:
    """First parsable timestamp among the candidates, in order."""
    return F.coalesce(*[any_time(c) for c in candidates])


def purchase_amount(properties: Column) -> Column:
    """Purchase total from a property map.

    The first non-empty total field decides, and counts as zero when it does
    not parse.  With no total field the amount is price times item count.
    """
    present = F.coalesce(*[F.nullif(properties[key], F.lit("")) for key in AMOUNT_KEYS])
    price = F.coalesce(properties["product_price"], properties["price"])
    items = F.coalesce(F.nullif(properties["cart_items"], F.lit("")), F.lit("1"))
    fallback = number_or_zero(price) * number_or_zero(items)
    return F.when(present.isNotNull(), number_or_zero(present)).otherwise(fallback)


def object_id(col: Column) -> Column:
    """Lower-case 24-digit hexadecimal id, or null."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike("^[0-9a-fA-F]{24}$"), F.lower(text))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, zero when the denominator is zero."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def percent(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    return F.round(ratio(numerator * F.lit(100.0), denominator), digits)


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def money(col: Column) -> Column:
    """Exact cents; a price beyond 10^26 counts as none, so that one bad row stops no job."""
    return col.try_cast("decimal(28,2)")


def one_per_id(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, so that a join with it multiplies nothing; of repeats the largest values."""
    return rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("_one")).select(key, "_one.*")


def event_order() -> Column:
    """Sort key of events: time, then id, so equal times have one order."""
    return F.struct("ts", "event_id")
