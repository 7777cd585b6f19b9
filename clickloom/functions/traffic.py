"""Traffic-channel rules and the noise test."""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.schema import EVENT_TYPE_ALIASES, NOISY_SOURCES


def _has_any(text: Column, *words: str) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def marketing_channel(referrer: Column, utm_source: Column, source: Column) -> Column:
    """organic / social / paid / referral / direct; an 'ads' source always wins."""
    ref = F.lower(F.trim(F.coalesce(F.nullif(referrer, F.lit("")), utm_source, F.lit(""))))
    return (
        F.when(F.lower(F.coalesce(source, F.lit(""))).contains("ads"), F.lit("paid"))
        .when(ref == "", F.lit("direct"))
        .when(_has_any(ref, "google", "bing", "search"), F.lit("organic"))
        .when(_has_any(ref, "facebook", "twitter", "linkedin"), F.lit("social"))
        .when(_has_any(ref, "ads", "adwords"), F.lit("paid"))
        .otherwise(F.lit("referral"))
    )


def traffic_source(referrer: Column, source: Column) -> Column:
    """organic_search / social / paid / direct / referral, unknown without a referrer."""
    return (
        F.when(_has_any(referrer, "google", "bing"), F.lit("organic_search"))
        .when(_has_any(referrer, "facebook", "twitter", "instagram"), F.lit("social"))
        .when(referrer.contains("ads") | (source == "ads"), F.lit("paid"))
        .when(referrer.isin("", "direct"), F.lit("direct"))
        .when(referrer.isNotNull(), F.lit("referral"))
        .otherwise(F.lit("unknown"))
    )


# The channels of referral_channel, in report order.
REFERRAL_CHANNELS = ("seo", "direct", "social", "referral", "paid")


def referral_channel(referrer: Column) -> Column:
    """seo / social / paid / direct / referral; search engines are tested before ads."""
    ref = F.lower(F.coalesce(referrer, F.lit("")))
    return (
        F.when(ref.isin("", "direct"), F.lit("direct"))
        .when(_has_any(ref, "google", "bing"), F.lit("seo"))
        .when(_has_any(ref, "facebook", "twitter", "instagram"), F.lit("social"))
        .when(ref.contains("ads"), F.lit("paid"))
        .otherwise(F.lit("referral"))
    )


def is_clean(noisy: Column, source: Column) -> Column:
    """True unless the event is flagged noisy or comes from a test source; nulls stay."""
    flagged = F.coalesce(noisy, F.lit(False))
    generated = F.coalesce(source.isin(*NOISY_SOURCES), F.lit(False))
    return ~flagged & ~generated


def canonical_event_type(event_type: Column) -> Column:
    """Fold aliases; a missing type is a pageview."""
    folded = F.when(event_type.isNull() | (event_type == ""), F.lit("pageview"))
    for alias, name in EVENT_TYPE_ALIASES.items():
        folded = folded.when(event_type == alias, F.lit(name))
    return folded.otherwise(event_type)
