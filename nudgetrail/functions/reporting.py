"""Change flags and report labels, as plain columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from nudgetrail.functions.ratings import lookup
from nudgetrail.settings import ReportLabels


def price_delta(price: Column, original: Column) -> Column:
    """Price change; 0 where either price is unknown."""
    return F.coalesce(price - original, F.lit(0))


def price_lowered(price: Column, original: Column) -> Column:
    """Whether the price fell; false where either price is unknown."""
    return F.coalesce(price < original, F.lit(False))


def rating_changed(rating: Column, original: Column) -> Column:
    """Whether the rating differs; false where either rating is unknown."""
    return F.coalesce(rating != original, F.lit(False))


def period_label(change_date: Column, campaign_date: date) -> Column:
    """PRE for a change before the campaign day, else POST."""
    return F.when(change_date < F.lit(campaign_date), F.lit("PRE")).otherwise(F.lit("POST"))


def country_label(country: Column, labels: ReportLabels) -> Column:
    """The report label of a country code, a missing one counting as the home country."""
    known = F.coalesce(country, F.lit(labels.home_country))
    return F.coalesce(lookup(known, labels.countries), F.lit(labels.other))


def segment_or_fallback(segment: Column, fallback: Column) -> Column:
    """The segment, or the fallback where an account has none."""
    return F.coalesce(segment, fallback)
