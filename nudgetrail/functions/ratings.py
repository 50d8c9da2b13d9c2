"""Rating and score-band expressions. All are plain columns, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from nudgetrail.settings import Bands, RatingRules


def lookup(code: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value of a code, NULL where there is none."""
    found = F.lit(None).cast("string")
    for key, value in mapping.items():
        found = F.when(code == key, F.lit(value)).otherwise(found)
    return found


def relabel_rating(country: Column, second: Column, first: Column, rules: RatingRules) -> Column:
    """The second model's rating in its special country if it has a label, else the first's."""
    mapped = F.when(country == rules.special_country, lookup(second, rules.relabel))
    return F.coalesce(mapped, first)


def display_label(code: Column, display: Mapping[str, str]) -> Column:
    """The label of a rating code: its own if listed, else the code in title case."""
    title = F.initcap(F.replace(F.lower(code), F.lit("_"), F.lit(" ")))
    return F.coalesce(lookup(code, display), title)


def _cutoff_above(score: Column, bands: Bands) -> Column:
    first = bands.cutoffs[0]
    cutoff = F.when((score > -bands.bound) & (score < first), F.lit(first))
    for low, high in pairwise(bands.cutoffs):
        cutoff = cutoff.when((score >= low) & (score < high), F.lit(high))
    return cutoff


def next_band_cutoff(country: Column, score: Column, bands: Mapping[str, Bands]) -> Column:
    """Where the next better band starts; NULL in the best band, out of bounds, or unbanded."""
    cutoff = F.lit(None).cast("double")
    for code, country_bands in bands.items():
        cutoff = F.when(country == code, _cutoff_above(score, country_bands)).otherwise(cutoff)
    return cutoff


def price_at_next_band(rules: RatingRules) -> Column:
    """The price at which an observed item would reach its next band, NULL where none applies.

    Reads the observation columns by name.
    """
    score, variance, price = F.col("final_score"), F.col("variance"), F.col("price")
    eligible = (
        (F.to_date("run_time") >= F.lit(rules.launch_date))
        & (variance > 0)
        & F.col("provider").isNotNull()
        & price.isNotNull()
        & F.col("neutral_score").isNotNull()
        & (F.col("is_new") == F.lit(False))
        & (display_label(F.col("final_rating"), rules.display) != rules.top_label)
    )
    cutoff = next_band_cutoff(F.col("country"), score, rules.bands)
    return F.when(eligible, price - F.round((cutoff - score) * F.sqrt(variance), 0))
