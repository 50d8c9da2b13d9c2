"""Summaries by segment and country, before and after the campaign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.functions.reporting import country_label, period_label, segment_or_fallback
from nudgetrail.operators.joins import null_safe_join
from nudgetrail.settings import ReportLabels, StudyDates


def _with_segment(
    rows: DataFrame, dims: DataFrame, labels: ReportLabels, use_fallback: bool
) -> DataFrame:
    segment = F.col("segment")
    if use_fallback:
        segment = segment_or_fallback(segment, F.col("fallback_segment"))
    return (
        rows.join(dims, ["provider", "region"], "left")
        .withColumn("segment", segment)
        .withColumn("country", country_label(F.col("country"), labels))
    )


def _by(by_country: bool) -> list[str]:
    return ["country", "segment"] if by_country else ["segment"]


def pre_post_summary(
    persistent: DataFrame,
    dims: DataFrame,
    dates: StudyDates,
    labels: ReportLabels,
    *,
    by_country: bool = True,
    use_fallback: bool = True,
    grain: str = "segment",
    country: str | None = None,
) -> DataFrame:
    """Changed items and providers per segment, before and after the campaign.

    PRE and POST go by the date of the change. ``grain="provider"`` adds provider and region to
    the groups; ``country`` keeps one country label. ``by_country=False, use_fallback=False`` is
    the earlier form of the report. Ordered by the first two columns, descending, NULLs first.
    Items are counted per provider, and the counts added: a row is shuffled once for both counts.
    """
    if grain not in ("segment", "provider"):
        raise ValueError("grain must be 'segment' or 'provider'")
    rows = _with_segment(persistent, dims, labels, use_fallback).withColumn(
        "time_period", period_label(F.col("first_change_date"), dates.campaign_date)
    )
    if country is not None:
        rows = rows.where(F.col("country") == country)
    detail = ["provider", "region"] if grain == "provider" else []
    groups = [*detail, *_by(by_country), "time_period"]
    # As a count of distinct rows, neither count takes a provider that lacks a column.
    known = F.col("provider").isNotNull() & F.col("region").isNotNull()
    return (
        rows.groupBy(*dict.fromkeys([*groups, "provider", "region"]))
        .agg(F.count_distinct("item", "area", "first_change_date").alias("items"))
        .groupBy(*groups)
        .agg(
            F.sum(F.when(known, F.col("items")).otherwise(0)).alias("changed_items"),
            F.count(F.when(known, 1)).alias("changed_providers"),
        )
        .withColumn("items_per_provider", F.try_divide("changed_items", "changed_providers"))
        .orderBy(*[F.col(c).desc_nulls_first() for c in groups[:2]])
    )


def audience_size(
    roster: DataFrame,
    dims: DataFrame,
    labels: ReportLabels,
    *,
    by_country: bool = True,
    use_fallback: bool = True,
    provider_key: Sequence[str] = ("provider",),
) -> DataFrame:
    """Campaign recipients per segment: the denominators of the summary."""
    return (
        _with_segment(roster, dims, labels, use_fallback)
        .groupBy(*_by(by_country))
        .agg(F.count_distinct(*provider_key).alias("provider_count"))
    )


def openers_by_country(roster: DataFrame, dims: DataFrame, labels: ReportLabels) -> DataFrame:
    """How many recipients opened the campaign, per country label."""
    return (
        _with_segment(roster.where(F.col("opens") > 0), dims, labels, False)
        .groupBy("country")
        .agg(F.count_distinct("region", "provider").alias("openers"))
    )


def changed_share(summary: DataFrame, audience: DataFrame, *, by_country: bool = True) -> DataFrame:
    """Share of the audience that changed, per summary row.

    The summary counts providers by region, so the audience must too:
    ``audience_size(..., provider_key=("provider", "region"))``.
    """
    groups = _by(by_country)
    return null_safe_join(summary, audience, groups, "left").select(
        *groups,
        "time_period",
        "changed_providers",
        "provider_count",
        F.try_divide("changed_providers", "provider_count").alias("changed_share"),
    )
