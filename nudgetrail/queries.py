"""One named query per operator, over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgetrail.functions import ratings
from nudgetrail.operators import changes, cycles, joins, messages, report
from nudgetrail.operators.lookahead import with_next
from nudgetrail.plans.study import Nudged, Sources
from nudgetrail.sources.standins import (
    CAMPAIGN_ROWS,
    DATES,
    LABELS,
    NUDGE,
    RATING,
    STUDY,
    SampleSources,
)
from nudgetrail.sources.tables import cut, read_source, stage_path, write_result

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Sources], DataFrame]) -> Callable[[Sources], DataFrame]:
    """Registers a query under its function's name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(SampleSources(spark, sf_dir))
    return build


def _nudged(src: Sources, roster: DataFrame | None = None) -> Nudged:
    return STUDY.nudged(src, STUDY.roster(src) if roster is None else roster)


def _dims(src: Sources) -> DataFrame:
    return joins.provider_dims(src.site, src.acct, src.account)


def _observed(src: Sources, *extra: str | Column) -> DataFrame:
    return src.observation.select("item", "provider", "run_time", "price", *extra)


@query
def campaign_roster(src: Sources) -> DataFrame:
    return STUDY.roster(src)


@query
def campaign_roster_rows(src: Sources) -> DataFrame:
    return messages.campaign_roster_rows(src.send, src.context, src.track, CAMPAIGN_ROWS, DATES)


@query
def stored_roundtrip(src: Sources) -> DataFrame:
    """The roster written to a name with a suffix, over an earlier result, and read by that name."""
    roster = cut(STUDY.roster(src), "roster")
    target = f"{stage_path(roster.sparkSession, 'kept')}/roster"
    write_result(roster.where("opens > 0"), target, "_march")
    write_result(roster, target, "_march")
    return read_source(roster.sparkSession, f"{target}_march")


@query
def opener_count(src: Sources) -> DataFrame:
    return messages.opener_count(campaign_roster(src))


@query
def roster_qa(src: Sources) -> DataFrame:
    return messages.roster_qa(campaign_roster(src))


@query
def eav_lookup(src: Sources) -> DataFrame:
    """Provider and items of every message."""
    provider = joins.eav_lookup(src.context, NUDGE.provider_key, "provider")
    item = joins.eav_lookup(src.context, NUDGE.item_key, "item").drop("region")
    return provider.join(item, "msg_id")


@query
def nudge_sends(src: Sources) -> DataFrame:
    return STUDY.nudges(src, STUDY.roster(src))


@query
def nudge_sends_to_openers(src: Sources) -> DataFrame:
    spec = replace(
        NUDGE,
        exclude_pattern="%@machinery.%",
        exclude_on="address",
        match_region=True,
        member="opened",
    )
    return replace(STUDY, nudge=spec).nudges(src, STUDY.roster(src))


@query
def send_engagement(src: Sources) -> DataFrame:
    return messages.send_engagement(nudge_sends(src))


@query
def rating_relabel(src: Sources) -> DataFrame:
    second = src.prediction2.withColumnRenamed("creation_date", "date")
    rows = _observed(src, "country", "rating", F.to_date("run_time").alias("date"))
    label = ratings.relabel_rating(
        F.col("country"), F.col("base_rating"), F.col("rating"), RATING
    )
    return rows.join(second, ["item", "date", "country"], "left").withColumn("label", label)


@query
def display_label(src: Sources) -> DataFrame:
    label = ratings.display_label(F.col("final_rating"), RATING.display)
    return _observed(src, "final_rating", label.alias("label"))


@query
def next_band_cutoff(src: Sources) -> DataFrame:
    cutoff = ratings.next_band_cutoff(F.col("country"), F.col("final_score"), RATING.bands)
    return _observed(src, "country", "final_score", cutoff.alias("cutoff"))


@query
def price_at_next_band(src: Sources) -> DataFrame:
    price = ratings.price_at_next_band(RATING).alias("price_at_next_band")
    return _observed(src, "country", "final_score", price)


@query
def nudged_observations(src: Sources) -> DataFrame:
    return cycles.nudged_observations(src.observation, send_engagement(src), DATES)


@query
def nudged_predictions(src: Sources) -> DataFrame:
    return cycles.nudged_predictions(src.prediction2, send_engagement(src), DATES, RATING)


@query
def anchor_state(src: Sources) -> DataFrame:
    return STUDY.anchors(_nudged(src))


@query
def send_cycles(src: Sources) -> DataFrame:
    return STUDY.cycles(_nudged(src))


@query
def next_observation(src: Sources) -> DataFrame:
    """The look-ahead alone, over the whole log: each item's next rating in its region."""
    rows = src.observation.select(
        "provider", "region", "item", "area", F.to_date("run_time").alias("date"), "rating", "price"
    )
    return with_next(
        rows.distinct(),
        ["provider", "region", "item"],
        ["date", "rating"],
        "rating",
        "next_rating",
    )


@query
def interval_join(src: Sources) -> DataFrame:
    """The join alone, over the whole log: every observation inside a cycle of its item."""
    spans = send_cycles(src).select(*cycles.ITEM_KEY, "sent_date", "obs_date", "next_sent_date")
    facts = src.observation.select(
        *cycles.ITEM_KEY, "run_time", "price", F.to_date("run_time").alias("date")
    )
    return joins.interval_join(
        facts, spans, cycles.ITEM_KEY, "date", "obs_date", "next_sent_date"
    )


@query
def trajectory(src: Sources) -> DataFrame:
    nudged = _nudged(src)
    return STUDY.trajectory(src, nudged, STUDY.cycles(nudged))


def _flags(src: Sources, roster: DataFrame | None = None) -> DataFrame:
    nudged = _nudged(src, roster)
    return STUDY.flags(src, nudged, STUDY.cycles(nudged))


@query
def flag_changes(src: Sources) -> DataFrame:
    return _flags(src)


@query
def flag_changes_by_region(src: Sources) -> DataFrame:
    return cycles.flag_changes(trajectory(src), cycles.ITEM_KEY)


@query
def study_earlier_form(src: Sources) -> DataFrame:
    """The flags of a study with the earlier roster and a look-ahead inside the region."""
    study = replace(
        STUDY, campaign=CAMPAIGN_ROWS, earlier_roster=True, lookahead_keys=cycles.ITEM_KEY
    )
    nudged = study.nudged(src, study.roster(src))
    return study.flags(src, nudged, study.cycles(nudged))


@query
def later_window(src: Sources) -> DataFrame:
    """The flags of a study that was run for an earlier window and then carried on to the whole one.

    The second run also takes two days again, as if rows had come late.
    """
    roster = cut(STUDY.roster(src), "roster")
    folder = stage_path(roster.sparkSession, "by_day")
    days = (DATES.nudge_end - DATES.nudge_start).days // 2
    middle = DATES.nudge_start + timedelta(days=days)
    earlier = replace(DATES, nudge_end=middle, obs_end=middle, as_of=middle)
    replace(STUDY, dates=earlier).nudged_by_day(src, roster, folder)
    nudged = STUDY.nudged_by_day(src, roster, folder, since=middle - timedelta(days=2))
    return STUDY.flags(src, nudged, STUDY.cycles(nudged))


@query
def first_change(src: Sources) -> DataFrame:
    return changes.first_change(flag_changes(src))


@query
def state_at_first_change(src: Sources) -> DataFrame:
    flags = cut(flag_changes(src), "flags")
    return changes.state_at_first_change(flags, changes.first_change(flags))


@query
def merge_change(src: Sources) -> DataFrame:
    flags = cut(flag_changes(src), "flags")
    first = changes.first_change(flags)
    return changes.merge_change(flags, first, changes.state_at_first_change(flags, first))


@query
def persistence(src: Sources) -> DataFrame:
    return STUDY.persistent(cut(flag_changes(src), "flags"))


def _summary(src: Sources, roster: DataFrame | None = None, **options) -> DataFrame:
    lasting = STUDY.persistent(cut(_flags(src, roster), "flags"))
    return report.pre_post_summary(lasting, _dims(src), DATES, LABELS, **options)


@query
def pre_post_summary(src: Sources) -> DataFrame:
    return _summary(src)


@query
def pre_post_summary_by_segment(src: Sources) -> DataFrame:
    return _summary(src, by_country=False, use_fallback=False)


@query
def pre_post_summary_by_provider(src: Sources) -> DataFrame:
    return _summary(src, grain="provider")


@query
def country_filter_summary(src: Sources) -> DataFrame:
    return _summary(src, country="East")


@query
def audience_size(src: Sources) -> DataFrame:
    return report.audience_size(STUDY.roster(src), _dims(src), LABELS)


@query
def audience_size_by_segment(src: Sources) -> DataFrame:
    return report.audience_size(
        STUDY.roster(src), _dims(src), LABELS, by_country=False, use_fallback=False
    )


@query
def openers_by_country(src: Sources) -> DataFrame:
    return report.openers_by_country(STUDY.roster(src), _dims(src), LABELS)


@query
def changed_share(src: Sources) -> DataFrame:
    roster = cut(STUDY.roster(src), "roster")
    audience = report.audience_size(
        roster, _dims(src), LABELS, provider_key=("provider", "region")
    )
    return report.changed_share(_summary(src, roster), audience)
