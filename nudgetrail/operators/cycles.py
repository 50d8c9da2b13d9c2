"""From nudges to the daily course of each item until its next nudge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgetrail.functions.ratings import price_at_next_band, relabel_rating
from nudgetrail.functions.reporting import price_delta, price_lowered, rating_changed
from nudgetrail.operators.joins import interval_join, left_join_hot_right
from nudgetrail.operators.lookahead import with_next
from nudgetrail.settings import RatingRules, StudyDates

ITEM_KEY = ["provider", "region", "item"]
LOG_COLUMNS = [
    *ITEM_KEY,
    "area",
    "entity",
    "country",
    "run_time",
    "price",
    "rating",
    "final_rating",
    "final_score",
    "neutral_score",
    "variance",
    "is_new",
]


def _study_days(day: Column, dates: StudyDates) -> Column:
    """Days any stage reads: a nudge is matched on its own day and followed from there.

    The date joins imply this bound; written out, it reaches the scans of the daily logs.
    """
    first = max(dates.obs_start, dates.nudge_start)
    return day.between(F.lit(first), F.lit(dates.obs_end))


def nudged_observations(
    observation: DataFrame, sends: DataFrame, dates: StudyDates, run_date: str | None = None
) -> DataFrame:
    """The part of the log a study reads: its columns, used items that were nudged, its days.

    Anchors and trajectory both read the log. Cut down to this once and written, it is scanned
    and shuffled whole only once; both stages take it in place of the log. ``run_date`` names a
    column that is the day of ``run_time`` in every row, if the log is partitioned by one: whole
    partitions outside the study's days are then skipped. A column is never used by its name alone.
    """
    if run_date is not None:
        observation = observation.where(_study_days(F.col(run_date), dates))
    # Not made distinct: a semi join needs no distinct keys, and a side that comes straight from
    # its shuffle lets Spark split the other.
    nudged = sends.select(*ITEM_KEY)
    used = _used_observations(observation, dates).select(*LOG_COLUMNS)
    return used.join(nudged, ITEM_KEY, "left_semi")


def _used_observations(observation: DataFrame, dates: StudyDates) -> DataFrame:
    """Observations of used items in the study's days."""
    used = F.col("is_new") == F.lit(False)
    return observation.where(_study_days(F.to_date("run_time"), dates) & used)


def nudged_predictions(
    prediction2: DataFrame, sends: DataFrame, dates: StudyDates, rules: RatingRules
) -> DataFrame:
    """The second model's ratings a study reads, and how many ``copies`` there are of each.

    One row per nudged item, day and label, so that an item-day has no more rows than there are
    labels. Like the cut-down log it is read by two stages, and is best written first.
    """
    return (
        prediction2.where(
            (F.col("country") == rules.special_country)
            & _study_days(F.col("creation_date"), dates)
        )
        .join(sends.select("item"), "item", "left_semi")
        .groupBy("item", "creation_date", "country", "base_rating")
        .agg(F.count("*").alias("copies"))
    )


def _with_rating(
    rows: DataFrame, predictions: DataFrame, day: str, rules: RatingRules
) -> DataFrame:
    """Replaces ``rating`` by the relabelled one; ``copies`` counts repeated predictions."""
    second = predictions.withColumnRenamed("creation_date", day)
    rating = relabel_rating(F.col("country"), F.col("base_rating"), F.col("rating"), rules)
    return (
        rows.join(second, ["item", day, "country"], "left")
        .withColumn("rating", rating)
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
        .drop("base_rating")
    )


def anchor_state(
    sends: DataFrame,
    observation: DataFrame,
    predictions: DataFrame,
    dates: StudyDates,
    rules: RatingRules,
) -> DataFrame:
    """Rating, price and next-band price of each item on the day it was nudged.

    One row per distinct state; a send with no observation that day is kept with NULLs.
    ``predictions`` are those of ``nudged_predictions``. ``sends`` must come from the nudge window
    of the same ``dates``. States that repeat on a day are combined before they are joined.
    """
    day = F.to_date("run_time")
    states = (
        _used_observations(observation, dates)
        .where(day < F.lit(dates.nudge_end))
        .select(
            *ITEM_KEY,
            day.alias("sent_date"),
            day.alias("obs_date"),
            "country",
            "rating",
            F.col("price").alias("original_price"),
            price_at_next_band(rules).alias("price_at_next_band"),
        )
    )
    joined = left_join_hot_right(sends, states, [*ITEM_KEY, "sent_date"], repeats=False)
    return (
        _with_rating(joined, predictions, "obs_date", rules)
        .select(
            *ITEM_KEY,
            "sent_date",
            "open_count",
            "click_count",
            "unsub_count",
            "obs_date",
            F.col("rating").alias("original_rating"),
            "original_price",
            "price_at_next_band",
        )
        .distinct()
    )


def send_cycles(anchors: DataFrame, dates: StudyDates) -> DataFrame:
    """Adds the day each cycle ends: the item's next send, or ``as_of`` after the last one.

    A send without an observation still closes the cycle before it. Of several states on one day
    the last in column order runs on to the next send; the others end on their own day.
    """
    cycles = with_next(anchors, ITEM_KEY, ["sent_date"], "sent_date", "next_sent_date")
    return cycles.withColumn("next_sent_date", F.coalesce("next_sent_date", F.lit(dates.as_of)))


def trajectory(
    observation: DataFrame,
    ontology: DataFrame,
    predictions: DataFrame,
    cycles: DataFrame,
    dates: StudyDates,
    rules: RatingRules,
    bucket_days: int = 7,
) -> DataFrame:
    """Each cycle expanded to its observed days: one row per distinct state, with its row count.

    The log is joined to the cycles before anything else is joined to it.
    """
    facts = _used_observations(observation, dates).select(
        *ITEM_KEY,
        "area",
        "entity",
        "country",
        F.to_date("run_time").alias("date"),
        "price",
        "rating",
    )
    inside = interval_join(
        facts, cycles, ITEM_KEY, "date", "obs_date", "next_sent_date", bucket_days
    )
    described = inside.join(
        ontology.select("entity", "region", "maker", "model", "year"), ["entity", "region"], "left"
    )
    return (
        _with_rating(described, predictions, "date", rules)
        .groupBy(
            "item",
            "provider",
            "region",
            "area",
            "maker",
            "model",
            F.col("year").alias("model_year"),
            "date",
            "price",
            "rating",
            "sent_date",
            "next_sent_date",
            "open_count",
            "click_count",
            "unsub_count",
            "original_price",
            "original_rating",
            "price_at_next_band",
        )
        .agg(F.sum("copies").alias("row_count"))
    )


def flag_changes(
    states: DataFrame, lookahead_keys: Sequence[str] = ("provider", "item")
) -> DataFrame:
    """Drops the send day, flags price and rating changes, and looks ahead one observed row.

    The look-ahead runs across cycles, and across regions unless ``lookahead_keys`` has region.
    Rows tied on a date are ordered by rating, then by every other column of the state. A change
    is attributed when the price fell, the rating changed and the nudge was opened.
    """
    rows = states.drop("row_count").where(F.col("sent_date") != F.col("date"))
    rows = with_next(rows, lookahead_keys, ["date", "rating"], "rating", "next_rating")
    lowered = price_lowered(F.col("price"), F.col("original_price"))
    changed = rating_changed(F.col("rating"), F.col("original_rating"))
    return rows.select(
        "item",
        "provider",
        "region",
        "area",
        "sent_date",
        "next_sent_date",
        "open_count",
        "date",
        "original_price",
        "price",
        price_delta(F.col("price"), F.col("original_price")).alias("price_delta"),
        lowered.alias("price_lowered"),
        "original_rating",
        "rating",
        changed.alias("rating_changed"),
        "next_rating",
        (lowered & changed & (F.col("open_count") > 0)).alias("attributed_change"),
    )
