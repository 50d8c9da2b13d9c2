"""Who received the campaign, and which nudges those recipients were sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgetrail.functions.ratings import lookup
from nudgetrail.operators.joins import eav_flags, eav_lookup, left_join_hot_right
from nudgetrail.settings import CampaignSpec, NudgeSpec, StudyDates

#: Flags of the context's keys, and the days of a nudge.
PROVIDER, ITEM = 1, 2
NUDGE_DAYS = ("sent_date", "open_date", "click_date", "unsub_date")


def _not_like(column: Column, pattern: str | None) -> Column:
    """NOT LIKE; a NULL value does not pass, and no pattern lets all pass."""
    return F.lit(True) if pattern is None else ~column.cast("string").like(pattern)


def _campaign_messages(send: DataFrame, spec: CampaignSpec, dates: StudyDates) -> DataFrame:
    day, slack = F.to_date("sent_time"), spec.day_slack
    campaign_day = F.lit(dates.campaign_date)
    return send.where(
        F.col("msg_type").isin(*spec.message_types)
        & _not_like(F.col("address"), spec.internal_address)
        & day.between(F.date_sub(campaign_day, slack), F.date_add(campaign_day, slack))
    )


def campaign_roster(
    send: DataFrame,
    context: DataFrame,
    track: DataFrame,
    spec: CampaignSpec,
    dates: StudyDates,
) -> DataFrame:
    """Recipients of the campaign: provider, region and two 0/1 flags, sends and opens.

    Both are distinct counts of the provider within its own group, hence flags. Messages without
    a provider come out as a NULL provider with both at 0. Providers are made distinct per message,
    and tracking rows reduced to one per opened message, before they are joined to the messages.
    """
    messages = _campaign_messages(send, spec, dates).select("msg_id", "region")
    providers = eav_lookup(context, spec.provider_key, "provider").withColumn(
        "provider_region", F.col("region")
    )
    opened = (
        track.where(F.col("event_type").isin(*spec.open_events))
        .select("msg_id", "region")
        .distinct()
        .withColumn("opened", F.lit(True))
    )
    known = F.col("provider").isNotNull()
    return (
        left_join_hot_right(messages, providers, ["msg_id", "region"], repeats=False)
        .join(opened, ["msg_id", "region"], "left")
        .groupBy("provider", F.col("provider_region").alias("region"))
        .agg(
            F.max(F.when(known, 1).otherwise(0)).cast("bigint").alias("sends"),
            F.max(F.when(known & F.col("opened"), 1).otherwise(0)).cast("bigint").alias("opens"),
        )
    )


def campaign_roster_rows(
    send: DataFrame,
    context: DataFrame,
    track: DataFrame,
    spec: CampaignSpec,
    dates: StudyDates,
) -> DataFrame:
    """The earlier form of the roster: only tracked messages, and counts of joined rows.

    A count takes every row whose CASE is not NULL, and both branches count; only a NULL provider
    on the first branch does not. Tracking rows are counted per message before the join.
    """
    remapped = F.coalesce(lookup(F.col("region"), spec.region_remap), F.col("region"))
    events = track
    if spec.environment is not None:
        events = events.where(F.col("environment") == spec.environment)
    events = (
        events.select("msg_id", remapped.alias("region"))
        .groupBy("msg_id", "region")
        .agg(F.count("*").alias("events"))
    )

    def counted(time: str) -> Column:
        counts = F.col("provider").isNotNull() | F.col(time).isNull()
        return F.sum(F.when(counts, F.col("events")).otherwise(0))

    return (
        _campaign_messages(send, spec, dates)
        .select("msg_id", "region", "sent_time", "open_time")
        .join(events, ["msg_id", "region"], "inner")
        .join(eav_lookup(context, spec.provider_key, "provider"), ["msg_id", "region"], "inner")
        .groupBy("provider", "region")
        .agg(counted("sent_time").alias("sends"), counted("open_time").alias("opens"))
    )


def nudge_sends(
    send: DataFrame,
    context: DataFrame,
    roster: DataFrame,
    spec: NudgeSpec,
    dates: StudyDates,
) -> DataFrame:
    """Nudges sent to campaign recipients: one row per distinct set of dates and item.

    The send log and the context are scanned once. What the context says of the wanted messages
    is made distinct, with the keys that say it as flags, in one shuffle that spreads the values of
    a message; providers and items are the two kinds of rows of its result.
    """
    day = F.to_date("sent_time")
    message = F.struct(
        "msg_id",
        F.col("region").alias("msg_region"),
        day.alias("sent_date"),
        F.to_date("open_time").alias("open_date"),
        F.to_date("click_time").alias("click_date"),
        F.to_date("unsub_time").alias("unsub_date"),
    )
    messages = send.where(
        F.col("msg_type").isin(*spec.message_types)
        & (day >= F.lit(dates.nudge_start))
        & (day < F.lit(dates.nudge_end))
        & _not_like(F.col(spec.exclude_on), spec.exclude_pattern)
    ).select("msg_id", message.alias("message"))
    flags = dict.fromkeys((spec.provider_key, spec.item_key), 0)
    flags[spec.provider_key] |= PROVIDER
    flags[spec.item_key] |= ITEM
    found = eav_flags(context, flags)
    found = messages.join(found, "msg_id", "inner")
    if spec.match_region:
        found = found.where(F.col("region") == F.col("message.msg_region"))
    # Both sides below read one exchange: they differ only in what comes after it.
    found = found.groupBy("message", "region", "value").agg(F.bit_or("keys").alias("keys"))

    def held(key: int, column: str) -> Column:
        return F.when(F.col("keys").bitwiseAND(key) != 0, F.col(column))

    is_provider, is_item = (F.col("keys").bitwiseAND(key) != 0 for key in (PROVIDER, ITEM))
    providers = found.where(is_provider).select(
        "message", held(PROVIDER, "value").alias("provider"), held(PROVIDER, "region").alias("region")
    )
    members = roster.where(F.col("opens") > 0) if spec.member == "opened" else roster
    nudges = providers.join(
        members.select("provider", "region"), ["provider", "region"], "left_semi"
    ).join(found.where(is_item).select("message", F.col("value").alias("item")), "message", "inner")
    return nudges.select("provider", "region", "item", *[f"message.{d}" for d in NUDGE_DAYS]).distinct()


def send_engagement(nudges: DataFrame) -> DataFrame:
    """Distinct days a nudge was opened, clicked and unsubscribed from, per item and send day.

    A click only counts on a row that also has an open date; an unsubscribe needs none. The days
    of a group are kept as sets, merged before and after the one shuffle: a set holds no more days
    than the log, while counting them apart would shuffle a row for each of the three.
    """
    clicked = F.when(F.col("open_date").isNotNull(), F.col("click_date"))

    def days(column: Column | str) -> Column:
        return F.size(F.collect_set(column)).cast("bigint")

    return nudges.groupBy("provider", "region", "item", "sent_date").agg(
        days("open_date").alias("open_count"),
        days(clicked).alias("click_count"),
        days("unsub_date").alias("unsub_count"),
    )


def opener_count(roster: DataFrame) -> DataFrame:
    """How many recipients opened the campaign: one row."""
    return roster.where(F.col("opens") > 0).agg(
        F.count_distinct("region", "provider").alias("openers")
    )


def roster_qa(roster: DataFrame) -> DataFrame:
    """One row to check a roster by: members, sends, opens, openers."""
    known = F.col("provider").isNotNull() & F.col("region").isNotNull()
    return (
        roster.groupBy("provider", "region")
        .agg(
            F.sum("sends").alias("sends"),
            F.sum("opens").alias("opens"),
            F.max("opens").alias("most"),
        )
        .agg(
            F.count(F.when(known, 1)).alias("members"),
            F.sum("sends").alias("sends"),
            F.sum("opens").alias("opens"),
            F.count(F.when(known & (F.col("most") > 0), 1)).alias("openers"),
        )
    )
