"""The study's source tables, derived from the sample star schema.

None of the sample tables is a send log or a price log, so ``events`` plays both: each of its
five event types takes one part, and no row is left out.

    view      campaign message, sent at the event's time
    signup    nudge about the two items of the user
    click     opens, clicks and unsubscribes of the user's messages sent that day, by value
    purchase  observation of the user's first item, price = value
    error     observation of the user's second item, price = value

``customer``, ``nation`` and ``region`` describe the users, who are the providers.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgetrail.plans.study import Study
from nudgetrail.settings import (
    Bands,
    CampaignSpec,
    NudgeSpec,
    RatingRules,
    ReportLabels,
    StudyDates,
)
from nudgetrail.sources.tables import cut

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}
DATES = StudyDates(
    campaign_date=date(2024, 1, 15),
    nudge_start=date(2024, 1, 4),
    nudge_end=date(2024, 1, 26),
    obs_start=date(2024, 1, 1),
    obs_end=date(2024, 1, 29),
    as_of=date(2024, 1, 31),
)
CAMPAIGN = CampaignSpec(
    message_types=("DIGEST", "DIGEST_EU"),
    provider_key="provider_id",
    open_events=("read", "reread"),
    internal_address="%@furniture.%",
)
CAMPAIGN_ROWS = CampaignSpec(
    message_types=("DIGEST",),
    provider_key="provider_id",
    open_events=("read", "reread"),
    internal_address="%@furniture.%",
    day_slack=0,
    environment="LIVE",
    region_remap={"OLD_NATION_3": "NATION_3"},
)
NUDGE = NudgeSpec(
    message_types=("NUDGE", "NUDGE_EU"),
    provider_key="provider_id",
    item_key="item_id",
    exclude_pattern="%furniture%",
)
# Cutoffs are quantiles of the sample's values, as scores: (35 - value) / 20.
RATING = RatingRules(
    special_country="ASIA",
    relabel={"T1": "LOWEST_QUARTER", "T2": "MIDDLE_HALF", "T3": "HIGHEST_QUARTER"},
    display={
        "LOWER_MIDDLE": "Middle",
        "UPPER_MIDDLE": "Middle",
        "MIDDLE_HALF": "Middle",
    },
    top_label="Lowest Quarter",
    bands={
        "AFRICA": Bands((-1.25, 0.85), 5.0),
        "AMERICA": Bands((-3.85, -2.2, -1.25, 0.05, 0.85, 1.2), 5.0),
        "MIDDLE EAST": Bands((0.05,), 4.0),
    },
    launch_date=date(2024, 1, 6),
)
LABELS = ReportLabels(
    countries={"ASIA": "East", "MIDDLE EAST": "East", "AFRICA": "South", "EUROPE": "North"},
    home_country="EUROPE",
)
STUDY = Study(DATES, CAMPAIGN, NUDGE, RATING, LABELS)


def _banded(value: Column, labels: tuple[str, ...], limits: tuple[float, ...]) -> Column:
    band = F.lit(labels[-1])
    for label, limit in reversed(list(zip(labels, limits, strict=False))):
        band = F.when(value < limit, F.lit(label)).otherwise(band)
    return band


def _messages(events: DataFrame, providers: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "DIGEST").otherwise("NUDGE")
    european = F.when(F.col("country") == "EUROPE", "_EU").otherwise("")
    return (
        events.where(F.col("event_type").isin("view", "signup"))
        .join(providers, F.col("user_id") == F.col("provider"))
        .select(
            F.concat(F.lit("m"), F.col("event_id")).alias("msg_id"),
            "region",
            F.concat(kind, european).alias("msg_type"),
            F.concat("name", F.lit("@"), F.lower("segment"), F.lit(".example")).alias("address"),
            F.col("ts").alias("sent_time"),
            "provider",
            "segment",
        )
    )


def _send(messages: DataFrame, events: DataFrame) -> DataFrame:
    value = F.col("value")
    clicks = (
        events.where(F.col("event_type") == "click")
        .groupBy(F.col("user_id").alias("provider"), F.to_date("ts").alias("day"))
        .agg(
            F.min(F.when(value >= 8, F.col("ts"))).alias("open_time"),
            F.min(F.when((value >= 30) | (value < 12), F.col("ts"))).alias("click_time"),
            F.min(F.when(value < 5, F.col("ts"))).alias("unsub_time"),
        )
    )
    return (
        messages.withColumn("day", F.to_date("sent_time"))
        .join(clicks, ["provider", "day"], "left")
        .drop("day")
    )


def _context(messages: DataFrame) -> DataFrame:
    first = F.col("provider") * 2
    pairs = F.array(
        F.struct(F.lit("provider_id").alias("key"), F.col("provider").alias("value_int")),
        F.struct(F.lit("item_id").alias("key"), first.alias("value_int")),
        F.struct(F.lit("item_id").alias("key"), (first + 1).alias("value_int")),
    )
    return messages.select("msg_id", "region", F.inline(pairs))


def _track(send: DataFrame) -> DataFrame:
    again = F.when(F.col("click_time") > F.col("open_time"), F.col("click_time"))
    seen = F.array(
        F.struct(F.lit("read").alias("event_type"), F.col("open_time").alias("at")),
        F.struct(F.lit("reread").alias("event_type"), again.alias("at")),
        F.struct(F.lit("link").alias("event_type"), F.col("click_time").alias("at")),
        F.struct(F.lit("leave").alias("event_type"), F.col("unsub_time").alias("at")),
    )
    old = F.when(F.col("region") == "NATION_3", "OLD_").otherwise("")
    return (
        send.select(
            "msg_id",
            F.concat(old, F.col("region")).alias("region"),
            F.when(F.col("segment") == "MACHINERY", "TRIAL").otherwise("LIVE").alias("environment"),
            F.inline(seen),
        )
        .where(F.col("at").isNotNull())
        .drop("at")
    )


def _observation(events: DataFrame, providers: DataFrame) -> DataFrame:
    value = F.col("value")
    rating = _banded(
        value,
        ("LOWEST_QUARTER", "LOWER_MIDDLE", "UPPER_MIDDLE", "HIGHEST_QUARTER"),
        (14, 34, 69),
    )
    score = (F.lit(35.0) - value) / 20.0
    second_item = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return (
        events.where(F.col("event_type").isin("purchase", "error"))
        .join(providers, F.col("user_id") == F.col("provider"))
        .select(
            (F.col("provider") * 2 + second_item).alias("item"),
            "provider",
            "region",
            F.when(F.col("balance") >= 0, F.col("nation")).alias("area"),
            F.col("provider").alias("entity"),
            "country",
            F.col("ts").alias("run_time"),
            value.alias("price"),
            rating.alias("rating"),
            F.when(value.between(23, 46), "MIDDLE_HALF").otherwise(rating).alias("final_rating"),
            score.alias("final_score"),
            score.alias("no_dealer_score"),
            F.when(value >= 2, score).alias("neutral_score"),
            F.col("balance").alias("variance"),
            (value > 200).alias("is_new"),
        )
    )


def _prediction2(observation: DataFrame) -> DataFrame:
    """A second model that rates the first item only; the study has no label for UNSURE."""
    base = _banded(F.col("low"), ("T1", "T2", "UNSURE", "T3"), (18, 50, 60))
    return (
        observation.where(F.col("item") == F.col("provider") * 2)
        .groupBy("item", F.to_date("run_time").alias("creation_date"), "country")
        .agg(F.min("price").alias("low"))
        .select("item", "creation_date", "country", base.alias("base_rating"))
    )


class SampleSources:
    """The study's source tables over one directory of sample tables, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark = spark
        self._dir = sf_dir

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.schema(SCHEMAS[name]).parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        return self._table("events")

    @cached_property
    def _providers(self) -> DataFrame:
        nation = self._table("nation")
        return (
            self._table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("provider"),
                F.col("n_name").alias("region"),
                F.col("r_name").alias("country"),
                F.col("c_name").alias("name"),
                F.col("c_nationkey").cast("bigint").alias("nation"),
                F.col("c_acctbal").alias("balance"),
                F.col("c_mktsegment").alias("segment"),
            )
        )

    @cached_property
    def _sent(self) -> DataFrame:
        """All messages, written once: sends, context and tracking are read from it."""
        return cut(_send(_messages(self._events, self._providers), self._events), "messages")

    @cached_property
    def send(self) -> DataFrame:
        return self._sent.drop("provider", "segment")

    @cached_property
    def context(self) -> DataFrame:
        return _context(self._sent)

    @cached_property
    def track(self) -> DataFrame:
        return _track(self._sent)

    @cached_property
    def observation(self) -> DataFrame:
        return _observation(self._events, self._providers)

    @cached_property
    def prediction2(self) -> DataFrame:
        return _prediction2(self.observation)

    @cached_property
    def ontology(self) -> DataFrame:
        return self._providers.select(
            F.col("provider").alias("entity"),
            "region",
            F.col("segment").alias("maker"),
            F.col("name").alias("model"),
            (F.col("nation") + 1990).cast("int").alias("year"),
        )

    @cached_property
    def site(self) -> DataFrame:
        country = F.when(F.col("segment") != "MACHINERY", F.col("country"))
        return self._providers.select("provider", "region", country.alias("country"))

    @cached_property
    def acct(self) -> DataFrame:
        return self._providers.select("provider", "region", F.col("name").alias("account_id"))

    @cached_property
    def account(self) -> DataFrame:
        segment = F.col("segment")
        return self._providers.select(
            F.col("name").alias("account_id"),
            F.when(segment != "HOUSEHOLD", segment).alias("segment"),
            F.when(F.col("balance") >= 0, "DIRECT").alias("fallback_segment"),
        )
