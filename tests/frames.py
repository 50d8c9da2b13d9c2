"""Small hand-made source frames: rows name only the columns that matter to a case."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from nudgetrail.settings import (
    Bands,
    CampaignSpec,
    NudgeSpec,
    RatingRules,
    ReportLabels,
    StudyDates,
)

SCHEMAS = {
    "send": "msg_id string, region string, msg_type string, address string, "
    "sent_time timestamp_ntz, open_time timestamp_ntz, click_time timestamp_ntz, "
    "unsub_time timestamp_ntz",
    "context": "msg_id string, region string, key string, value_int bigint",
    "track": "msg_id string, region string, environment string, event_type string",
    "roster": "provider bigint, region string, sends bigint, opens bigint",
    "nudges": "provider bigint, region string, item bigint, sent_date date, open_date date, "
    "click_date date, unsub_date date",
    "sends": "provider bigint, region string, item bigint, sent_date date, open_count bigint, "
    "click_count bigint, unsub_count bigint",
    "observation": "item bigint, provider bigint, region string, area bigint, entity bigint, "
    "country string, run_time timestamp_ntz, price double, rating string, final_rating string, "
    "final_score double, no_dealer_score double, neutral_score double, variance double, "
    "is_new boolean",
    "prediction2": "item bigint, creation_date date, country string, base_rating string",
    "ontology": "entity bigint, region string, maker string, model string, year int",
    "states": "item bigint, provider bigint, region string, area bigint, maker string, "
    "model string, model_year int, date date, price double, rating string, sent_date date, "
    "next_sent_date date, open_count bigint, click_count bigint, unsub_count bigint, "
    "original_price double, original_rating string, price_at_next_band double, row_count bigint",
    "flags": "item bigint, provider bigint, region string, area bigint, sent_date date, "
    "next_sent_date date, open_count bigint, date date, original_price double, price double, "
    "price_delta double, price_lowered boolean, original_rating string, rating string, "
    "rating_changed boolean, next_rating string, attributed_change boolean",
    "persistent": "provider bigint, region string, item bigint, area bigint, "
    "first_change_date date, following_rating string, days_persisted bigint",
    "site": "provider bigint, region string, country string",
    "acct": "provider bigint, region string, account_id string",
    "account": "account_id string, segment string, fallback_segment string",
}

DEFAULTS = {
    "send": {"region": "R", "msg_type": "NUDGE", "address": "a@out.example"},
    "context": {"region": "R"},
    "track": {"region": "R", "environment": "LIVE", "event_type": "read"},
    "roster": {"region": "R", "sends": 1, "opens": 1},
    "nudges": {"provider": 1, "region": "R", "item": 10},
    "sends": {
        "provider": 1, "region": "R", "item": 10, "open_count": 1, "click_count": 0,
        "unsub_count": 0,
    },
    "observation": {
        "item": 10, "provider": 1, "region": "R", "area": 5, "entity": 7, "country": "HOME",
        "price": 100.0, "rating": "FAIR", "final_rating": "FAIR", "final_score": 0.0,
        "neutral_score": 0.0, "variance": 4.0, "is_new": False,
    },
    "prediction2": {"item": 10, "country": "SPECIAL"},
    "ontology": {"entity": 7, "region": "R", "maker": "M", "model": "X", "year": 2000},
    "states": {
        "item": 10, "provider": 1, "region": "R", "area": 5, "open_count": 1, "click_count": 0,
        "unsub_count": 0, "original_price": 100.0, "original_rating": "FAIR", "row_count": 1,
    },
    "flags": {
        "item": 10, "provider": 1, "region": "R", "area": 5, "open_count": 1,
        "original_price": 100.0, "price": 90.0, "original_rating": "FAIR",
        "attributed_change": False,
    },
    "persistent": {
        "provider": 1, "region": "R", "item": 10, "area": 5, "following_rating": "GOOD",
        "days_persisted": 1,
    },
    "site": {"region": "R"},
    "acct": {"region": "R"},
    "account": {},
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
    message_types=("DIGEST",),
    provider_key="provider",
    open_events=("read", "reread"),
    internal_address="%@in.%",
)
NUDGE = NudgeSpec(message_types=("NUDGE",), provider_key="provider", item_key="item")
RATING = RatingRules(
    special_country="SPECIAL",
    relabel={"LOW": "GOOD", "LOWER": "GOOD", "HIGH": "POOR"},
    display={"FAIR_ONE": "Fair", "OK": "Fair"},
    top_label="Great",
    bands={"HOME": Bands((-1.0, 0.0, 1.0, 2.0), 3.0)},
    launch_date=date(2024, 1, 2),
)
LABELS = ReportLabels(countries={"HOME": "Home", "AWAY": "Away"}, home_country="HOME")


def day(n: int) -> date:
    return date(2024, 1, n)


def noon(n: int, hour: int = 12) -> datetime:
    return datetime(2024, 1, n, hour)


def frame(spark: SparkSession, role: str, *rows: dict) -> DataFrame:
    full = [{**DEFAULTS[role], **row} for row in rows]
    columns = [c.strip().split()[0] for c in SCHEMAS[role].split(",")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in full], SCHEMAS[role])


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda t: tuple((v is not None, v) for v in t))
