from pyspark.sql import functions as F

import oracle
from frames import DATES, LABELS, day, frame, rows
from nudgetrail.operators.changes import (
    first_change,
    merge_change,
    persistence,
    state_at_first_change,
)
from nudgetrail.operators.joins import provider_dims
from nudgetrail.operators.report import (
    audience_size,
    changed_share,
    openers_by_country,
    pre_post_summary,
)
from nudgetrail.queries import QUERIES
from sampled import duck_on


def persistent_of(spark, *flags):
    df = frame(spark, "flags", *flags)
    return persistence(df, state_at_first_change(df, first_change(df)), DATES)


def course(*days, changed=(), nexts=True, **more):
    """One row per (day, rating); each looks ahead to the next."""
    ratings = [r for _, r in days] + [None]
    return [
        {
            "date": day(n),
            "rating": r,
            "next_rating": ratings[i + 1] if nexts else None,
            "attributed_change": n in changed,
            **more,
        }
        for i, (n, r) in enumerate(days)
    ]


def test_first_change_counts_days_not_rows(spark):
    flags = frame(
        spark,
        "flags",
        *course((6, "A"), (6, "A"), (8, "A"), changed=(6, 8)),
        *course((9, "A"), changed=(9,), original_price=50.0),
        *course((5, "A")),
    )
    assert rows(first_change(flags), "original_price", "first_change_date", "change_days") == [
        (50.0, day(9), 1),
        (100.0, day(6), 2),
    ]


def test_rating_that_returns_after_a_gap_counts_both_runs(spark):
    found = persistent_of(
        spark, *course((6, "A"), (7, "B"), (8, "C"), (20, "B"), (27, "B"), changed=(6,))
    )
    assert rows(found, "first_change_date", "following_rating", "days_persisted") == [
        (day(6), "B", 3)
    ]


def test_change_on_the_last_observed_or_last_possible_day_never_counts(spark):
    assert persistent_of(spark, *course((6, "A"), (7, "B"), changed=(7,))).count() == 0
    late = course((29, "A"), (30, "B"), changed=(29,))
    assert persistent_of(spark, *late).count() == 0


def test_two_anchor_states_do_not_double_count_days(spark):
    first = course((6, "A"), (7, "B"), changed=(6,))
    second = course((8, "A"), (9, "B"), (10, "B"), changed=(8,), original_price=50.0)
    found = persistent_of(spark, *first, *second)
    assert rows(found, "first_change_date", "following_rating", "days_persisted") == [
        (day(6), "B", 3),
        (day(8), "B", 2),
    ]


def test_item_without_an_area_is_lost(spark):
    flags = frame(spark, "flags", *course((6, "A"), (7, "B"), changed=(6,), area=None))
    first = first_change(flags)
    assert first.count() == 1
    assert state_at_first_change(flags, first).count() == 0
    assert merge_change(flags, first, state_at_first_change(flags, first)).count() == 0


def test_persistence_equals_counting_over_the_merged_rows(spark):
    flags = frame(
        spark,
        "flags",
        *course((6, "A"), (7, "B"), (9, "B"), (12, "C"), changed=(6, 12)),
        *course((8, "B"), (9, "C"), (10, "B"), changed=(8,), original_price=50.0),
        *course((6, "A"), (8, "A"), changed=(6,), item=11),
    )
    first = first_change(flags)
    at_change = state_at_first_change(flags, first)
    merged = merge_change(flags, first, at_change)
    counted = (
        merged.where("date > first_change_date and rating = following_rating")
        .groupBy("item", "first_change_date", "following_rating")
        .agg(F.count_distinct("date").alias("days_persisted"))
    )
    columns = ("item", "first_change_date", "following_rating", "days_persisted")
    found = rows(persistence(flags, at_change, DATES), *columns)
    assert len(found) == 3
    assert found == rows(counted, *columns)


def test_merged_rows_and_states_give_every_price(spark):
    sample = "/root/testdata/sf0.01"
    merged = QUERIES["merge_change"](spark, sample)
    state = QUERIES["state_at_first_change"](spark, sample)
    key = ("provider", "region", "item", "area", "first_change_date", "following_rating")
    state = state.select(*[F.col(c).alias(f"s_{c}") for c in key], "price_at_first_change")
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in key]
    full = merged.join(state, same, "left")
    every_row = """
        SELECT count(*) FROM flags
        JOIN (SELECT provider, region, item, area, first_change_date FROM first)
          USING (provider, region, item, area)
        LEFT JOIN at_change USING (provider, region, item, area, first_change_date)"""
    (rows_in_sql,) = duck_on(sample).execute(oracle._with(oracle.STEPS, every_row)).fetchone()
    assert full.count() == rows_in_sql > merged.count()
    price = F.col("price_at_first_change")
    inside = price.between(F.col("lowest_price_at_change"), F.col("highest_price_at_change"))
    assert full.where(price.isNotNull() & ~inside).count() == 0


def dims_of(spark):
    return provider_dims(
        frame(
            spark,
            "site",
            {"provider": 1, "country": "AWAY"},
            {"provider": 2, "country": "AWAY"},
            {"provider": 3, "country": "ELSEWHERE"},
            {"provider": 4, "country": None},
        ),
        frame(
            spark,
            "acct",
            {"provider": 1, "account_id": "x"},
            {"provider": 2, "account_id": "y"},
            {"provider": 9, "account_id": "x"},
        ),
        frame(
            spark,
            "account",
            {"account_id": "x", "segment": "BIG", "fallback_segment": "OTHER"},
            {"account_id": "y", "segment": None, "fallback_segment": "SMALL"},
        ),
    )


def persistent(spark):
    return frame(
        spark,
        "persistent",
        {"first_change_date": day(14)},
        {"first_change_date": day(14), "following_rating": "BEST"},
        {"first_change_date": day(14), "item": 11},
        {"first_change_date": day(15)},
        {"provider": 2, "item": 20, "first_change_date": day(16)},
        {"provider": 3, "item": 30, "first_change_date": day(16)},
        {"provider": 4, "item": 40, "first_change_date": day(16)},
        {"provider": 9, "item": 90, "first_change_date": day(16)},
    )


SUMMARY = ("country", "segment", "time_period", "changed_items", "changed_providers",
           "items_per_provider")


def test_summary_labels_periods_and_counts(spark):
    summary = pre_post_summary(persistent(spark), dims_of(spark), DATES, LABELS)
    assert rows(summary, *SUMMARY) == [
        ("Away", "BIG", "POST", 1, 1, 1.0),  # a change on the campaign date
        ("Away", "BIG", "PRE", 2, 1, 2.0),
        ("Away", "SMALL", "POST", 1, 1, 1.0),
        ("Home", None, "POST", 2, 2, 1.0),  # no country, and no site at all
        ("Other", None, "POST", 1, 1, 1.0),
    ]


def test_summary_is_ordered_with_nulls_first(spark):
    df, dims = persistent(spark), dims_of(spark)
    found = pre_post_summary(df, dims, DATES, LABELS).collect()
    assert [(r["country"], r["segment"]) for r in found] == [
        ("Other", None),
        ("Home", None),
        ("Away", "SMALL"),
        ("Away", "BIG"),
        ("Away", "BIG"),
    ]
    by_segment = pre_post_summary(df, dims, DATES, LABELS, by_country=False).collect()
    assert [(r["segment"], r["time_period"]) for r in by_segment] == [
        (None, "POST"),
        ("SMALL", "POST"),
        ("BIG", "PRE"),
        ("BIG", "POST"),
    ]
    by_provider = pre_post_summary(df, dims, DATES, LABELS, grain="provider").collect()
    providers = [r["provider"] for r in by_provider]
    assert providers == sorted(providers, reverse=True)


def test_summary_options(spark):
    df, dims = persistent(spark), dims_of(spark)
    plain = pre_post_summary(df, dims, DATES, LABELS, by_country=False, use_fallback=False)
    assert rows(plain, "segment", "time_period", "changed_providers") == [
        (None, "POST", 4), ("BIG", "POST", 1), ("BIG", "PRE", 1),
    ]
    away = pre_post_summary(df, dims, DATES, LABELS, country="Away")
    assert {r["country"] for r in away.collect()} == {"Away"}
    detail = pre_post_summary(df, dims, DATES, LABELS, grain="provider")
    assert rows(detail, "provider", "time_period", "changed_items") == [
        (1, "POST", 1), (1, "PRE", 2), (2, "POST", 1), (3, "POST", 1), (4, "POST", 1),
        (9, "POST", 1),
    ]


def test_audience_and_share_count_by_region(spark):
    roster = frame(
        spark,
        "roster",
        {"provider": 1},
        {"provider": 2},
        {"provider": 8},
        {"provider": 8, "region": "Q"},
        {"provider": None, "region": None},
    )
    dims = dims_of(spark)
    audience = audience_size(roster, dims, LABELS)
    assert rows(audience, "country", "segment", "provider_count") == [
        ("Away", "BIG", 1), ("Away", "SMALL", 1), ("Home", None, 1),
    ]
    by_region = audience_size(roster, dims, LABELS, provider_key=("provider", "region"))
    summary = pre_post_summary(persistent(spark), dims, DATES, LABELS)
    share = changed_share(summary, by_region)
    assert rows(share, "country", "segment", "time_period", "changed_share") == [
        ("Away", "BIG", "POST", 1.0),
        ("Away", "BIG", "PRE", 1.0),
        ("Away", "SMALL", "POST", 1.0),
        ("Home", None, "POST", 1.0),
        ("Other", None, "POST", None),
    ]


def test_openers_by_country_count_by_region(spark):
    members = [(1, "P", 1), (2, "P", 0), (8, "P", 1), (8, "Q", 1), (None, None, 1)]
    roster = frame(spark, "roster", *[{"provider": p, "region": r, "opens": n} for p, r, n in members])
    dims = spark.createDataFrame(
        [(1, "P", None, "s", "f"), (2, "P", "AA", "s", "f"), (8, "P", "??", "s", "f")],
        "provider long, region string, country string, segment string, fallback_segment string",
    )
    found = openers_by_country(roster, dims, LABELS)
    assert rows(found, "country", "openers") == [("Home", 2), ("Other", 1)]
