from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from frames import DATES, RATING, day, frame, noon, rows
from nudgetrail.operators.cycles import (
    anchor_state,
    flag_changes,
    nudged_predictions,
    send_cycles,
    trajectory,
)
from nudgetrail.operators.joins import interval_join

ANCHOR = ("item", "sent_date", "obs_date", "original_rating", "original_price")


def inputs(spark, sends, observation, prediction2):
    sends = frame(spark, "sends", *sends)
    predictions = nudged_predictions(
        frame(spark, "prediction2", *prediction2), sends, DATES, RATING
    )
    return sends, frame(spark, "observation", *observation), predictions


def anchors_of(spark, sends, observation, prediction2=()):
    return anchor_state(*inputs(spark, sends, observation, prediction2), DATES, RATING)


def trajectory_of(spark, sends, observation, prediction2=(), ontology=()):
    sends, log, predictions = inputs(spark, sends, observation, prediction2)
    cycles = send_cycles(anchor_state(sends, log, predictions, DATES, RATING), DATES)
    dims = frame(spark, "ontology", *ontology)
    return trajectory(log, dims, predictions, cycles, DATES, RATING)


def test_send_without_observation_is_kept_with_nulls(spark):
    found = anchors_of(
        spark,
        [{"sent_date": day(5)}, {"sent_date": day(6)}, {"sent_date": day(7)}],
        [
            {"run_time": noon(5)},
            {"run_time": noon(5, 18)},
            {"run_time": noon(6), "is_new": True},
            {"run_time": noon(7), "region": "Q"},
        ],
    )
    assert rows(found, *ANCHOR) == [
        (10, day(5), day(5), "FAIR", 100.0),
        (10, day(6), None, None, None),
        (10, day(7), None, None, None),
    ]


def test_several_states_of_a_day_are_separate_rows(spark):
    found = anchors_of(
        spark,
        [{"sent_date": day(5)}],
        [{"run_time": noon(5)}, {"run_time": noon(5, 18), "price": 90.0}],
    )
    assert rows(found, "original_price") == [(90.0,), (100.0,)]


def test_anchor_rating_comes_from_the_second_model_in_its_country(spark):
    found = anchors_of(
        spark,
        [{"sent_date": day(5)}, {"sent_date": day(6)}, {"sent_date": day(7)}],
        [{"run_time": noon(n), "country": c} for n, c in ((5, "SPECIAL"), (6, "HOME"),
                                                          (7, "SPECIAL"))],
        [{"creation_date": day(5), "base_rating": "LOW"},
         {"creation_date": day(6), "base_rating": "LOW"},
         {"creation_date": day(7), "base_rating": "ODD"}],
    )
    assert rows(found, "sent_date", "original_rating") == [
        (day(5), "GOOD"), (day(6), "FAIR"), (day(7), "FAIR"),
    ]


def test_unmatched_send_closes_the_cycle_before_it(spark):
    cycles = send_cycles(
        anchors_of(spark, [{"sent_date": day(5)}, {"sent_date": day(9)}], [{"run_time": noon(5)}]),
        DATES,
    )
    assert rows(cycles, "sent_date", "obs_date", "next_sent_date") == [
        (day(5), day(5), day(9)),
        (day(9), None, DATES.as_of),
    ]


def test_tied_states_run_on_once(spark):
    cycles = send_cycles(
        anchors_of(
            spark,
            [{"sent_date": day(5)}, {"sent_date": day(9)}],
            [
                {"run_time": noon(5), "price": 90.0},
                {"run_time": noon(5), "price": 80.0},
                {"run_time": noon(5), "price": None},
            ],
        ),
        DATES,
    )
    assert rows(cycles.where("sent_date = '2024-01-05'"), "original_price", "next_sent_date") == [
        (None, day(5)),
        (80.0, day(5)),
        (90.0, day(9)),
    ]


def test_items_without_an_id_still_close_each_other(spark):
    cycles = send_cycles(
        anchors_of(spark, [{"item": None, "sent_date": day(n)} for n in (5, 8)], []), DATES
    )
    assert rows(cycles, "sent_date", "next_sent_date") == [(day(5), day(8)), (day(8), DATES.as_of)]


def test_trajectory_follows_each_cycle_up_to_the_next_send(spark):
    found = trajectory_of(
        spark,
        [{"sent_date": day(5)}, {"sent_date": day(9)}],
        [{"run_time": noon(n), "price": 100.0 - n} for n in (3, 5, 8, 9, 28, 29, 30)],
        ontology=[{}],
    )
    assert rows(found, "sent_date", "date", "original_price", "price", "maker") == [
        (day(5), day(5), 95.0, 95.0, "M"),
        (day(5), day(8), 95.0, 92.0, "M"),
        (day(9), day(9), 91.0, 91.0, "M"),
        (day(9), day(28), 91.0, 72.0, "M"),
        (day(9), day(29), 91.0, 71.0, "M"),
    ]


def test_trajectory_counts_repeated_rows(spark):
    found = trajectory_of(
        spark,
        [{"sent_date": day(5)}],
        [{"run_time": noon(5), "country": "SPECIAL"}]
        + [{"run_time": noon(6, h), "country": "SPECIAL"} for h in (1, 2)],
        [{"creation_date": day(6), "base_rating": "LOW"}] * 3,
    )
    assert rows(found, "date", "rating", "row_count") == [
        (day(5), "FAIR", 1), (day(6), "GOOD", 6),
    ]


def test_interval_join_edges_and_bucket_width(spark):
    facts = spark.createDataFrame(
        [(1, date(2024, 1, n)) for n in range(1, 31)] + [(2, day(5)), (None, day(5))],
        "k int, day date",
    )
    spans = spark.createDataFrame(
        [
            (1, "a", day(3), day(5)),
            (1, "b", day(5), day(5)),
            (1, "c", day(28), date(2030, 1, 1)),
            (1, "d", None, day(9)),
            (1, "e", day(9), None),
            (1, "f", date(2023, 12, 1), day(2)),
            (None, "g", day(1), day(9)),
        ],
        "k int, name string, start date, stop date",
    )
    expected = [("a", day(3)), ("a", day(4)), ("c", day(28)), ("c", day(29)), ("c", day(30)),
                ("f", day(1))]
    for width in (1, 7, 400):
        found = interval_join(facts, spans, ["k"], "day", "start", "stop", width)
        assert rows(found, "name", "day") == expected


def flags_of(spark, *states, **options):
    full = [{"sent_date": day(5), "next_sent_date": day(20), **s} for s in states]
    return flag_changes(frame(spark, "states", *full), **options)


def test_send_day_is_dropped_and_unknowns_flag_nothing(spark):
    found = flags_of(
        spark,
        {"date": day(5), "price": 1.0, "rating": "GOOD"},
        {"date": day(6), "price": None, "rating": None},
        {"date": day(7), "price": 100.0, "rating": "FAIR"},
        {"date": day(8), "price": 60.0, "rating": "GOOD", "original_price": None},
    )
    columns = ("date", "price_delta", "price_lowered", "rating_changed", "attributed_change")
    assert rows(found, *columns) == [
        (day(6), 0.0, False, False, False),
        (day(7), 0.0, False, False, False),
        (day(8), 0.0, False, True, False),
    ]


def test_change_needs_lower_price_other_rating_and_an_open(spark):
    found = flags_of(
        spark,
        {"date": day(6), "price": 90.0, "rating": "GOOD"},
        {"date": day(7), "price": 90.0, "rating": "FAIR"},
        {"date": day(8), "price": 110.0, "rating": "GOOD"},
        {"date": day(9), "price": 90.0, "rating": "GOOD", "open_count": 0},
    )
    assert rows(found, "date", "attributed_change") == [
        (day(6), True), (day(7), False), (day(8), False), (day(9), False),
    ]


def test_decimal_prices_stay_decimal(spark):
    states = frame(
        spark,
        "states",
        {"date": day(6), "price": 90.1, "rating": "GOOD", "sent_date": day(5)},
        {"date": day(7), "price": None, "rating": "GOOD", "sent_date": day(5)},
    )
    for column in ("price", "original_price"):
        states = states.withColumn(column, F.col(column).cast("decimal(18,2)"))
    found = flag_changes(states)
    assert rows(found, "date", "price_delta", "attributed_change") == [
        (day(6), Decimal("-9.90"), True), (day(7), Decimal(0), False),
    ]


def test_look_ahead_crosses_regions_unless_told_not_to(spark):
    states = (
        {"date": day(6), "rating": "A"},
        {"date": day(7), "rating": "B", "region": "Q"},
        {"date": day(9), "rating": "C"},
    )
    assert rows(flags_of(spark, *states), "date", "next_rating") == [
        (day(6), "B"), (day(7), "C"), (day(9), None),
    ]
    by_region = flags_of(spark, *states, lookahead_keys=("provider", "region", "item"))
    assert rows(by_region, "date", "next_rating") == [
        (day(6), "C"), (day(7), None), (day(9), None),
    ]


def test_look_ahead_over_ties_equals_a_plain_window(spark):
    states = [
        {"date": day(n), "rating": r, "price": p, "maker": m}
        for n in (6, 7, 9)
        for r in ("A", "B", None)
        for p in (None, 1.0, 2.0)
        for m in (None, "M")
    ]
    found = rows(flags_of(spark, *states), "date", "rating", "next_rating")
    ordered = sorted(((s["date"], s["rating"] or "") for s in states))
    following = [r for _, r in ordered[1:]] + [""]
    expected = sorted((d, r, f) for (d, r), f in zip(ordered, following, strict=True))
    assert sorted((d, r or "", f or "") for d, r, f in found) == expected
