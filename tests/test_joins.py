"""The two skew-proof operators against their plain forms, on random rows with NULLs and ties."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nudgetrail.operators.joins import bucketed_spans, interval_join, null_safe_join
from nudgetrail.operators.lookahead import with_next
from sampled import spark_rows


NAN = float("nan")  # one object, so that equal rows are equal in a set


def pick(rng, *values):
    return rng.choice([*values, None])


@pytest.mark.parametrize("seed", range(4))
def test_look_ahead_equals_a_plain_window(spark, seed):
    rng = random.Random(seed)
    data = {
        (
            pick(rng, 1, 2, 3),
            pick(rng, 1, 2, 3, 4),
            pick(rng, "a", "b"),
            pick(rng, 0.5, NAN, -1.0, 7.25),
            pick(rng, True, False),
        )
        for _ in range(300)
    }
    df = spark.createDataFrame(
        list(data), "key int, day int, label string, price double, flag boolean"
    )
    for order, value in ((["day"], "day"), (["day", "label"], "label")):
        rest = [c for c in df.columns if c not in ("key", *order)]
        window = Window.partitionBy("key").orderBy(*order, *rest)
        expected = df.withColumn("following", F.lead(value).over(window))
        found = with_next(df, ["key"], order, value, "following")
        assert spark_rows(found) == spark_rows(expected)


def test_look_ahead_needs_its_value_among_the_order_columns(spark):
    with pytest.raises(ValueError, match="order columns"):
        with_next(spark.range(1), [], ["id"], "other", "following")


@pytest.mark.parametrize("width", [1, 3, 50])
def test_interval_join_equals_a_plain_range_join(spark, width):
    rng = random.Random(width)
    first = date(1969, 12, 20)

    def day():
        return pick(rng, *[first + timedelta(days=n) for n in range(30)])

    facts = spark.createDataFrame(
        [(pick(rng, 1, 2), day(), n) for n in range(200)], "key int, day date, fact int"
    )
    spans = spark.createDataFrame(
        [(pick(rng, 1, 2), day(), day(), n) for n in range(60)],
        "key int, start date, stop date, span int",
    )
    expected = facts.join(spans, "key").where("day >= start and day < stop")
    found = interval_join(facts, spans, ["key"], "day", "start", "stop", width)
    assert expected.count() > 0
    assert spark_rows(found.select(*expected.columns)) == spark_rows(expected)


def test_spans_of_any_length_touch_few_buckets(spark):
    start = date(2001, 5, 17)
    lengths = [-1, 0, 1, 6, 7, 8, 55, 56, 57, 400, 447, 448, 449, 3650, 3653, 30000, 900000]
    rows = [(n, start, start + timedelta(days=n)) for n in lengths]
    spans = spark.createDataFrame([*rows, (-2, None, start)], "n int, start date, stop date")
    found = bucketed_spans(spans, "start", "stop", 7).groupBy("n").agg(
        F.count("*").alias("rows"), F.max("__level").alias("level")
    )
    copies = {r["n"]: r["rows"] for r in found.collect()}
    assert copies.keys() == {n for n in lengths if n > 0}
    assert max(copies.values()) <= 9
    levels = {r["n"]: r["level"] for r in found.collect()}
    assert [levels[n] for n in (1, 56, 57, 448, 449, 3650)] == [0, 0, 1, 1, 2, 3]


def test_interval_join_of_spans_of_all_lengths(spark):
    rng = random.Random(9)
    first = date(1965, 3, 1)
    facts = spark.createDataFrame(
        [(rng.choice([1, 1, 1, 2]), first + timedelta(days=rng.randrange(9000)), n) for n in range(900)],
        "key int, day date, fact int",
    )
    spans = []
    for n in range(120):
        start = first + timedelta(days=rng.randrange(9000))
        length = rng.choice([1, 5, 56, 57, 300, 448, 3650, 8000])
        spans.append((rng.choice([1, 2, 3]), start, start + timedelta(days=length), n))
    spans = spark.createDataFrame(spans, "key int, start date, stop date, span int")
    expected = facts.join(spans, "key").where("day >= start and day < stop")
    assert expected.count() > 4000
    found = interval_join(facts, spans, ["key"], "day", "start", "stop")
    assert spark_rows(found.select(*expected.columns)) == spark_rows(expected)
    assert interval_join(facts, spans.limit(0), ["key"], "day", "start", "stop").count() == 0


def test_null_safe_join_matches_nulls_and_keeps_left_keys(spark):
    left = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    right = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    found = null_safe_join(left, right, ["k"], "left")
    assert found.columns == ["k", "a", "b"]
    assert [tuple(r) for r in found.orderBy("a").collect()] == [
        (None, 1, 10),
        ("x", 2, 20),
        ("y", 3, None),
    ]
