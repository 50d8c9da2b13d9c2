import math

import pytest
from pyspark.sql import functions as F

from frames import RATING, frame, noon, rows
from nudgetrail.functions.ratings import (
    display_label,
    next_band_cutoff,
    price_at_next_band,
    relabel_rating,
)
from nudgetrail.settings import Bands


def test_relabel_falls_back_to_the_first_model(spark):
    df = spark.createDataFrame(
        [
            ("SPECIAL", "LOW", "FAIR"),
            ("SPECIAL", "LOWER", "FAIR"),
            ("SPECIAL", "HIGH", None),
            ("SPECIAL", "ODD", "FAIR"),
            ("SPECIAL", None, "FAIR"),
            ("HOME", "LOW", "FAIR"),
            (None, "LOW", "FAIR"),
        ],
        "country string, second string, first string",
    )
    label = relabel_rating(F.col("country"), F.col("second"), F.col("first"), RATING)
    assert [r[0] for r in df.select(label).collect()] == [
        "GOOD", "GOOD", "POOR", "FAIR", "FAIR", "FAIR", "FAIR",
    ]


def test_display_label(spark):
    df = spark.createDataFrame(
        [("FAIR_ONE",), ("OK",), ("VERY_GOOD_deal",), ("GREAT",), (None,)], "code string"
    )
    found = [r[0] for r in df.select(display_label(F.col("code"), RATING.display)).collect()]
    assert found == ["Fair", "Fair", "Very Good Deal", "Great", None]


BELOW = math.nextafter


@pytest.mark.parametrize(
    ("score", "cutoff"),
    [
        (-3.0, None),
        (BELOW(-3.0, 0.0), -1.0),
        (BELOW(-1.0, -2.0), -1.0),
        (-1.0, 0.0),
        (BELOW(0.0, -1.0), 0.0),
        (0.0, 1.0),
        (1.0, 2.0),
        (BELOW(2.0, 0.0), 2.0),
        (2.0, None),
        (3.0, None),
        (9.0, None),
        (None, None),
        (math.nan, None),
    ],
)
def test_cutoff_edges(spark, score, cutoff):
    df = spark.createDataFrame([("HOME", score), ("AWAY", score)], "country string, score double")
    found = df.select(next_band_cutoff(F.col("country"), F.col("score"), RATING.bands))
    assert [r[0] for r in found.collect()] == [cutoff, None]


def test_bands_must_ascend():
    with pytest.raises(ValueError, match="ascending"):
        Bands((0.0, -1.0), 3.0)


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, 100.0 - 2.0),  # cutoff 1, score 0, sqrt(4) = 2
        ({"final_score": 0.75}, 100.0 - 1.0),  # 0.25 * 2 = 0.5 rounds away from zero
        ({"variance": 0.0}, None),
        ({"variance": -4.0}, None),
        ({"variance": None}, None),
        ({"final_rating": "GREAT"}, None),
        ({"final_rating": None}, None),
        ({"provider": None}, None),
        ({"price": None}, None),
        ({"neutral_score": None}, None),
        ({"final_score": None}, None),
        ({"is_new": True}, None),
        ({"is_new": None}, None),
        ({"run_time": noon(1)}, None),
        ({"country": "AWAY"}, None),
    ],
)
def test_price_at_next_band_gates(spark, change, expected):
    df = frame(spark, "observation", {"run_time": noon(5), **change})
    assert rows(df.select(price_at_next_band(RATING).alias("p")), "p") == [(expected,)]
