"""Several distinct counts of one row set, against counts made one by one."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from frames import DATES, LABELS, SCHEMAS
from nudgetrail.operators.messages import roster_qa, send_engagement
from nudgetrail.operators.report import pre_post_summary
from sampled import spark_rows

DAYS = [DATES.campaign_date + timedelta(days=n) for n in range(-6, 7)]


def _random_rows(spark, schema: str, n: int, seed: int):
    """Rows with few values a column, so that all repeat, and a NULL among them."""
    choices = {
        "bigint": [None, 0, 1, 2, 3],
        "string": [None, "Away", "Home", "x"],
        "date": [None, *DAYS],
    }
    pick = random.Random(seed)
    kinds = [column.split()[1] for column in SCHEMAS[schema].split(", ")]
    made = [tuple(pick.choice(choices[kind]) for kind in kinds) for _ in range(n)]
    return spark.createDataFrame(made, SCHEMAS[schema])


def _no_expand(df):
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [0, 600])
def test_engagement_counts_days(spark, n):
    nudges = _random_rows(spark, "nudges", n, 1)
    found = send_engagement(nudges)
    nudges.createOrReplaceTempView("counted_nudges")
    one_by_one = spark.sql(
        """
        SELECT provider, region, item, sent_date,
               count(DISTINCT open_date) AS open_count,
               count(DISTINCT if(open_date IS NULL, NULL, click_date)) AS click_count,
               count(DISTINCT unsub_date) AS unsub_count
        FROM counted_nudges GROUP BY ALL"""
    )
    _no_expand(found)
    assert found.dtypes == one_by_one.dtypes
    assert spark_rows(found) == spark_rows(one_by_one)


@pytest.mark.parametrize("n", [0, 40])
def test_roster_counts_members_with_both_columns(spark, n):
    roster = _random_rows(spark, "roster", n, 2)
    found = roster_qa(roster)
    roster.createOrReplaceTempView("counted_roster")
    one_by_one = spark.sql(
        """
        SELECT count(DISTINCT provider, region) AS members, sum(sends) AS sends,
               sum(opens) AS opens,
               count(DISTINCT if(opens > 0, provider, NULL), if(opens > 0, region, NULL))
                 AS openers
        FROM counted_roster"""
    )
    _no_expand(found)
    assert found.dtypes == one_by_one.dtypes
    assert spark_rows(found) == spark_rows(one_by_one)


@pytest.mark.parametrize("n", [0, 600])
@pytest.mark.parametrize("grain", ["segment", "provider"])
def test_summary_counts_items_and_providers(spark, n, grain):
    rows = _random_rows(spark, "persistent", n, 3).where("first_change_date IS NOT NULL")
    dims = spark.createDataFrame(
        [(p, r, f"s{p % 2}", None, r) for p in range(3) for r in ("Away", "Home")],
        "provider bigint, region string, segment string, fallback_segment string, country string",
    )
    found = pre_post_summary(rows, dims, DATES, LABELS, grain=grain, use_fallback=False)
    detail = "provider, region," if grain == "provider" else ""
    rows.join(dims, ["provider", "region"], "left").createOrReplaceTempView("counted_rows")
    periods = spark.sql(
        f"""
        SELECT {detail} country AS code, segment,
               first_change_date < DATE'{DATES.campaign_date}' AS before,
               count(DISTINCT provider, region, item, area, first_change_date) AS changed_items,
               count(DISTINCT provider, region) AS changed_providers
        FROM counted_rows GROUP BY ALL"""
    )
    _no_expand(found)
    assert dict(found.dtypes)["changed_items"] == "bigint"
    numbers = ["changed_items", "changed_providers"]
    keys = ["segment", *(["provider", "region"] if detail else [])]
    # Country labels may merge codes: compare where each label has one.
    totals = [
        spark_rows(df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers]))
        for df in (found, periods)
    ]
    assert totals[0] == totals[1]
    assert (n == 0) == found.isEmpty()
