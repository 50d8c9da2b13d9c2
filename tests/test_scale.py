"""Skew, row order and plan shape."""

from __future__ import annotations

import shutil
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from nudgetrail.operators import joins, lookahead
from nudgetrail.operators.cycles import nudged_observations, nudged_predictions
from nudgetrail.operators.messages import nudge_sends
from nudgetrail.plans.study import Nudged
from nudgetrail.queries import QUERIES
from nudgetrail.sources.standins import DATES, NUDGE, RATING, STUDY, SampleSources
from nudgetrail.sources.tables import cut
from sampled import duck_on, oracle_rows, spark_rows

SAMPLE = "/root/testdata/sf0.01"
SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.maxMetadataStringLength": "1000",
}


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    """The sample with a third of all events on one user, each three times, in random order."""
    out = tmp_path_factory.mktemp("hot")
    for table in ("region", "nation", "customer"):
        shutil.copy(f"{SAMPLE}/{table}.parquet", out)
    duckdb.execute(
        f"""
        COPY (
          SELECT e.event_id * 3 + c AS event_id, ts,
                 CASE WHEN hash(e.event_id) % 3 = 0 THEN 8 ELSE user_id END AS user_id,
                 event_type, value, props
          FROM '{SAMPLE}/events.parquet' e, range(3) r(c)
          ORDER BY hash(e.event_id * 3 + c)
        ) TO '{out}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 5000)"""
    )
    return str(out)


@pytest.fixture
def splitting(spark):
    """Settings under which even sample partitions count as skewed, and nothing is broadcast."""
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    for key, value in SMALL_PARTITIONS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    [
        "campaign_roster",
        "campaign_roster_rows",
        "send_engagement",
        "send_cycles",
        "next_observation",
        "interval_join",
        "trajectory",
        "flag_changes",
        "merge_change",
        "persistence",
        "changed_share",
    ],
)
def test_hot_key_gives_the_same_result(splitting, hot_dir, name):
    expected = oracle_rows(duck_on(hot_dir), name)
    assert expected
    assert spark_rows(contract.queries()[name](splitting, hot_dir)) == expected


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _ran(df) -> str:
    """The final plan, as it was after running."""
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


def test_hot_key_is_split_where_the_log_is_joined(splitting, hot_dir):
    src = SampleSources(splitting, hot_dir)
    sends = cut(QUERIES["send_engagement"](splitting, hot_dir), "sends")
    log = cut(src.observation, "log")
    nudged = nudged_observations(log, sends, DATES)
    assert "SortMergeJoin(skew=true) [provider" in _ran(nudged)

    cycles = cut(QUERIES["send_cycles"](splitting, hot_dir), "cycles")
    predictions = cut(nudged_predictions(src.prediction2, sends, DATES, RATING), "predictions")
    states = STUDY.trajectory(src, Nudged(sends, log, predictions), cycles)
    split = [line for line in _ran(states).splitlines() if "SortMergeJoin(skew=true)" in line]
    assert any("__bucket" in line for line in split)
    assert any("entity" in line for line in split)


def test_look_ahead_shuffles_once_and_spreads_one_key(splitting, monkeypatch):
    seen = {}

    def kept(df, stage):
        seen[stage] = df
        return cut(df, stage)

    monkeypatch.setattr(lookahead, "cut", kept)
    rows = splitting.range(4000, numPartitions=4).selectExpr(
        "1 AS key", "int(id DIV 1500) AS day", "id AS value"
    )
    found = lookahead.with_next(rows, ["key"], ["day"], "day", "next_day")
    ranged = _plan(seen["looked"])
    assert ranged.count("Exchange ") == 1 and "Exchange rangepartitioning" in ranged
    assert "Exchange" not in _ran(found).replace("BroadcastExchange", "")
    tasks = cut(seen["looked"], "again").groupBy("__task").count().collect()
    assert max(r["count"] for r in tasks) < 4000 / 3
    days = {r.value: r.next_day for r in found.collect()}
    want = {i: (i + 1) // 1500 if i < 3999 else None for i in range(4000)}
    assert days == want


def test_date_bounds_reach_the_scans(spark):
    src = SampleSources(spark, SAMPLE)
    sends = spark.createDataFrame([], "provider bigint, region string, item bigint")
    log = nudged_observations(src.observation, sends, DATES)
    assert "PushedFilters" in _plan(log)
    assert "GreaterThanOrEqual(ts," in _plan(log)
    assert ">= 2024-01-04 00:00:00" in _plan(log)
    predictions = nudged_predictions(src.prediction2, sends, DATES, RATING)
    assert "GreaterThanOrEqual(ts," in _plan(predictions)


def test_days_outside_the_study_are_not_read(spark, tmp_path):
    src = SampleSources(spark, SAMPLE)
    path = f"{tmp_path}/log"
    src.observation.withColumn("run_date", F.to_date("run_time")).write.partitionBy(
        "run_date"
    ).parquet(path)
    sends = QUERIES["send_engagement"](spark, SAMPLE)
    log = nudged_observations(spark.read.parquet(path), sends, DATES, "run_date")
    plan = _plan(log)
    assert "PartitionFilters: [isnotnull(run_date" in plan
    plain = nudged_observations(src.observation, sends, DATES)
    assert spark_rows(log) == spark_rows(plain)
    for other in (F.lit(None).cast("date"), F.current_date()):  # a name alone decides nothing
        named = src.observation.withColumn("run_date", other)
        assert spark_rows(nudged_observations(named, sends, DATES)) == spark_rows(plain)


def _scans(plan: str, path) -> int:
    return sum("Scan parquet" in line and str(path) in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["anchor_state", "campaign_roster"])
def test_hot_right_rows_are_dealt_to_parts(splitting, hot_dir, monkeypatch, name):
    made = []

    def hot_keys(rows, on, rows_a_task):
        made.append(kept(rows, on, rows_a_task))
        return made[-1]

    kept = joins.hot_keys
    monkeypatch.setattr(joins, "hot_keys", hot_keys)
    monkeypatch.setattr(joins, "ROWS_A_TASK", 1)
    assert spark_rows(contract.queries()[name](splitting, hot_dir)) == oracle_rows(
        duck_on(hot_dir), name
    )
    assert made and (name != "anchor_state" or made[-1].count() > 100)


def test_left_join_reads_the_left_side_once_and_writes_nothing(splitting, tmp_path):
    spark = splitting
    left = spark.createDataFrame(
        [(3, "a"), (3, "b"), (4, "c"), (30, "d"), (None, "e")], "k bigint, name string"
    )
    left.write.parquet(f"{tmp_path}/left")
    rows = [(3, i % 700) for i in range(1400)] + [(4, 1), (4, 1), (5, 2), (None, 3), (4, None)]
    right = spark.createDataFrame(rows, "k bigint, v int").repartition(4)
    left = spark.read.parquet(f"{tmp_path}/left")
    folder = set(tmp_path.parent.rglob("matched*"))
    for repeats in (True, False):
        found = joins.left_join_hot_right(left, right, ["k"], repeats=repeats, rows_a_task=100)
        expected = left.join(right if repeats else right.distinct(), "k", "left")
        assert spark_rows(found.select(*expected.columns)) == spark_rows(expected)
        assert _scans(_ran(found), f"{tmp_path}/left") == 1
    assert set(tmp_path.parent.rglob("matched*")) == folder
    parts = joins.hot_keys(right, ["k"], 100).collect()
    assert [tuple(r) for r in parts] == [(3, 14)]
    bare = joins.left_join_hot_right(left, right.select("k"), ["k"], rows_a_task=100)
    assert spark_rows(bare) == spark_rows(left.join(right.select("k"), "k", "left"))


def test_nudges_scan_the_send_log_and_the_context_once(splitting, tmp_path):
    src = SampleSources(splitting, SAMPLE)
    src.send.write.parquet(f"{tmp_path}/send")
    src.context.write.parquet(f"{tmp_path}/context")
    send, context = (splitting.read.parquet(f"{tmp_path}/{x}") for x in ("send", "context"))
    roster = cut(STUDY.roster(src), "roster")
    for match in (False, True):
        spec = replace(NUDGE, match_region=match)
        df = nudge_sends(send, context, roster, spec, DATES)
        ran = _ran(df)
        assert _scans(ran, f"{tmp_path}/send") == _scans(ran, f"{tmp_path}/context") == 1
        assert "ReusedExchange" in ran
    assert spark_rows(nudge_sends(send, context, roster, NUDGE, DATES)) == oracle_rows(
        duck_on(SAMPLE), "nudge_sends"
    )
