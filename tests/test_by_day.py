"""A study kept by day and carried on to a later window."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from nudgetrail.operators.cycles import ITEM_KEY
from nudgetrail.plans.study import SourceTables, run_study
from nudgetrail.sources.standins import DATES, STUDY, SampleSources
from nudgetrail.sources.tables import DayTable, cut, read_note
from sampled import spark_rows

SAMPLE = "/root/testdata/sf0.01"
MIDDLE = date(2024, 1, 16)
UNTIL_MIDDLE = replace(
    STUDY, dates=replace(DATES, nudge_end=MIDDLE, obs_end=MIDDLE, as_of=MIDDLE)
)


@pytest.fixture(scope="module")
def src(spark):
    sample = SampleSources(spark, SAMPLE)
    frames = {f: getattr(sample, f) for f in SourceTables.__dataclass_fields__}
    for name in ("send", "context", "observation", "prediction2"):
        frames[name] = cut(frames[name], name)
    return SourceTables(**frames)


@pytest.fixture(scope="module")
def roster(src):
    return cut(STUDY.roster(src), "roster")


def _from(src: SourceTables, day: date) -> SourceTables:
    """The sources without the nudges, observations and predictions of the days before."""
    day = F.lit(day)
    old_nudge = F.col("msg_type").isin(*STUDY.nudge.message_types) & (F.to_date("sent_time") < day)
    return replace(
        src,
        send=src.send.where(~old_nudge),
        observation=src.observation.where(F.to_date("run_time") >= day),
        prediction2=src.prediction2.where(F.col("creation_date") >= day),
    )


def _outcome(nudged):
    """The sends, and the rows of the other two from an item's first nudge on: what stages read."""

    def followed(rows, key, day):
        first = nudged.sends.groupBy(*key).agg(F.min("sent_date").alias("first"))
        return spark_rows(rows.join(first, key).where(day >= F.col("first")).drop("first"))

    return (
        spark_rows(nudged.sends),
        followed(nudged.log, ITEM_KEY, F.to_date("run_time")),
        followed(nudged.predictions, ["item"], F.col("creation_date")),
    )


def _flags(src, nudged, study=STUDY):
    return spark_rows(study.flags(src, nudged, study.cycles(nudged)))


@pytest.fixture(scope="module")
def expected(src, roster):
    return STUDY.nudged(src, roster)


@pytest.fixture(scope="module")
def whole(expected):
    return _outcome(expected)


@pytest.fixture(scope="module")
def flags(src, expected):
    return _flags(src, expected)


@pytest.fixture
def folder(src, roster, tmp_path):
    path = f"{tmp_path}/days"
    UNTIL_MIDDLE.nudged_by_day(src, roster, path)
    return path


def test_a_later_window_needs_no_earlier_source_row(src, roster, folder, whole, flags):
    nudged = STUDY.nudged_by_day(_from(src, MIDDLE), roster, folder)
    assert _outcome(nudged) == whole
    assert _flags(src, nudged) == flags
    # Nothing is new to the same window, and an earlier window is read from the same folder.
    nothing = _from(src, date(2025, 1, 1))
    assert _outcome(STUDY.nudged_by_day(nothing, roster, folder)) == whole
    earlier = UNTIL_MIDDLE.nudged_by_day(nothing, roster, folder)
    alone = UNTIL_MIDDLE.nudged(src, roster)
    assert _flags(src, earlier, UNTIL_MIDDLE) == _flags(src, alone, UNTIL_MIDDLE)


def test_the_scans_begin_at_the_first_new_day(src, roster, folder, monkeypatch):
    plans = []
    add = DayTable.add

    def noted(self, rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        add(self, rows)

    monkeypatch.setattr(DayTable, "add", noted)
    STUDY.nudged_by_day(src, roster, folder)
    sends, log, predictions = plans
    for plan, column in ((sends, "sent_time"), (log, "run_time"), (predictions, "creation_date")):
        assert MIDDLE.isoformat() in plan, column
        assert DATES.nudge_start.isoformat() not in plan, column


def test_rows_that_came_late_are_taken_in(src, roster, tmp_path, whole):
    late_day = F.lit(date(2024, 1, 12))
    path = f"{tmp_path}/days"
    early = replace(
        src,
        send=src.send.where(F.to_date("sent_time") != late_day),
        observation=src.observation.where(F.to_date("run_time") != late_day),
    )
    UNTIL_MIDDLE.nudged_by_day(early, roster, path)
    nudged = STUDY.nudged_by_day(_from(src, date(2024, 1, 12)), roster, path, date(2024, 1, 12))
    assert _outcome(nudged) == whole


def test_days_that_lost_their_rows_are_emptied(src, roster, folder):
    gone = date(2024, 1, 14)
    less = replace(
        src,
        send=src.send.where(F.to_date("sent_time") != F.lit(gone)),
        observation=src.observation.where(F.to_date("run_time") != F.lit(gone)),
    )
    nudged = STUDY.nudged_by_day(less, roster, folder, gone)
    assert nudged.sends.where(F.col("sent_date") == F.lit(gone)).isEmpty()
    assert _outcome(nudged) == _outcome(STUDY.nudged(less, roster))


@pytest.mark.parametrize("change", ["members", "nudge", "first day"])
def test_what_the_folder_cannot_answer_is_written_anew(src, roster, folder, change):
    study, members = STUDY, roster
    if change == "members":
        members = roster.where("provider % 3 != 0")
    elif change == "nudge":
        study = replace(STUDY, nudge=replace(STUDY.nudge, member="opened"))
    else:
        study = replace(
            STUDY, dates=replace(DATES, nudge_start=DATES.nudge_start + timedelta(days=3))
        )
    nudged = study.nudged_by_day(src, members, folder)
    assert _outcome(nudged) == _outcome(study.nudged(src, members))


@pytest.mark.parametrize("step", range(3))
def test_a_run_makes_good_for_one_that_was_lost(
    src, roster, folder, whole, monkeypatch, step
):
    """The driver dies in the middle of one of the three tables, with some of its days written."""
    add, calls = DayTable.add, []

    def dies(self, rows):
        calls.append(self.day)
        if len(calls) <= step:
            return add(self, rows)
        add(self, rows.where(F.dayofmonth(self.day) % 2 == 0))
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(DayTable, "add", dies)
        with pytest.raises(RuntimeError, match="lost"):
            STUDY.nudged_by_day(src, roster, folder, since=date(2024, 1, 14))
    said = json.loads(read_note(roster.sparkSession, f"{folder}/_whole"))
    assert said["sends_to"] == said["log_to"] == "2024-01-14"
    nudged = STUDY.nudged_by_day(_from(src, date(2024, 1, 14)), roster, folder)
    assert _outcome(nudged) == whole


def test_nothing_nudged_and_an_observation_window_before_the_nudges(src, roster, tmp_path):
    nobody = roster.where("false")
    nudged = STUDY.nudged_by_day(src, nobody, f"{tmp_path}/nobody")
    assert nudged.sends.isEmpty() and nudged.log.isEmpty()
    dates = replace(DATES, obs_end=DATES.nudge_start - timedelta(days=1))
    study = replace(STUDY, dates=dates)
    nudged = study.nudged_by_day(src, roster, f"{tmp_path}/before")
    assert not nudged.sends.isEmpty() and nudged.log.isEmpty()
    # Carried on, the log begins with the nudges.
    nudged = STUDY.nudged_by_day(src, roster, f"{tmp_path}/before")
    assert _outcome(nudged) == _outcome(STUDY.nudged(src, roster))


def test_run_study_takes_the_folder(src, folder, flags):
    results = run_study(src, STUDY, by_day=folder)
    assert spark_rows(results.flags) == flags
