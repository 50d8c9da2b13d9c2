"""The whole study, its sinks, and properties its tables must have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nudgetrail.operators.cycles import ITEM_KEY
from nudgetrail.plans.study import SourceTables, run_study
from nudgetrail.settings import NudgeSpec, StudyDates
from nudgetrail.sources.standins import DATES, STUDY, SampleSources
from nudgetrail.sources import tables
from nudgetrail.sources.tables import cut, drop_result, drop_stages, read_source, write_result
from sampled import duck_on, oracle_rows, spark_rows

SAMPLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    return run_study(SampleSources(spark, SAMPLE), STUDY)


def test_study_equals_the_single_queries(results):
    duck = duck_on(SAMPLE)
    for name, df in {
        "campaign_roster": results.roster,
        "send_cycles": results.anchors,
        "flag_changes": results.flags,
        "persistence": results.persistent,
        "first_change": results.first,
        "state_at_first_change": results.at_change,
        "merge_change": results.merged,
        "openers_by_country": results.openers_by_country,
        "pre_post_summary": results.summary,
        "audience_size": results.audience,
        "opener_count": results.openers,
        "changed_share": results.share,
    }.items():
        assert spark_rows(df) == oracle_rows(duck, name), name


def test_cycles_of_an_item_do_not_overlap(results):
    cycles = results.anchors.where("obs_date < next_sent_date")
    a, b = cycles.alias("a"), cycles.alias("b")
    overlapping = a.join(b, ITEM_KEY).where(
        "a.obs_date < b.obs_date and b.obs_date < a.next_sent_date"
    )
    assert overlapping.count() == 0
    assert cycles.count() == cycles.select(*ITEM_KEY, "obs_date").distinct().count()


def test_trajectory_stays_inside_its_cycle(results):
    outside = results.flags.where("not (date > sent_date and date < next_sent_date)")
    assert outside.count() == 0


def test_persistence_is_bounded_by_days_observed_after_the_change(results):
    observed = (
        results.flags.join(results.persistent, [*ITEM_KEY, "area"])
        .where("date > first_change_date")
        .groupBy(*ITEM_KEY, "area", "first_change_date", "following_rating")
        .agg(F.count_distinct("date").alias("days"), F.max("days_persisted").alias("kept"))
    )
    assert observed.where("kept > days or kept < 1").count() == 0


def test_pre_and_post_add_up_to_the_changed_items(results):
    keys = [*ITEM_KEY, "area", "first_change_date"]
    total = results.summary.agg(F.sum("changed_items")).first()[0]
    assert total == results.persistent.select(*keys).distinct().count()


def test_results_can_be_kept_as_files_with_a_suffix(spark, tmp_path, results):
    src = SampleSources(spark, SAMPLE)
    kept = run_study(src, STUDY, f"{tmp_path}/out/", "_jan", by_country=False, use_fallback=False)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [
        "anchors_jan", "flags_jan", "persistent_jan", "roster",
    ]
    assert spark_rows(kept.persistent) == spark_rows(results.persistent)
    assert spark_rows(kept.summary) == oracle_rows(
        duck_on(SAMPLE), "pre_post_summary_by_segment"
    )


def test_tables_are_replaced(spark):
    write_result(spark.range(3).toDF("n"), "kept_numbers", "_a")
    again = write_result(spark.range(2).selectExpr("id as m"), "kept_numbers", "_a")
    assert again.columns == ["m"]
    assert read_source(spark, "kept_numbers_a").count() == 2
    spark.sql("SELECT m FROM kept_numbers_a").collect()
    drop_result(spark, "kept_numbers", "_a")
    assert not spark.catalog.tableExists("kept_numbers_a")


@pytest.mark.parametrize("place", ["folder", "table"])
def test_a_failing_write_leaves_the_last_result(spark, tmp_path, place):
    target = f"{tmp_path}/numbers" if place == "folder" else "last_numbers"
    write_result(spark.range(3).toDF("n"), target)
    broken = spark.range(9).selectExpr("if(id = 7, raise_error('lost'), id) AS n")
    with pytest.raises(Exception, match="lost"):
        write_result(broken, target)
    assert read_source(spark, target).count() == 3
    doubled = read_source(spark, target).selectExpr("n * 2 AS n")
    assert write_result(doubled, target).agg({"n": "sum"}).first()[0] == 6


STEPS = ("_drop_table", "_point", "_sweep")


class Lost(Exception):
    """A driver that dies."""


@pytest.mark.parametrize("place", ["folder", "table"])
@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_reader_sees_the_old_or_the_new_result_at_any_step(
    spark, tmp_path, monkeypatch, place, step, when
):
    if place == "folder" and step == "_drop_table":
        pytest.skip("a folder has no table to make way")
    target = f"{tmp_path}/numbers" if place == "folder" else "stepped_numbers"

    def rows():
        return sorted(r.n for r in read_source(spark, target).collect())

    old, new = [0, 1, 2], [0, 10, 20, 30]
    write_result(spark.range(3).toDF("n"), target)
    assert rows() == old
    plain = getattr(tables, step)

    def dies(*args):
        if when == "after":
            plain(*args)
        assert rows() in (old, new)
        raise Lost

    with monkeypatch.context() as patch:
        patch.setattr(tables, step, dies)
        with pytest.raises(Lost):
            write_result(spark.range(4).selectExpr("id * 10 AS n"), target)
    assert rows() in (old, new)
    held = read_source(spark, target)
    before = rows()
    write_result(spark.range(2).toDF("n"), target)
    assert rows() == [0, 1]
    if (step, when) == ("_sweep", "after"):
        assert sorted(r.n for r in held.collect()) == before  # a reader that began earlier
    write_result(spark.range(1).toDF("n"), target)
    home = target if place == "folder" else tables._view_folder(spark, target)
    fs, path = tables._file(spark, f"{home}/_versions")
    assert len(fs.listStatus(path)) == 2
    drop_result(spark, target)
    assert not fs.exists(path)


def test_a_plain_folder_or_table_is_taken_over(spark, tmp_path):
    spark.range(5).toDF("n").write.parquet(f"{tmp_path}/plain")
    assert read_source(spark, f"{tmp_path}/plain").count() == 5
    doubled = read_source(spark, f"{tmp_path}/plain").selectExpr("n * 2 AS n")
    assert write_result(doubled, f"{tmp_path}/plain").agg({"n": "sum"}).first()[0] == 20
    assert sorted(p.name for p in (tmp_path / "plain").iterdir() if p.name[0] != ".") == [
        "_current", "_versions",
    ]
    spark.range(5).toDF("n").write.saveAsTable("plain_numbers")
    assert write_result(spark.range(2).toDF("n"), "plain_numbers").count() == 2
    drop_result(spark, "plain_numbers")


def test_stages_can_be_dropped(spark):
    other = cut(spark.range(3).toDF("n"), "numbers").inputFiles()[0]
    drop_stages(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(other)


def test_sources_can_be_plain_frames(spark):
    sample = SampleSources(spark, SAMPLE)
    src = SourceTables(**{f: getattr(sample, f) for f in SourceTables.__dataclass_fields__})
    assert STUDY.roster(src).count() > 0


def test_cut_goes_to_the_checkpoint_folder_each_time_anew(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    first, second = (cut(spark.range(3).toDF("n"), "numbers") for _ in range(2))
    assert first.count() == second.count() == 3
    paths = {df.inputFiles()[0] for df in (first, second)}
    assert len(paths) == 2
    assert all(folder in path for path in paths)


def test_settings_are_checked():
    with pytest.raises(ValueError, match="member"):
        NudgeSpec(("NUDGE",), "p", "i", member="some")
    with pytest.raises(ValueError, match="nudge_start"):
        StudyDates(
            DATES.campaign_date,
            DATES.nudge_end,
            DATES.nudge_start,
            DATES.obs_start,
            DATES.obs_end,
            DATES.as_of,
        )
