"""The whole study: sources in, stage tables and report frames out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.operators.changes import (
    first_change,
    merge_change,
    persistence,
    state_at_first_change,
)
from nudgetrail.operators.cycles import (
    anchor_state,
    flag_changes,
    nudged_observations,
    nudged_predictions,
    send_cycles,
    trajectory,
)
from nudgetrail.operators.joins import provider_dims
from nudgetrail.operators.messages import (
    campaign_roster,
    campaign_roster_rows,
    nudge_sends,
    opener_count,
    send_engagement,
)
from nudgetrail.operators.report import (
    audience_size,
    changed_share,
    openers_by_country,
    pre_post_summary,
)
from nudgetrail.settings import CampaignSpec, NudgeSpec, RatingRules, ReportLabels, StudyDates
from nudgetrail.sources.tables import (
    DayTable,
    cut,
    read_note,
    read_source,
    write_note,
    write_result,
)


class Sources(Protocol):
    """The tables a study reads, in the schemas of FIXTURES.md."""

    send: DataFrame
    context: DataFrame
    track: DataFrame
    observation: DataFrame
    prediction2: DataFrame
    ontology: DataFrame
    site: DataFrame
    acct: DataFrame
    account: DataFrame


@dataclass(frozen=True)
class SourceTables:
    """Sources given as frames, for instance from ``read_source``."""

    send: DataFrame
    context: DataFrame
    track: DataFrame
    observation: DataFrame
    prediction2: DataFrame
    ontology: DataFrame
    site: DataFrame
    acct: DataFrame
    account: DataFrame


@dataclass(frozen=True)
class Nudged:
    """The nudges of a study, and the log and predictions cut down to their items, all written."""

    sends: DataFrame
    log: DataFrame
    predictions: DataFrame


def _members(roster: DataFrame, spec: NudgeSpec) -> DataFrame:
    """The members of a roster whose nudges a study takes."""
    taken = roster.where("opens > 0") if spec.member == "opened" else roster
    return taken.select("provider", "region").dropna().distinct()


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


@dataclass(frozen=True)
class Study:
    """One campaign's settings."""

    dates: StudyDates
    campaign: CampaignSpec
    nudge: NudgeSpec
    rating: RatingRules
    labels: ReportLabels
    #: A column of the log that is the day of run_time in every row, if it is partitioned by one.
    run_date: str | None = None
    #: The earlier form of the roster: tracked messages only, counts of rows instead of flags.
    earlier_roster: bool = False
    #: What the look-ahead to the next rating runs within.
    lookahead_keys: Sequence[str] = ("provider", "item")

    def roster(self, src: Sources) -> DataFrame:
        form = campaign_roster_rows if self.earlier_roster else campaign_roster
        return form(src.send, src.context, src.track, self.campaign, self.dates)

    def nudges(self, src: Sources, roster: DataFrame) -> DataFrame:
        return nudge_sends(src.send, src.context, roster, self.nudge, self.dates)

    def nudged(self, src: Sources, roster: DataFrame) -> Nudged:
        sends = cut(send_engagement(self.nudges(src, roster)), "sends")
        log = nudged_observations(src.observation, sends, self.dates, self.run_date)
        predictions = nudged_predictions(src.prediction2, sends, self.dates, self.rating)
        return Nudged(sends, cut(log, "log"), cut(predictions, "predictions"))

    def nudged_by_day(
        self, src: Sources, roster: DataFrame, folder: str, since: date | None = None
    ) -> Nudged:
        """What ``nudged`` gives, kept by day in ``folder``, so that a later run only adds days.

        A run reads sends, item log and predictions from the first day that the folder lacks, or
        from ``since`` if that is earlier: the first day with rows that have changed, messages
        opened since among them. The days before are read from the folder. The context has no
        days: it is scanned whole and joined to the messages of the new days. Of the days before an
        item's first nudge the log may lack rows that ``nudged`` has; no stage reads them.

        With another first day, nudge specification or set of members than the folder's, all days
        are written anew. The folder's note says how far it is whole, and says less
        before a run replaces days, so that the next run mends what a lost driver left. One writer
        at a time; frames of an earlier run that nothing has written see the new days.
        """
        spark, dates = roster.sparkSession, self.dates
        note = f"{folder}/_whole"
        members = _members(roster, self.nudge)
        first_log_day = max(dates.obs_start, dates.nudge_start)
        settings = repr(
            (self.nudge, self.rating.special_country, dates.nudge_start, first_log_day)
        )
        known = json.loads(read_note(spark, note) or "{}")
        if known.get("settings") == settings and _same_rows(
            members, read_source(spark, f"{folder}/members")
        ):
            sends_to, log_to = (date.fromisoformat(known[end]) for end in ("sends_to", "log_to"))
        else:
            sends_to = log_to = date.min

        # New nudges need the log of their items from their day on, so all begin on one day.
        begins = [since] if since is not None else []
        begins += [sends_to] if sends_to < dates.nudge_end else []
        begins += [log_to] if log_to <= dates.obs_end else []
        begin = min(begins, default=max(sends_to, log_to))

        def say(sends_end: date, log_end: date) -> None:
            ends = {"sends_to": sends_end.isoformat(), "log_to": log_end.isoformat()}
            write_note(spark, note, json.dumps({"settings": settings, **ends}))

        sends_to, log_to = min(sends_to, begin), min(log_to, begin)
        say(sends_to, log_to)
        if begin == date.min:
            write_result(members, f"{folder}/members")

        first = max(begin, dates.nudge_start)
        sends = DayTable(spark, f"{folder}/sends", "sent_date")
        sends.drop(begin)
        if first < dates.nudge_end:
            new = replace(dates, nudge_start=first)
            sends.add(
                send_engagement(nudge_sends(src.send, src.context, roster, self.nudge, new))
            )
            sends_to = dates.nudge_end

        log = DayTable(spark, f"{folder}/log", "run_day")
        predictions = DayTable(spark, f"{folder}/predictions", "creation_date")
        log.drop(begin)
        predictions.drop(begin)
        if first <= dates.obs_end or begin == date.min:
            new = replace(dates, obs_start=min(max(first, first_log_day), dates.obs_end))
            nudged = sends.read()
            found = nudged_observations(src.observation, nudged, new, self.run_date)
            log.add(found.withColumn("run_day", F.to_date("run_time")))
            predictions.add(nudged_predictions(src.prediction2, nudged, new, self.rating))
            log_to = dates.obs_end + timedelta(days=1)
        say(sends_to, log_to)

        return Nudged(
            sends.read(dates.nudge_start, dates.nudge_end - timedelta(days=1)),
            log.read(first_log_day, dates.obs_end).drop("run_day"),
            predictions.read(first_log_day, dates.obs_end),
        )

    def anchors(self, nudged: Nudged) -> DataFrame:
        return anchor_state(
            nudged.sends, nudged.log, nudged.predictions, self.dates, self.rating
        )

    def cycles(self, nudged: Nudged) -> DataFrame:
        return send_cycles(self.anchors(nudged), self.dates)

    def trajectory(self, src: Sources, nudged: Nudged, cycles: DataFrame) -> DataFrame:
        return trajectory(
            nudged.log, src.ontology, nudged.predictions, cycles, self.dates, self.rating
        )

    def flags(self, src: Sources, nudged: Nudged, cycles: DataFrame) -> DataFrame:
        return flag_changes(self.trajectory(src, nudged, cycles), self.lookahead_keys)

    def persistent(self, flags: DataFrame) -> DataFrame:
        """Lasting changes; ``flags`` is read three times, so pass it written or cut."""
        at_change = state_at_first_change(flags, first_change(flags))
        return persistence(flags, at_change, self.dates)


@dataclass(frozen=True)
class Results:
    """Tables of a run, and the frames made from them, which nothing has computed yet.

    ``flags`` holds the trajectory's rows with their flags. Of the frames, ``merged`` is the largest;
    the study itself does not read it.
    """

    roster: DataFrame
    anchors: DataFrame
    flags: DataFrame
    persistent: DataFrame
    first: DataFrame
    at_change: DataFrame
    merged: DataFrame
    summary: DataFrame
    audience: DataFrame
    openers: DataFrame
    openers_by_country: DataFrame
    share: DataFrame


def run_study(
    src: Sources,
    study: Study,
    target: str | None = None,
    suffix: str = "",
    *,
    by_country: bool = True,
    use_fallback: bool = True,
    country: str | None = None,
    grain: str = "segment",
    by_day: str | None = None,
    since: date | None = None,
) -> Results:
    """Runs every stage and returns its tables and reports.

    With a ``target`` prefix (a path ending in a slash, or ``catalog.schema.``) the four stage
    tables replace ``<target>roster``, ``anchors``, ``flags`` and ``persistent``, all but the
    roster with the suffix. Without one they go to the checkpoint folder. With a folder
    ``by_day``, a run for a later window adds to what earlier runs kept there, and reads the sources
    from ``since`` or the first missing day on (``Study.nudged_by_day``).
    """

    def keep(df: DataFrame, name: str, end: str = suffix) -> DataFrame:
        return cut(df, name) if target is None else write_result(df, target + name, end)

    roster = keep(study.roster(src), "roster", "")
    if by_day is None:
        nudged = study.nudged(src, roster)
    else:
        nudged = study.nudged_by_day(src, roster, by_day, since)
    anchors = keep(study.cycles(nudged), "anchors")
    flags = keep(study.flags(src, nudged, anchors), "flags")
    persistent = keep(study.persistent(flags), "persistent")

    first = first_change(flags)
    at_change = state_at_first_change(flags, first)
    dims = provider_dims(src.site, src.acct, src.account)
    groups = {"by_country": by_country, "use_fallback": use_fallback}
    summary = pre_post_summary(
        persistent, dims, study.dates, study.labels, country=country, grain=grain, **groups
    )
    by_region = audience_size(
        roster, dims, study.labels, provider_key=("provider", "region"), **groups
    )
    return Results(
        roster=roster,
        anchors=anchors,
        flags=flags,
        persistent=persistent,
        first=first,
        at_change=at_change,
        merged=merge_change(flags, first, at_change),
        summary=summary,
        audience=audience_size(roster, dims, study.labels, **groups),
        openers=opener_count(roster),
        openers_by_country=openers_by_country(roster, dims, study.labels),
        share=changed_share(summary, by_region, by_country=by_country),
    )
