from dataclasses import replace

import pytest

from frames import CAMPAIGN, DATES, NUDGE, day, frame, noon, rows
from nudgetrail.operators.messages import (
    campaign_roster,
    campaign_roster_rows,
    nudge_sends,
    opener_count,
    roster_qa,
    send_engagement,
)

ROSTER = ("provider", "region", "sends", "opens")
NUDGES = ("provider", "region", "item", "sent_date")


def digest(msg, sent=15, **more):
    return {"msg_id": msg, "msg_type": "DIGEST", "sent_time": noon(sent), **more}


def roster_of(spark, send, context, track, spec=CAMPAIGN):
    return campaign_roster(
        frame(spark, "send", *send),
        frame(spark, "context", *context),
        frame(spark, "track", *track),
        spec,
        DATES,
    )


def provider(msg, value, **more):
    return {"msg_id": msg, "key": "provider", "value_int": value, **more}


def item(msg, value, **more):
    return {"msg_id": msg, "key": "item", "value_int": value, **more}


def test_roster_flags_stay_one_with_several_events(spark):
    found = roster_of(
        spark,
        [digest("a"), digest("b")],
        [provider("a", 1), provider("b", 2)],
        [{"msg_id": "a"}, {"msg_id": "a", "event_type": "reread"}, {"msg_id": "b",
         "event_type": "click"}],
    )
    assert rows(found, *ROSTER) == [(1, "R", 1, 1), (2, "R", 1, 0)]


def test_roster_keeps_message_without_provider_as_null(spark):
    found = roster_of(spark, [digest("a"), digest("b")], [provider("b", 2)], [])
    assert rows(found, *ROSTER) == [(None, None, 0, 0), (2, "R", 1, 0)]


def test_roster_needs_context_and_event_of_the_same_region(spark):
    found = roster_of(
        spark,
        [digest("a"), digest("b")],
        [provider("a", 1, region="Q"), provider("b", 2)],
        [{"msg_id": "b", "region": "Q"}],
    )
    assert rows(found, *ROSTER) == [(None, None, 0, 0), (2, "R", 1, 0)]


@pytest.mark.parametrize(
    ("sent", "address", "kept"),
    [
        (14, "x@out.example", True),
        (16, "x@out.example", True),
        (13, "x@out.example", False),
        (17, "x@out.example", False),
        (15, "x@in.example", False),
        (15, None, False),
    ],
)
def test_roster_day_and_address(spark, sent, address, kept):
    found = roster_of(spark, [digest("a", sent, address=address)], [provider("a", 1)], [])
    assert rows(found, *ROSTER) == ([(1, "R", 1, 0)] if kept else [])


def test_row_count_roster_counts_joined_rows_and_remaps_regions(spark):
    spec = replace(CAMPAIGN, day_slack=0, environment="LIVE", region_remap={"OLD": "R"})
    found = campaign_roster_rows(
        frame(
            spark, "send", digest("a"), digest("b", open_time=noon(15)), digest("c"),
            digest("d", 16),
        ),
        frame(
            spark, "context", provider("a", 1), provider("b", None), provider("c", None),
            provider("d", 4),
        ),
        frame(
            spark,
            "track",
            {"msg_id": "a"},
            {"msg_id": "a", "region": "OLD", "event_type": "click"},
            {"msg_id": "a", "environment": "TEST"},
            {"msg_id": "b"},
            {"msg_id": "c"},
            {"msg_id": "d"},
        ),
        spec,
        DATES,
    )
    # Without a provider the sent branch counts nothing; the unopened branch still counts.
    assert rows(found, *ROSTER) == [(None, "R", 0, 1), (1, "R", 2, 2)]


def nudges_of(spark, send, context, roster, spec=NUDGE):
    return nudge_sends(
        frame(spark, "send", *send),
        frame(spark, "context", *context),
        frame(spark, "roster", *roster),
        spec,
        DATES,
    )


def test_message_with_two_items_gives_two_rows_and_copies_give_one(spark):
    found = nudges_of(
        spark,
        [{"msg_id": m, "sent_time": noon(5)} for m in ("a", "b")],
        [provider("a", 1), item("a", 10), item("a", 11), provider("b", 1), item("b", 10)],
        [{"provider": 1}],
    )
    assert rows(found, *NUDGES) == [(1, "R", 10, day(5)), (1, "R", 11, day(5))]


@pytest.mark.parametrize(("sent", "kept"), [(3, False), (4, True), (25, True), (26, False)])
def test_nudge_window_is_half_open(spark, sent, kept):
    found = nudges_of(
        spark,
        [{"msg_id": "a", "sent_time": noon(sent, 23)}],
        [provider("a", 1), item("a", 10)],
        [{"provider": 1}],
    )
    assert found.count() == int(kept)


@pytest.mark.parametrize(("member", "kept"), [("listed", 2), ("opened", 1)])
def test_listed_members_need_not_have_opened(spark, member, kept):
    found = nudges_of(
        spark,
        [{"msg_id": m, "sent_time": noon(5)} for m in ("a", "b", "c")],
        [provider("a", 1), item("a", 10), provider("b", 2), item("b", 20), provider("c", 3),
         item("c", 30)],
        [{"provider": 1}, {"provider": 2, "opens": 0}, {"provider": 3, "region": "Q"}],
        replace(NUDGE, member=member),
    )
    assert found.count() == kept


def test_same_id_in_two_regions_crosses_unless_matched(spark):
    send = [{"msg_id": "a", "region": r, "sent_time": noon(n)} for r, n in (("R", 5), ("Q", 6))]
    context = [provider("a", 1), item("a", 10), item("a", 99, region="Q")]
    crossed = nudges_of(spark, send, context, [{"provider": 1}])
    assert rows(crossed, "item", "sent_date") == [
        (10, day(5)), (10, day(6)), (99, day(5)), (99, day(6)),
    ]
    matched = nudges_of(spark, send, context, [{"provider": 1}], replace(NUDGE, match_region=True))
    assert rows(matched, "item", "sent_date") == [(10, day(5))]


def test_exclusion_is_on_the_id_or_the_address(spark):
    send = [
        {"msg_id": "x-in.example", "sent_time": noon(5), "address": "a@out.example"},
        {"msg_id": "b", "sent_time": noon(6), "address": "a@in.example"},
    ]
    context = [provider("x-in.example", 1), item("x-in.example", 10), provider("b", 1),
               item("b", 10)]
    spec = replace(NUDGE, exclude_pattern="%in.example%")
    on_id = nudges_of(spark, send, context, [{"provider": 1}], spec)
    assert rows(on_id, "sent_date") == [(day(6),)]
    on_address = nudges_of(
        spark, send, context, [{"provider": 1}], replace(spec, exclude_on="address")
    )
    assert rows(on_address, "sent_date") == [(day(5),)]


def test_click_without_open_does_not_count_but_unsubscribe_does(spark):
    found = send_engagement(
        frame(
            spark,
            "nudges",
            {"sent_date": day(5), "click_date": day(5), "unsub_date": day(6)},
            {"sent_date": day(5), "open_date": day(5), "click_date": day(7)},
            {"sent_date": day(5), "open_date": day(5), "click_date": day(8)},
            {"sent_date": day(6)},
        )
    )
    assert rows(found, "sent_date", "open_count", "click_count", "unsub_count") == [
        (day(5), 1, 2, 1),
        (day(6), 0, 0, 0),
    ]


def test_roster_counts(spark):
    roster = frame(
        spark,
        "roster",
        {"provider": 1, "region": "23"},
        {"provider": 12, "region": "3"},
        {"provider": 5, "opens": 0},
        {"provider": None, "region": None, "sends": 0, "opens": 0},
    )
    assert rows(opener_count(roster), "openers") == [(2,)]
    assert rows(roster_qa(roster), "members", "sends", "opens", "openers") == [(3, 3, 2, 2)]
