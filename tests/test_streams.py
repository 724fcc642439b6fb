"""Streams over several runs: state goes on from run to run, late rows are left out and counted."""

from datetime import datetime, timedelta

import pytest

from trailnote.streaming import trails

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY = datetime(2024, 1, 1)


@pytest.fixture
def told(spark, tmp_path):
    """Rows of a stream after each of several arrivals (id, hours, user, type)."""

    def run(made, *arrivals):
        counts, folder, out = [], str(tmp_path / "in"), str(tmp_path / "out")
        for rows in arrivals:
            rows = [(i, None if h is None else DAY + timedelta(hours=h), u, e, 1.0) for i, h, u, e in rows]
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
            stream = made(trails.event_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema))
            trails.run_to_files(stream, out)
            counts.append(spark.read.schema(stream.schema).parquet(out).collect())
        return counts

    return run


def test_windows_close_by_the_watermark_and_leave_late_rows_out(told):
    first, second, third = told(trails.windowed_counts, [(1, 1, 1, "a"), (2, 2, 1, "a")], [(3, 5, 2, "a"), (4, 24 * 5, 1, "a")], [(5, 3, 1, "a"), (6, 24 * 20, 1, "b")])
    assert first == []
    assert [(r.start, r.event_type, r.n) for r in second] == [(DAY, "a", 3)]
    # Row 5 belongs to a day that has been told; the watermark leaves it out.
    assert sorted((r.start, r.n) for r in third) == [(DAY, 3), (DAY + timedelta(days=5), 1)]


def test_sessions_go_on_over_runs(told):
    *_, last = told(trails.sessions, [(1, 1, 1, "a")], [(2, 10, 1, "a"), (3, 40, 1, "a")], [(4, 24 * 20, 9, "a")])
    assert sorted((r.user_id, r.start, r.n) for r in last) == [(1, DAY + timedelta(hours=1), 2), (1, DAY + timedelta(hours=40), 1)]


def test_moves_go_on_over_runs_and_count_late_rows(told):
    *_, last = told(trails.transitions, [(1, 1, 1, "a"), (2, 9, 1, "b"), (3, 2, 2, "a")], [(4, 12, 1, "c"), (5, 5, 1, "x"), (6, None, 1, "y")], [(7, 13, 2, None)])
    assert sorted((r.run_id, r.state, r.next_state or "") for r in last if not r.n_late) == [(1, "a", "b"), (1, "b", "c"), (2, "a", "")]
    assert [(r.run_id, r.state, r.next_state) for r in last if r.n_late] == [(1, None, None)]
    assert sum(r.n_late for r in last) >= 1


def test_starts_and_events_meet_in_time_whichever_comes_first(told):
    def made(events):
        starts = events.filter("event_type = 's'").selectExpr("user_id", "event_id AS start_id", "ts AS started")
        return trails.met_in_time(starts, events.filter("event_type = 'e'"), "user_id", within="1 day", late="12 hours")

    # Event 2 comes before its start 3; 4 is too far; 5 is of another user; 6 and 7 meet over two arrivals; 9 and 10 are late on either side.
    *_, last = told(
        made,
        [(1, 1, 1, "s"), (2, 8, 2, "e")],
        [(3, 7, 2, "s"), (4, 26, 1, "e"), (5, 2, 3, "e"), (6, 20, 1, "e")],
        [(7, 200, 9, "s"), (8, 200, 9, "e")],
        [(9, 3, 1, "e"), (10, 1, 1, "s"), (11, 210, 9, "e")],
    )
    assert sorted((r.start_id, r.event_id) for r in last) == [(1, 6), (3, 2), (7, 8), (7, 11)]


def test_loops_are_reopened_by_their_timers(told):
    def made(events):
        return trails.reopened(events.selectExpr("user_id AS loop", "ts", "CASE WHEN event_type = 'away' THEN ts + INTERVAL 10 HOURS END AS until"), late="1 hour")

    first, second, third, last = told(
        made,
        # Loop 1 is looked at in time, loop 2 only after its time, loop 3 is put away anew, loop 4 never again.
        [(1, 1, 1, "away"), (2, 1, 2, "away"), (3, 1, 3, "away"), (4, 1, 4, "away"), (5, None, 4, "away")],
        [(6, 5, 1, "seen"), (7, 11.5, 2, "seen"), (8, 4, 3, "away")],
        [(9, 30, 9, "seen")],
        [(10, 60, 9, "seen")],
    )
    assert first == []
    # Timers of a run end in it or in the next one, as the watermark moves.
    at = lambda h: DAY + timedelta(hours=h)
    assert sorted((r.loop, r.offloaded, r.reopened) for r in last) == [(2, at(1), at(11)), (3, at(4), at(14)), (4, at(1), at(11))]
    assert len(third) <= len(last)
