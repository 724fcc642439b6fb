"""The state functions of streams by themselves."""

import time

import pandas as pd

from trailnote.streaming import trails


class State:
    """What the functions use of a group's state, for one batch without anything kept."""

    exists, hasTimedOut = False, False

    def getCurrentWatermarkMs(self):
        return 10**15

    def update(self, kept):
        self.kept = kept

    def setTimeoutTimestamp(self, ms):
        self.ms = ms


def test_a_loop_of_many_rows_is_decided_in_linear_time():
    ts = pd.Series(pd.date_range("2024-01-01", periods=20_000, freq="min"))
    rows = pd.DataFrame({"loop": 1, "ts": ts, "until": ts + pd.Timedelta(hours=1)})
    began = time.process_time()
    out = pd.concat(trails._woken((1,), iter([rows]), State()))
    assert out["offloaded"].tolist() == [ts.iloc[-1]] and time.process_time() - began < 4
