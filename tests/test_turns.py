"""Turn numbers of many sessions: over batches, with few calls to the state, and without ended sessions."""

from collections import Counter

import pandas as pd
import pytest
from test_streams import feed, state_rows

from tidewell.streaming import streams as S

DAY = 86_400_000
SCHEMA = "session_id string, id long, created_at long"


@pytest.mark.parametrize("quiet_ms", [S.QUIET_MS, 2 * DAY])
def test_sessions_of_one_group_over_batches(spark, tmp_path, monkeypatch, quiet_ms):
    monkeypatch.setattr(S, "GROUPS", 2)  # many sessions share a value of the state
    out, want, held, newest = [], [], {}, 0
    # sessions 0 to 59 begin, of which 20 to 59 go on at once; 40 to 59 go on after three weeks, others come anew
    batches = [(0, range(60), 3), (1, range(20, 80), 2), (21, [300], 1), (22, range(40, 100), 2), (23, range(10), 1), (60, [200], 1), (61, range(201, 203), 1)]
    sizes = []
    for n, (day, sessions, turns) in enumerate(batches):
        rows = [(f"s{s}" if s else None, 1000 * n + 10 * s + t, (day + 2) * DAY + 1000 * (turns - t) + s % 7) for s in sessions for t in range(turns)]
        mark = max(0, newest - DAY)
        for name in dict.fromkeys(r[0] for r in rows):
            own = sorted((at, i) for x, i, at in rows if x == name)
            first = held[name][0] if name in held and held[name][1] >= mark else 0
            want += [(name, i, first + k) for k, (_, i) in enumerate(own)]
            held[name] = first + len(own), own[-1][0] + quiet_ms
        newest = max(newest, *(r[2] for r in rows))
        start = lambda s: S.turn_counter(s, quiet_ms, parts=3).writeStream.foreachBatch(lambda b, k: out.extend(tuple(r) for r in b.collect()))
        sizes.append(state_rows(feed(spark, tmp_path, SCHEMA, [(x, i, 1000 * at) for x, i, at in rows], start)))
    assert sorted(out, key=str) == sorted(want, key=str)
    if quiet_ms < S.QUIET_MS:
        assert [t for x, _, t in want if x == "s45"] == [0, 1, 2, 3, 4, 0, 1]
    assert 0 < max(sizes) <= 3 * (2 + 1 + 2), sizes  # groups, the time to look them through, its timer with index: no row a session


class Kept(dict):
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.calls = calls

    def __getattr__(self, name):
        ask = {"getValue": lambda k: self.get_(k), "updateValue": self.__setitem__, "removeKey": self.pop, "iterator": lambda: iter(list(self.items())), "get": lambda: self.get_(0), "update": lambda v: self.__setitem__(0, v), "registerTimer": lambda ms: None, "deleteTimer": lambda ms: None}[name]
        return lambda *a: (self.calls.update([name]), ask(*a))[1]

    def get_(self, k):
        return dict.get(self, k)

    def get(self):
        return self.__getattr__("get")()

    def update(self, v):
        return self.__getattr__("update")(v)


class Handle(Kept):
    def getMapState(self, name, *_):
        return Kept(self.calls)

    def getValueState(self, name, *_):
        return Kept(self.calls)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_to_the_state_do_not_grow_with_sessions(monkeypatch):
    calls = Counter()
    turns = S._Turns(S.QUIET_MS)
    turns.init(Handle(calls))
    for batch in range(2):
        n = 20_000
        rows = pd.DataFrame({"session_id": [f"s{i % 5000}" for i in range(n)], "id": range(n), "created_at": [1000 * (batch * n + n - i) for i in range(n)], "in_group": [i % 5000 % 16 for i in range(n)]})
        got = pd.concat(turns.handleInputRows((0,), iter([rows[: n // 2], rows[n // 2 :]]), Mark(0)))
        own = got[got.session_id == "s7"].set_index("id").turn_index.to_dict()
        assert own == {7 + 5000 * k: 4 * batch + 3 - k for k in range(4)} and len(got) == n
    assert sum(calls.values()) <= 2 * 16 * 2 + 10, calls
    list(turns.handleExpiredTimer((0,), Mark(S.QUIET_MS * 2), None))
    assert not turns.groups and calls["removeKey"] == 16
