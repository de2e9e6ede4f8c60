"""How often streams touch their state: once a key and batch, not once a row."""

import pandas as pd

from chronodiff.streaming import stream as S

HOUR = 3_600_000_000


class Handle:
    """State that lies in memory and counts what is done to it."""

    def __init__(self):
        self.timers, self.reads, self.writes = [], 0, 0

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)

    def getListState(self, *_):  # noqa: N802
        return State(self)

    getMapState = getValueState = getListState  # noqa: N815


class State:
    def __init__(self, handle):
        self.handle, self.list, self.map, self.value = handle, [], {}, None

    def appendList(self, rows):  # noqa: N802
        self.list += rows

    def put(self, rows):
        self.list = list(rows)

    def clear(self):
        self.list = []

    def exists(self):
        return self.value is not None

    def get(self):
        self.handle.reads += 1
        return self.value if self.value is not None else iter(self.list)

    def update(self, value):
        self.handle.writes += 1
        self.value = value

    def iterator(self):
        self.handle.reads += 1
        return iter(list(self.map.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.handle.writes += 1
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        self.handle.writes += 1
        del self.map[key]


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def test_waiting_alerts_have_one_timer():
    p, handle = started(S._Notices(HOUR))
    list(p.handleInputRows(("me",), iter([pd.DataFrame({"us": [k * HOUR // 2 for k in range(100)], "page": ["x"] * 100})]), None))
    assert handle.timers == [3_600_000]
    out = pd.concat(p.handleExpiredTimer(("me",), Now(30 * 3_600_000), Now(3_600_000)))
    assert out["n"].tolist() == [2] * 30 and handle.reads == 1  # all windows that the watermark has passed, at one reading
    assert handle.timers[1:] == [31 * 3_600_000]


def test_a_quiet_page_has_one_timer():
    p, handle = started(S._Quiet(HOUR))
    times = [k * HOUR // 2 for k in range(100)] + [90 * HOUR]
    list(p.handleInputRows(("p",), iter([pd.DataFrame({"us": times})]), None))
    assert handle.timers == [3_600_000]
    out = pd.concat(p.handleExpiredTimer(("p",), Now(20 * 3_600_000), Now(3_600_000)))
    assert out.empty and handle.timers[1:] == [21 * 3_600_000]  # the last final change was at 20
    out = pd.concat(p.handleExpiredTimer(("p",), Now(60 * 3_600_000), Now(21 * 3_600_000)))
    assert out["us"].tolist() == [99 * HOUR // 2] and handle.timers[2:] == [91 * 3_600_000]
    out = pd.concat(p.handleExpiredTimer(("p",), Now(91 * 3_600_000), Now(91 * 3_600_000)))
    assert out["us"].tolist() == [90 * HOUR] and len(handle.timers) == 3


def test_snapshots_read_and_write_their_state_once_a_batch():
    p, handle = started(S._Records())
    p.rows, p.begun = State(handle), State(handle)
    rows = [(snap, rid, str(snap)) for snap in range(50) for rid in "ab"] + [(50, "b", "49"), (50, "c", "x")]
    out = pd.concat(p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["snap", "rid", "row"])]), None))
    assert out["event"].value_counts().to_dict() == {"changed": 98, "new": 1, "removed": 1}
    assert handle.reads == 1 and handle.writes == 3 and p.rows.map == {("b",): ("49",), ("c",): ("x",)} and p.begun.value == (50,)
    out = pd.concat(p.handleInputRows((7,), iter([pd.DataFrame([(51, "b", "49")], columns=["snap", "rid", "row"])]), None))
    assert out.values.tolist() == [[7, 51, "c", "removed"]] and p.rows.map == {("b",): ("49",)}


def test_a_hook_writes_its_memory_once_a_batch():
    def hook(state, at, outcome):
        state["n"] = int(state.get("n", "0")) + 1
        if at == 3:
            state["gone"] = "x"
        if at == 90:
            del state["gone"], state["old"]
        return str(state["n"])

    p, handle = started(S._HookState(hook, None))
    p.values = State(handle)
    p.values.map[("old",)] = ("1",)
    out = pd.concat(p.handleInputRows(("p",), iter([pd.DataFrame({"at": range(100), "outcome": "x"})]), None))
    assert out["told"].tolist() == [str(k + 1) for k in range(100)]
    assert p.values.map == {("n",): ("100",)} and (handle.reads, handle.writes) == (1, 2)
