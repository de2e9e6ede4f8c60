"""Continuous forms of change detection, record events, alerts, metrics and status on streams."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from chronodiff.operators.align import changed_words


class _Latest(StatefulProcessor):
    """Per page: the latest good filtered hash. Emits the outcome of every fetch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", "filtered string, raw string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frame = pd.concat(list(rows)).sort_values("at")
        filtered, raw = self.hash.get() if self.hash.exists() else (None, None)
        out = []
        for r in frame.itertuples(index=False):
            if raw is not None and r.raw_hash == raw:
                outcome = "unchanged_raw"
            elif r.reject is not None and not pd.isna(r.reject):
                outcome = "rejected"
            elif filtered is None or r.filtered_hash != filtered:
                outcome = "first" if filtered is None else "stored"
                filtered, raw = r.filtered_hash, r.raw_hash
            else:
                outcome = "unchanged"
            out.append((key[0], r.at, outcome))
        if filtered is not None:
            self.hash.update((filtered, raw))
        yield pd.DataFrame(out, columns=["page", "at", "outcome"])

    def close(self) -> None:
        pass


class _Streak(StatefulProcessor):
    """Per page: consecutive errors so far. Emits streak and status of every run; the first error is not counted."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "run"]).itertuples(index=False):
            n = n + 1 if r.error else 0
            streak = max(n - 1, 0)
            out.append((r.run, key[0], streak, "error" if streak >= self.threshold else "warning" if streak else "ok"))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["run", "page", "streak", "status"])

    def close(self) -> None:
        pass


class _Gate(StatefulProcessor):
    """Per page: the blocks that the last alert was about, and checks since. Emits the words of each version against them, and the verdict."""

    def __init__(self, min_words: int):
        self.min_words = min_words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "blocks array<string>, checks int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.anchor.get() if self.anchor.exists() else None
        anchor, checks = (list(held[0]), held[1]) if held else (None, 0)
        out = []
        for at, blocks in sorted((pair for frame in rows for pair in zip(frame["at"], frame["blocks"], strict=True)), key=lambda p: p[0]):
            blocks = list(blocks) if blocks is not None else []
            if anchor is None:
                anchor = blocks
                continue
            checks += 1
            words = changed_words(anchor, blocks)
            alert = words >= self.min_words
            out.append((key[0], at, words, alert, checks))
            if alert:
                anchor, checks = blocks, 0
        if anchor is not None:
            self.anchor.update((anchor, checks))
        yield pd.DataFrame(out, columns=["page", "at", "words", "alert", "checks"])

    def close(self) -> None:
        pass


class _Records(StatefulProcessor):
    """Per source: the row text of every id. Emits new, changed and removed of every snapshot after the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "rid string", "row string")
        self.begun = handle.getValueState("begun", "snap long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        snaps: dict[int, dict[str, str]] = {}
        for frame in rows:
            for snap, i, row in zip(frame["snap"].tolist(), frame["rid"].astype(str).tolist(), frame["row"].tolist(), strict=True):
                snaps.setdefault(snap, {})[i] = row
        kept = before = {k[0]: v[0] for k, v in self.rows.iterator()}  # read once a batch, and written once
        begun = self.begun.exists()
        for snap in sorted(snaps):
            now = snaps[snap]
            if begun:
                out += [(key[0], snap, i, "new") for i in now if i not in before]
                out += [(key[0], snap, i, "changed") for i, row in now.items() if i in before and before[i] != row]
                out += [(key[0], snap, i, "removed") for i in before if i not in now]
            before, begun = now, True
        for i in kept.keys() - before.keys():
            self.rows.removeKey((i,))
        for i, row in before.items():
            if i not in kept or kept[i] != row:
                self.rows.updateValue((i,), (row,))
        if snaps:
            self.begun.update((int(max(snaps)),))
        yield pd.DataFrame(out, columns=["source", "snap", "rid", "event"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str | StructType) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "none")


def stream_changes(stream: DataFrame) -> DataFrame:
    """Outcome of every fetch (``page``, ``at``, ``raw_hash``, ``filtered_hash``, ``reject``); state is two hashes a page."""
    return _stateful(stream, "page", _Latest(), f"page {dict(stream.dtypes)['page']}, at {dict(stream.dtypes)['at']}, outcome string")


def stream_gate(stream: DataFrame, min_words: int) -> DataFrame:
    """``words``, ``alert`` and ``checks`` of every version (``page``, ``at``, ``blocks``) against the page's anchor, as the batch gate gives them.

    Versions of a page within a batch are taken in order of ``at``; batches come in their order.
    """
    kinds = dict(stream.dtypes)
    return _stateful(stream, "page", _Gate(min_words), f"page {kinds['page']}, at {kinds['at']}, words int, alert boolean, checks int")


def stream_status(stream: DataFrame, threshold: int = 3) -> DataFrame:
    """Streak and status of every run (``run``, ``page``, ``at``, ``error``); state is one counter a page."""
    kinds = dict(stream.dtypes)
    return _stateful(stream, "page", _Streak(threshold), f"run {kinds['run']}, page {kinds['page']}, streak int, status string")


def stream_record_events(stream: DataFrame) -> DataFrame:
    """Events of snapshots (``source``, ``snap``, ``rid``, ``row``), each snapshot whole within a batch."""
    return _stateful(stream, "source", _Records(), f"source {dict(stream.dtypes)['source']}, snap long, rid string, event string")


def dedupe_alerts(stream: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Each (change, action) once, as long as repeats come within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def stream_metrics(stream: DataFrame, at: str, name: str, value: str, width: str, delay: str) -> DataFrame:
    """``name``, ``start``, ``n``, ``mean``, ``high`` of each window once it is past the delay."""
    g = stream.withWatermark(at, delay).groupBy(name, F.window(at, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return g.select(name, F.col("window.start").alias("start"), "n", "mean", "high")


class _Notices(StatefulProcessor):
    """Per owner: alerts that wait for their notice. A notice's time runs from its first alert; only the first of those that wait has a timer."""

    def __init__(self, width_us: int):
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, page string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for frame in rows:
            new = list(zip(frame["us"].astype("int64").tolist(), frame["page"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(at for at, _ in new)
                self.handle.registerTimer(-(-(first + self.width) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """No alert before the watermark can come any more, so windows that end by it are whole; what is left gets the next timer."""
        end = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, out = sorted((int(at), page) for at, page in self.waiting.get()), []
        done = 0
        while done < len(waiting) and waiting[done][0] + self.width <= end:
            first = waiting[done][0]
            past = bisect.bisect_left(waiting, first + self.width, lo=done, key=lambda w: w[0])
            inside = [page for _, page in waiting[done:past]]
            out.append((key[0], first, len(inside), _notice(inside)))
            done = past
        if done:
            if done < len(waiting):
                self.waiting.put(waiting[done:])
                self.handle.registerTimer(-(-(waiting[done][0] + self.width) // 1000))
            else:
                self.waiting.clear()
        yield pd.DataFrame(out, columns=["owner", "us", "n", "notice"])

    def close(self) -> None:
        pass


def _notice(pages: list[str]) -> str:
    if len(pages) == 1:
        return pages[0]
    more = f" and {len(pages) - 3} more" if len(pages) > 3 else ""
    return f"{len(pages)} pages changed: {', '.join(pages[:3])}{more}"


class _Quiet(StatefulProcessor):
    """Per page: changes that are not yet final, and the latest final one with whether its quiet time was told."""

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")
        self.last = handle.getValueState("last", "at long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for frame in rows:
            times = sorted(set(frame["us"].astype("int64").tolist()))
            if times:
                self.waiting.appendList([(at,) for at in times])
                self.handle.registerTimer(-(-(times[0] + self.quiet) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Changes up to the watermark are final; the next timer is for the latest of them, or else for the first that waits."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(int(r[0]) for r in self.waiting.get())
        last, told = self.last.get() if self.last.exists() else (None, True)
        out = []
        for at in [at for at in waiting if at <= now]:
            if not told and at >= last + self.quiet:
                out.append((key[0], last))
            if last is None or at > last:
                last, told = at, False
        if not told and last + self.quiet <= now:
            out.append((key[0], last))
            told = True
        if last is not None:
            self.last.update((last, told))
        later = [(at,) for at in waiting if at > now]
        if len(later) < len(waiting):
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if not told:
            self.handle.registerTimer(-(-(last + self.quiet) // 1000))
        elif later:
            self.handle.registerTimer(-(-(later[0][0] + self.quiet) // 1000))
        yield pd.DataFrame(out, columns=["page", "us"])

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _us(at: str):  # noqa: ANN202
    """Microseconds, as the rows have them; timers count milliseconds."""
    return F.unix_micros(F.col(at).cast("timestamp")).alias("us")


def coalesce_alerts(stream: DataFrame, owner: str, page: str, at: str, width_ms: int = 30_000, delay: str = "0 seconds") -> DataFrame:
    """``owner``, ``start``, ``n``, ``notice``: one notice for all alerts of an owner within ``width_ms`` of the first.

    A single alert is its page's name; more are counted, with three names in
    order of time. A timer sends the notice once the watermark has passed its
    end, so an alert that is late by less than ``delay`` still finds its place.
    """
    kind = dict(stream.dtypes)[owner]
    rows = stream.withWatermark(at, delay).select(F.col(owner).alias("owner"), F.col(at).alias("at"), _us(at), F.col(page).cast("string").alias("page"))
    out = _timed(rows, "owner", _Notices(1000 * width_ms), f"owner {kind}, us long, n long, notice string")
    return out.select(F.col("owner").alias(owner), F.timestamp_micros("us").alias("start"), "n", "notice")


def stream_stale(stream: DataFrame, page: str, at: str, days: float, delay: str = "0 seconds") -> DataFrame:
    """``page``, ``since``, ``until``: once for each stretch of changes that ``days`` without a change have ended.

    A timer tells as soon as the watermark has passed the end, though the page itself sends nothing more.
    """
    kind, quiet = dict(stream.dtypes)[page], int(days * 86_400_000_000)
    rows = stream.withWatermark(at, delay).select(F.col(page).alias("page"), F.col(at).alias("at"), _us(at))
    out = _timed(rows, "page", _Quiet(quiet), f"page {kind}, us long")
    return out.select(F.col("page").alias(page), F.timestamp_micros("us").alias("since"), F.timestamp_micros(F.col("us") + quiet).alias("until"))


class _HookState(StatefulProcessor):
    """Per page: what a user's hook remembers, by name; values that were not written for ``ttl_ms`` are forgotten."""

    def __init__(self, hook, ttl_ms: int | None):  # noqa: ANN001
        self.hook, self.ttl = hook, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value string", self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        for name, value in zip(initialState["name"], initialState["value"], strict=True):
            self.values.updateValue((name,), (value,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state = {k[0]: v[0] for k, v in self.values.iterator()}
        kept, wrote, out = set(state), set(), []
        for at, outcome in sorted((pair for frame in rows for pair in zip(frame["at"], frame["outcome"], strict=True)), key=lambda p: p[0]):
            before = dict(state)
            told = self.hook(state, at, outcome)
            out.append((key[0], at, outcome, told))
            wrote.update(name for name, value in state.items() if name not in before or before[name] != value)
        for name in kept - state.keys():
            self.values.removeKey((name,))
        for name in wrote & state.keys():  # once a batch, with the last of its values
            self.values.updateValue((name,), (str(state[name]),))
        yield pd.DataFrame(out, columns=["page", "at", "outcome", "told"])

    def close(self) -> None:
        pass


def stream_hook_state(stream: DataFrame, hook, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """``page``, ``at``, ``outcome``, ``told``: a user's hook over checks (``page``, ``at``, ``outcome``), with a memory for each page.

    ``hook(state, at, outcome)`` reads and changes ``state``, a dictionary of
    texts, and returns what it has to tell or None. The memory is a map state
    with time to live, kept by the stream's checkpoint; ``initial`` (``page``,
    ``name``, ``value``) fills it when the stream first starts, for instance
    from ``hooks.latest_state``. With ``ttl_ms`` Spark runs batches without input for ever, so such a query is stopped, or triggered once.
    """
    kinds = dict(stream.dtypes)
    schema = f"page {kinds['page']}, at {kinds['at']}, outcome string, told string"
    start = None if initial is None else initial.select(F.col("page").cast(kinds["page"]).alias("page"), "name", "value").groupBy("page")
    mode = "ProcessingTime" if ttl_ms else "none"
    return stream.select("page", "at", "outcome").groupBy("page").transformWithStateInPandas(_HookState(hook, ttl_ms), schema, "Append", mode, start)
