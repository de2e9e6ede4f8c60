"""Load against capacity, schedule planning, metric roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.operators.prefix import ranged, running_total

#: Share of the limit that is too much, and measured runs that a mean needs.
WARN, MIN_SAMPLES = 0.8, 5


def demand(mode: Column, interval_s: Column, times: Column, days: Column) -> Column:
    """Checks a second: interval and adaptive 1/interval, clock times times*days/week, manual 0."""
    return F.when(mode.isin("interval", "adaptive"), 1.0 / F.greatest(interval_s, F.lit(60))).when(mode == "times", times * days / F.lit(604800.0)).otherwise(0.0)


def capacity(load: DataFrame, runs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``pool``, ``demand``, ``mean_s``, ``capacity``, ``utilisation``, ``warn``.

    ``load`` has pool and demand, ``runs`` pool and seconds. Capacity is pool
    size by mean time, null with fewer than ``MIN_SAMPLES`` runs.
    """
    need = load.groupBy("pool").agg(F.sum("demand").alias("demand"))
    mean = runs.groupBy("pool").agg(F.when(F.count("*") >= MIN_SAMPLES, F.avg("seconds")).alias("mean_s"))
    size = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))])
    out = need.join(mean, "pool", "left").withColumn("capacity", size[F.col("pool")] / F.col("mean_s"))
    return out.withColumn("utilisation", F.col("demand") / F.col("capacity")).withColumn("warn", F.coalesce(F.col("utilisation") > WARN + 1e-6, F.lit(False)))


def host_stretch(load: DataFrame, overrides: DataFrame, limit: float) -> DataFrame:
    """``host``, ``demand``, ``limit``, ``factor``: how much a host's intervals grow so that its limit holds."""
    need = load.groupBy("host").agg(F.sum("demand").alias("demand"))
    out = need.join(overrides.select("host", F.col("limit").alias("own")), "host", "left").withColumn("limit", F.coalesce("own", F.lit(limit)))
    return out.select("host", "demand", "limit", F.greatest(F.lit(1.0), F.col("demand") / F.col("limit")).alias("factor"))


def host_gaps(runs: DataFrame, host: str, start: str, end: str) -> DataFrame:
    """``host``, ``min_gap_s`` between starts, ``peak`` of runs at once (a run that ends as another starts does not overlap).

    A host's runs may lie over many ranges: gaps inside ranges are joined by
    those between the last start of one and the first of the next, and the runs
    at once are a running total.
    """
    rows = ranged(runs.select(F.col(host).alias("h"), F.unix_micros(start).alias("s")), ["s"], ["h"])
    gap = F.col("s") - F.lag("s").over(W.partitionBy("_range", "h").orderBy("s"))
    inside = rows.withColumn("gap", gap).groupBy("h", "_range").agg(F.min("gap").alias("gap"), F.min("s").alias("low"), F.max("s").alias("high"))
    edge = F.col("low") - F.lag("high").over(W.partitionBy("h").orderBy("_range"))
    gaps = inside.withColumn("gap", F.least("gap", edge)).groupBy("h").agg((F.min("gap") / 1e6).alias("min_gap_s"))
    events = runs.select(F.col(host).alias("h"), F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(runs.select(F.col(host).alias("h"), F.col(end).alias("at"), F.lit(-1).alias("d")))
    level = running_total(events, F.col("d"), ["at", "d"], ["h"], "level")
    peaks = level.groupBy(F.col("h").alias("_h")).agg(F.max("level").alias("peak"))
    return gaps.join(peaks, F.col("h").eqNullSafe(F.col("_h"))).select(F.col("h").alias(host), "min_gap_s", "peak")


def metric_rollup(df: DataFrame, at: str, name: str, value: str, width: str) -> DataFrame:
    """``name``, ``start``, ``n``, ``mean``, ``high``, ``growth`` (last against first, percent) of each window."""
    g = df.groupBy(name, F.window(at, width)["start"].alias("start")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"), F.min_by(value, at).alias("v0"), F.max_by(value, at).alias("v1"))
    return g.withColumn("growth", F.when(F.col("v0") != 0, (F.col("v1") - F.col("v0")) / F.col("v0") * 100)).drop("v0", "v1")


def host_capacity(load: DataFrame, overrides: DataFrame, limit: float, top: int = 50) -> DataFrame:
    """``host``, ``pages``, ``demand``, ``limit``, ``utilisation``, ``factor``, ``over_limit`` of the ``top`` hosts by utilisation, then demand, then name, backwards."""
    need = load.groupBy("host").agg(F.count("*").alias("pages"), F.sum("demand").alias("demand"))
    out = need.join(overrides.select("host", F.col("limit").alias("own")), "host", "left").withColumn("limit", F.coalesce("own", F.lit(limit)))
    out = out.withColumn("utilisation", F.col("demand") / F.col("limit"))
    out = out.select("host", "pages", "demand", "limit", "utilisation", F.greatest(F.lit(1.0), "utilisation").alias("factor"), (F.col("utilisation") > 1 + 1e-6).alias("over_limit"))
    return out.orderBy(F.desc("utilisation"), F.desc("demand"), F.desc("host")).limit(top)


def jitter(key: Column, spread: Column) -> Column:
    """A number of seconds below ``spread`` that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.greatest(spread, F.lit(1))).cast("int")


def next_interval_due(last: Column, interval_s: Column, factor: Column, extra_s: Column | int = 0) -> Column:
    """Last check plus the stretched interval, rounded up to whole seconds, plus jitter."""
    seconds = F.ceil(F.greatest(interval_s, F.lit(60)) * factor) + extra_s
    return last + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def next_clock_time(now: Column, times: Column, days: Column, zone: str = "UTC") -> Column:
    """The first of the clock ``times`` (minutes of the day) on one of ``days`` (0 is Monday) after ``now``, within nine days.

    Clock times are local to ``zone``; a time that a clock change skips moves forward.
    """
    local = F.from_utc_timestamp(now, zone)
    day = F.sequence(F.lit(0), F.lit(8))
    at = F.flatten(F.transform(day, lambda d: F.transform(times, lambda t: F.struct(F.date_add(F.to_date(local), d).alias("d"), t.alias("t")))))
    fits = F.filter(at, lambda x: _allowed(days, x["d"]))
    utc = F.transform(fits, lambda x: F.to_utc_timestamp(x["d"].cast("timestamp") + F.make_dt_interval(mins=x["t"]), zone))
    return F.array_min(F.filter(utc, lambda x: x > now))


def _allowed(days: Column | None, day: Column) -> Column:
    """Whether a date is on one of ``days`` (0 is Monday); no or empty ``days`` allow all."""
    if days is None:
        return F.lit(True)
    return F.coalesce(F.size(days) <= 0, F.lit(True)) | F.array_contains(days, F.weekday(day))


def apply_limits(at: Column, start_min: Column, end_min: Column, days: Column | None = None, zone: str = "UTC") -> Column:
    """``at``, or the next allowed start if its local day or time of day is not allowed.

    Both ends of a window (minutes of the day) belong to it; one that ends
    before it starts wraps midnight; without a window (nulls) days open at
    midnight. ``days`` are as in ``next_clock_time``; none or empty allow all.
    """
    local = F.from_utc_timestamp(at, zone)
    today = F.to_date(local)
    clock = (F.hour(local) * 60 + F.minute(local)) * 60 + F.extract(F.lit("SECOND"), local)
    start, end = start_min * 60, end_min * 60
    within = F.when(start <= end, (clock >= start) & (clock <= end)).when(start > end, (clock >= start) | (clock <= end)).otherwise(True)
    opens_today = F.coalesce(clock < start, F.lit(False))
    later = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda d: ((d > 0) | opens_today) & _allowed(days, F.date_add(today, d)))
    opens = F.date_add(today, F.get(later, F.lit(0))).cast("timestamp") + F.make_dt_interval(mins=F.coalesce(start_min, F.lit(0)))
    return F.when(within & _allowed(days, today), at).otherwise(F.coalesce(F.to_utc_timestamp(opens, zone), at))


def adaptive_next(current: Column, changed: Column, low: int, high: int, factor: float) -> Column:
    """The interval after one more check: a change or no interval yet gives ``low``, no change multiplies (truncated) up to ``high``, an error (null) holds."""
    grown = F.least(F.lit(high), F.greatest(F.lit(low), (current * factor).cast("int")))
    return F.when(current.isNull() | F.coalesce(changed, F.lit(False)), low).when(~changed, grown).otherwise(current)


def next_due(
    mode: Column, now: Column, interval_s: Column, current_s: Column, times: Column, start_min: Column, end_min: Column,
    days: Column | None = None, factor: Column | float = 1.0, extra_s: Column | int = 0, zone: str = "UTC",
) -> Column:
    """The next check by ``mode``: manual none, ``times`` the next clock time, interval and adaptive the (stretched) wait; within limits of days and window.

    Adaptive pages wait ``current_s``, which ``adaptive_next`` gives; clock times are not stretched.
    """
    stretch = F.lit(factor) if isinstance(factor, float) else factor
    wait = next_interval_due(now, F.when(mode == "adaptive", current_s).otherwise(interval_s), stretch, extra_s)
    clock = next_clock_time(now, times, F.array().cast("array<int>") if days is None else days, zone)
    return apply_limits(F.when(mode == "times", clock).when(mode.isin("interval", "adaptive"), wait), start_min, end_min, days, zone)


def adaptive_intervals(runs: DataFrame, page: str, at: str, outcome: str, low: int, high: int, factor: float) -> DataFrame:
    """``page``, ``interval_s`` after all its runs: unchanged multiplies (truncated) up to ``high``, a change resets to ``low``, an error holds.

    Only the unchanged runs after the last change count, so a page is a
    number of steps and not a fold over its history.
    """
    change, same = F.col(outcome) == "changed", F.col(outcome) == "unchanged"
    last = runs.groupBy(page).agg(F.max(F.when(change, F.col(at))).alias("reset"))
    steps = runs.join(last, page).where(F.col("reset").isNull() | (F.col(at) > F.col("reset"))).groupBy(page).agg(F.count_if(same).alias("steps"))
    ladder, value = [], low
    while value < high and len(ladder) < 1000 and int(value * factor) > value:
        ladder.append(value)
        value = min(int(value * factor), high)
    ladder.append(value)
    table = F.array(*[F.lit(v) for v in ladder])
    counts = runs.select(page).distinct().join(steps, page, "left")
    return counts.select(page, F.get(table, F.least(F.coalesce("steps", F.lit(0)), F.lit(len(ladder) - 1)).cast("int")).alias("interval_s"))


def due_now(pages: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """The pages whose check is due, in the order of dispatch: priority, then longest overdue, then page."""
    return pages.where(F.col("due") <= F.lit(now)).orderBy(F.desc("priority"), "due", "page")


def catch_up_plan(pages: DataFrame, now, spread_s: float, allowed: str | None = None) -> DataFrame:  # noqa: ANN001
    """``page``, ``place``, ``start_at``: overdue pages by priority, then longest overdue, then page, spread evenly.

    Places are a running count over the one order of all pages. The spread is
    ``spread_s`` or one second a page, the smaller.
    ``allowed`` names a column with the first start that a page's limits allow
    (``apply_limits`` of now); where that is later, it is the page's start, without a place.
    """
    due = pages.where(F.col("due") <= F.lit(now))
    if allowed:
        waits = F.coalesce(F.col(allowed) > F.lit(now), F.lit(False))
        plan = catch_up_plan(due.where(~waits).select("page", "priority", "due"), now, spread_s)
        return plan.unionByName(due.where(waits).select("page", F.lit(None).cast("long").alias("place"), F.col(allowed).cast(plan.schema["start_at"].dataType).alias("start_at")))
    out = running_total(due.withColumn("_urgent", -F.col("priority")), F.lit(1), ["_urgent", "due", "page"], name="n")
    place = (F.col("n") - 1).cast("long")
    step = F.least(F.lit(float(spread_s)), F.col("n_all").cast("double")) / F.col("n_all")
    return out.select("page", place.alias("place"), (F.lit(now) + F.make_dt_interval(secs=(place * step).cast("decimal(18,6)"))).alias("start_at"))
