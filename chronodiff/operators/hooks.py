"""Functions of a user's own at the steps of a check: before it, on its pages and blocks, on its verdict, after it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodiff.session import shared_folder

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Hooks:
    """Each step's functions, applied in their order; all are optional.

    ``skip``: conditions of pages that are not checked. ``merge`` and
    ``preprocess``: DataFrame to DataFrame, on the fetched pages and on the
    blocks. ``compare``: columns of ``true`` (a change), ``false`` (none) or
    null (defer) on changes. ``keywords``: columns of hits (arrays of text) on
    changes. ``on_change`` and ``after_check``: (rows, batch number) to nothing.
    """

    skip: tuple[Column, ...] = ()
    merge: tuple[Transform, ...] = ()
    preprocess: tuple[Transform, ...] = ()
    compare: tuple[tuple[str, Column], ...] = ()
    keywords: tuple[Column, ...] = ()
    on_change: tuple[Callable[[DataFrame, int], None], ...] = ()
    after_check: tuple[Callable[[DataFrame, int], None], ...] = ()


def checked(pages: DataFrame, hooks: Hooks) -> DataFrame:
    """The pages that no ``skip`` condition holds for; a condition that is null does not hold."""
    for condition in hooks.skip:
        pages = pages.where(~F.coalesce(condition, F.lit(False)))
    return pages


def merged(pages: DataFrame, hooks: Hooks) -> DataFrame:
    for step in hooks.merge:
        pages = pages.transform(step)
    return pages


def preprocessed(blocks: DataFrame, hooks: Hooks) -> DataFrame:
    for step in hooks.preprocess:
        blocks = blocks.transform(step)
    return blocks


def with_keyword_hits(changes: DataFrame, hooks: Hooks, hits: str = "hits") -> DataFrame:
    """``hits`` (array of text) with what the keyword hooks find besides, each once."""
    found = [F.coalesce(c, F.array().cast("array<string>")) for c in (F.col(hits), *hooks.keywords)]
    return changes.withColumn(hits, F.array_distinct(F.flatten(F.array(*found))))


def with_verdict(changes: DataFrame, hooks: Hooks, reason: str = "reason") -> DataFrame:
    """``forced`` and ``reason`` after the verdict hooks: the first that does not defer decides.

    A forced change has no reason against it; a forced no-change has the hook's
    name as reason; where all defer the gate's own reason stands.
    """
    verdicts = [F.when(c.isNotNull(), F.struct(c.alias("alert"), F.lit(name).alias("name"))) for name, c in hooks.compare]
    if not verdicts:
        return changes.withColumn("forced", F.lit(None).cast("boolean"))
    out = changes.withColumn("_verdict", F.coalesce(*verdicts))
    kept = F.when(F.col("_verdict").isNull(), F.col(reason)).when(~F.col("_verdict.alert"), F.col("_verdict.name"))
    return out.withColumn("forced", F.col("_verdict.alert")).withColumn(reason, kept).drop("_verdict")


def deliver(verdicts: DataFrame, hooks: Hooks, name: str, reason: str = "reason", checkpoint: str | None = None):  # noqa: ANN201
    """Hand alerts to ``on_change`` and all rows to ``after_check``.

    A stream is delivered batch by batch and its query returned; a batch whose
    delivery was cut short comes again with the same number, by which a hook can
    tell (``sinks.write_batch`` then leaves the same files). Deliveries of different ``name`` keep
    checkpoints of their own. A table is one batch, number 0.
    """

    def each(rows: DataFrame, number: int) -> None:
        for hook in hooks.on_change:
            hook(rows.where(F.col(reason).isNull()), number)
        for hook in hooks.after_check:
            hook(rows, number)

    if not verdicts.isStreaming:
        return each(verdicts, 0)
    place = checkpoint or f"{shared_folder(verdicts.sparkSession)}/deliver-{name}"
    return verdicts.writeStream.queryName(f"deliver {name}").foreachBatch(each).option("checkpointLocation", place).trigger(availableNow=True).start()


def latest_state(entries: DataFrame, keys: list[str], at: str) -> DataFrame:
    """State that hooks keep for a page: of appended entries (``keys``, ``name``, ``value``, ``at``) the newest of each name; null values are forgotten."""
    return entries.groupBy(*keys, "name").agg(F.max_by("value", at).alias("value")).where("value is not null")
