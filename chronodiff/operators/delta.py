"""Change detection between versions: hashes, classification, block and word deltas, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.text import WORD, count_words, normalize_text


def line_blocks(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys``, ``pos``, ``text``: one block for each line that is not empty, positions from 0."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), normalize_text), lambda x: x != "")
    return df.select(*keys, F.posexplode(lines).alias("pos", "text"))


def joined_blocks(text: Column) -> Column:
    """The comparison text of a version whose blocks are its lines, without a shuffle."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalize_text), lambda x: x != "")
    return F.array_join(lines, "\n")


def version_hashes(df: DataFrame, text_col: str, ignore_case: bool = True) -> DataFrame:
    """``raw_hash`` of the text as it came and ``filtered_hash`` of its joined blocks."""
    text = joined_blocks(F.col(text_col))
    return df.withColumn("raw_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).withColumn(
        "filtered_hash", F.sha2(F.lower(text) if ignore_case else text, 256)
    )


def bad_fetch(text: Column, min_chars: int = 0, blacklist: tuple[str, ...] = (), whitelist: tuple[str, ...] = ()) -> Column:
    """Why a fetch is no version: ``too_short``, ``blacklist`` or ``whitelist_miss``; null if it is one. First reason wins.

    One phrase of the blacklist is enough, and one of the whitelist; blank
    phrases do not count. Characters are summed over blocks without separators.
    """
    page = F.lower(joined_blocks(text))

    def holds(phrases: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: page.contains(p))

    bad, good = (tuple(p for p in phrases if p.strip()) for phrases in (blacklist, whitelist))
    reason = F.when(F.char_length(F.regexp_replace(page, "\n", "")) < min_chars, F.lit("too_short"))
    if bad:
        reason = reason.when(holds(bad), F.lit("blacklist"))
    if good:
        reason = reason.when(~holds(good), F.lit("whitelist_miss"))
    return reason


def classify_fetches(df: DataFrame, page: str, at: str) -> DataFrame:
    """``outcome`` of each fetch: first, unchanged_raw, unchanged, rejected, stored; and ``latest_at``.

    Needs ``raw_hash``, ``filtered_hash`` and ``reject`` (reason or null). The
    latest good version is the last fetch before, not rejected, with another
    filtered hash than the good one before it; an unchanged fetch stores nothing,
    so raw hashes are compared with the first of the run of equal filtered
    hashes. One window by page and time.
    """
    order = W.partitionBy(page).orderBy(at)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    good = F.when(F.col("reject").isNull(), F.col("filtered_hash"))
    out = df.withColumn("last_hash", F.last(good, ignorenulls=True).over(before))
    changed = F.col("reject").isNull() & (F.col("last_hash").isNull() | (F.col("last_hash") != F.col("filtered_hash")))
    out = out.withColumn("is_version", changed)
    out = out.withColumn("latest_at", F.last(F.when(F.col("is_version"), F.col(at)), ignorenulls=True).over(before))
    out = out.withColumn("latest_raw", F.last(F.when(F.col("is_version"), F.col("raw_hash")), ignorenulls=True).over(before))
    outcome = (
        F.when(F.col("latest_raw") == F.col("raw_hash"), "unchanged_raw")
        .when(F.col("reject").isNotNull(), "rejected")
        .when(F.col("last_hash").isNull(), "first")
        .when(F.col("is_version"), "stored")
        .otherwise("unchanged")
    )
    return out.withColumn("outcome", outcome).drop("last_hash", "latest_raw", "is_version")


def block_delta(old: DataFrame, new: DataFrame, keys: list[str], pos: str | None = None) -> DataFrame:
    """Blocks that came or went between two sides (``keys``, ``text``), as multisets: moves are no change.

    ``keys``, ``text``, ``n_ins``, ``n_del``; one aggregation over the union of
    both sides. With ``pos``, also the first position that the text has in the new side, else in the old.
    """
    more = [F.col(pos).alias("pos")] if pos else []
    both = new.select(*keys, "text", *more, F.lit(1).alias("d")).unionByName(old.select(*keys, "text", *more, F.lit(-1).alias("d")))
    first = [F.coalesce(F.min(F.when(F.col("d") > 0, F.col("pos"))), F.min("pos")).alias("pos")] if pos else []
    net = both.groupBy(*keys, "text").agg(F.sum("d").alias("net"), *first).where("net <> 0")
    return net.select(*keys, "text", *(["pos"] if pos else []), F.greatest("net", F.lit(0)).alias("n_ins"), F.greatest(-F.col("net"), F.lit(0)).alias("n_del"))


def delta_stats(delta: DataFrame, keys: list[str]) -> DataFrame:
    """Words and blocks that came and went, per pair."""
    words = count_words(F.col("text"))
    return delta.groupBy(*keys).agg(
        F.sum(words * F.col("n_ins")).cast("long").alias("added_words"), F.sum(words * F.col("n_del")).cast("long").alias("removed_words"),
        F.sum("n_ins").cast("long").alias("inserted_blocks"), F.sum("n_del").cast("long").alias("deleted_blocks"),
    )


def word_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Words that came and went as bags: ``keys``, ``came``, ``went``; the coarse path for huge pages."""

    def words(df: DataFrame, sign: int) -> DataFrame:
        found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))
        return df.select(*keys, found.alias("word")).withColumn("d", F.lit(sign))

    net = words(new, 1).unionByName(words(old, -1)).groupBy(*keys, "word").agg(F.sum("d").alias("net"))
    return net.groupBy(*keys).agg(
        F.sum(F.greatest("net", F.lit(0))).cast("long").alias("came"), F.sum(F.greatest(-F.col("net"), F.lit(0))).cast("long").alias("went")
    )


def gate_changes(stats: DataFrame, min_words: int = 0, ignore_removed: bool = False, keywords: bool = False) -> DataFrame:
    """``reason`` why a change raises no alert, null where it does.

    In order: reorder_only (no block came or went), removed_only, keyword_miss
    (``keywords`` and no ``hits``), below_threshold; a keyword hit passes the
    threshold. The threshold is on ``changed_words``, the words of each change
    (of a replaced run the larger side; see ``align.diff_stats``); with
    ``ignore_removed`` only additions count.
    """
    size = F.col("added_words") if ignore_removed else F.col("changed_words")
    reason = F.when((F.col("inserted_blocks") == 0) & (F.col("deleted_blocks") == 0), "reorder_only")
    if ignore_removed:
        reason = reason.when(F.col("inserted_blocks") == 0, "removed_only")
    if keywords:
        reason = reason.when(F.size("hits") == 0, "keyword_miss")  # a hit passes the threshold
    else:
        reason = reason.when(size < min_words, "below_threshold")
    return stats.withColumn("reason", reason)


def cell_delta(pairs: DataFrame, sep: str = r" \| ") -> DataFrame:
    """Which cells of two rows (``old_text``, ``new_text``) differ, and whether only numbers do."""
    old, new = F.split("old_text", sep), F.split("new_text", sep)
    cells = F.filter(F.sequence(F.lit(0), F.greatest(F.size(old), F.size(new)) - 1), lambda i: ~F.get(old, i).eqNullSafe(F.get(new, i)))
    strip = lambda c: F.regexp_replace(c, "[0-9.,]+", "#")
    return pairs.withColumn("cells", cells).withColumn("numeric", strip(F.col("old_text")) == strip(F.col("new_text")))


def summary(text: Column, limit: int = 200) -> Column:
    """The start of the added text on one line."""
    return F.substring(normalize_text(text), 1, limit)
