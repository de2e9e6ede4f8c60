"""Line dedup: passages of three lines or more that occurred before are removed (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import cut


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per three consecutive lines: id, position of the first line, 128-bit key."""
    lines = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.split(F.col(f"`{text_col}`"), "\n", -1).alias("lines")
    )
    at = lines.where(F.size("lines") >= 3).select(
        "id", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 3)).alias("pos")
    )
    three = [F.get("lines", F.col("pos") + k) for k in range(3)]
    blank = F.lit(True)
    for line in three:
        blank = blank & (F.trim(line) == "")
    return at.where(~blank).select(
        "id", "pos", F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(7), *reversed(three)).alias("h2")
    )


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the sorted first positions (``starts``) of windows that occurred earlier.

    Order is by (id, position). The first occurrence comes from an aggregation
    with map-side combining; only windows that occur more than once are joined
    back, in a join that Spark can split where one window is very frequent.
    """
    windows = cut(_windows(docs, id_col, text_col), "windows")
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    again = windows.join(first, ["h1", "h2"]).where(F.struct("id", "pos") > F.col("first"))
    return again.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def _covered(starts: Column) -> Column:
    """Line positions under any of the windows, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + 2)))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with later occurrences of repeated passages cut from the text.

    Overlapping windows of three lines are hashed over all documents; every
    window but the first of its kind marks its three lines, and marked lines
    go. Lines are compared exactly and split at line feeds. A line that goes
    has an equal line that stays, earlier in (id, position) order.

    Defined cases: a null text stays null; a text of fewer than three lines,
    and a row without id, is left alone; windows of three blank lines mark
    nothing; rows that share an id count as one document, each cut alike, and
    their equal windows at equal positions are one occurrence; a very long text
    is one array of lines in its task; an empty table gives an empty table. Columns and their types are those of ``docs``,
    whatever their names.
    """
    marked = later_windows(docs, id_col, text_col)
    spare = _unused(docs.columns)
    marked = marked.select(F.col("id").alias(spare[0]), F.col("starts").alias(spare[1]))
    joined = docs.join(marked, docs[f"`{id_col}`"] == marked[spare[0]], "left")
    kept = _kept_text(F.col(f"`{text_col}`"), F.col(spare[1]))
    return joined.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _kept_text(text: Column, starts: Column) -> Column:
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), _covered(starts))
    return F.when(starts.isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n")
    )


def _unused(columns: list[str]) -> list[str]:
    """Two column names that the table does not have."""
    taken = {c.lower() for c in columns}
    names, n = [], 0
    while len(names) < 2:
        if (name := f"cut_{n}") not in taken:
            names.append(name)
        n += 1
    return names


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lines, lines removed, text that stays (``kept``); cases as in ``dedup_lines``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = later_windows(rows, "id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return rows.join(marked, "id", "left").select(
        F.col("id").alias(id_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(_covered(F.col("starts"))), F.lit(0)).cast("long").alias("n_removed"),
        _kept_text(F.col("text"), F.col("starts")).alias("kept"),
    )
