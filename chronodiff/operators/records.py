"""Keyed records: row texts, events between snapshots, histories, loose comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scalar_text(col: Column, kind: str) -> Column:
    """A value as the comparison text has it: null empty, booleans in lower case, whole doubles without point."""
    if kind in ("double", "float"):
        text = F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string"))
    elif kind == "boolean":
        text = F.lower(col.cast("string"))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def row_text(df: DataFrame, id_field: str, fields: list[str], ignore_case: bool = True, order: str | None = None) -> DataFrame:
    """``rid`` and ``row`` (id first, then the fields in order, joined by tabs).

    Of rows that share an id the first by ``order`` wins; without an order
    column, which a table needs to have a first row, the smallest text.
    """
    kinds = dict(df.dtypes)
    text = F.concat_ws("\t", *[scalar_text(F.col(c), kinds[c]) for c in [id_field, *fields]])
    row = F.lower(text) if ignore_case else text
    rows = df.select(F.col(id_field).alias("rid"), row.alias("row"), (F.col(order) if order else row).alias("nth"))
    return rows.groupBy("rid").agg(F.min(F.struct("nth", "row"))["row"].alias("row"))


def record_events(old: DataFrame, new: DataFrame, id_field: str, fields: list[str], order: str | None = None) -> DataFrame:
    """``rid`` and ``event``: new, changed or removed; rows that are equal in the fields give none."""
    a = row_text(old, id_field, fields, order=order).withColumnRenamed("row", "old_row")
    b = row_text(new, id_field, fields, order=order).withColumnRenamed("row", "new_row")
    both = a.join(b, "rid", "full_outer")
    event = F.when(F.col("old_row").isNull(), "new").when(F.col("new_row").isNull(), "removed").when(F.col("old_row") != F.col("new_row"), "changed")
    return both.select("rid", event.alias("event")).where("event is not null")


def record_history(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snap``, ``rid``, ``event`` over a sequence of snapshots.

    ``rows`` has ``snap`` (0, 1, …), ``rid``, ``row``; ``snapshots`` has every
    ``snap`` there is. The first snapshot gives no events.
    """
    order = W.partitionBy("rid").orderBy("snap")
    seen = rows.withColumn("prev_row", F.lag("row").over(order)).withColumn("prev", F.lag("snap").over(order))
    came = seen.where("snap > 0").select("snap", "rid", F.when(F.col("prev").isNull() | (F.col("prev") < F.col("snap") - 1), "new").when(F.col("prev_row") != F.col("row"), "changed").alias("event"))
    went = rows.select((F.col("snap") + 1).alias("snap"), "rid").join(rows.select("snap", "rid"), ["snap", "rid"], "left_anti")
    went = went.join(F.broadcast(snapshots), "snap", "left_semi").select("snap", "rid", F.lit("removed").alias("event"))  # one row a snapshot
    return came.where("event is not null").unionByName(went)


def describe_events(events: DataFrame, keys: list[str], shown: int = 3) -> DataFrame:
    """``keys`` and one sentence: up to three ids of each kind, then how many more."""
    kinds = events.groupBy(*keys, "event").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("rid").cast("string"))).alias("ids"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (+"), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    text = F.concat(F.col("event"), F.lit(": "), F.array_join(F.slice("ids", 1, shown), ", "), more)
    return kinds.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("description"))


def loose_number(col: Column) -> Column:
    """A text as number if it is one, thousands commas aside."""
    return F.replace(F.trim(col.cast("string")), F.lit(","), F.lit("")).try_cast("double")


def loose_cmp(col: Column, op: str, value: str | float | None) -> Column:
    """Numeric if both sides are, else by case-folded text; null is never equal to anything but under ``!=``."""
    text, number = F.lower(F.trim(col.cast("string"))), loose_number(col)
    wanted = F.lit(None if value is None else str(value))
    other, other_number = F.lower(F.trim(wanted)), loose_number(wanted)
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    result = F.when(number.isNotNull() & other_number.isNotNull(), ops[op](number, other_number)).otherwise(ops[op](text, other))
    return F.coalesce(result, F.lit(op == "!="))


def in_list(col: Column, items: list) -> Column:
    """Loosely equal to one of the items."""
    out = F.lit(False)
    for item in items:
        out = out | loose_cmp(col, "=", item)
    return out
