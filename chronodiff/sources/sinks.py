"""Changes written batch by batch so that a batch that comes again leaves the same files, and changes as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(rows: DataFrame, path: str, batch: int, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """The rows of one batch in a folder of its own below ``path``, in place of what an earlier try left there.

    With ``partition_by``, in folders by these columns. Readers see ``batch`` as a column.
    """
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """All batches that ``write_batch`` wrote; filters on ``batch`` and on partition columns skip folders."""
    reader = spark.read.format(fmt).option("basePath", path)
    return (reader.schema(schema) if schema else reader).load(path)


def sink(path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet"):  # noqa: ANN201
    """A hook for ``deliver`` that writes each batch once (see ``write_batch``)."""
    return lambda rows, number: write_batch(rows, path, number, partition_by, fmt)


def diff_json(ops: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``diff``: the operations of ``align.align_blocks`` as one JSON text a pair, with their sums.

    ``{"ops": [{"t", "old", "new", "tokens"}], "stats": {...}, "degraded"}``; ranges are inclusive, and a side without blocks is left out.
    """
    side = lambda lo, hi: F.when(F.col(lo) >= 0, F.array(lo, hi))
    tokens = F.when(F.size("tokens") > 0, F.transform("tokens", lambda x: F.array(x["k"], x["text"])))
    op = F.struct("op", F.struct("t", side("old_lo", "old_hi").alias("old"), side("new_lo", "new_hi").alias("new"), tokens.alias("tokens")).alias("o"))
    blocks = F.when(F.col("t").isin("eq", "mov"), 0).otherwise(F.greatest(F.size("old_texts"), F.size("new_texts")))
    sums = F.struct(
        F.sum("added_words").alias("added_words"), F.sum("removed_words").alias("removed_words"),
        F.sum(F.greatest("added_words", "removed_words")).alias("changed_words"), F.sum(blocks).alias("changed_blocks"),
    )
    out = ops.groupBy(*keys).agg(F.array_sort(F.collect_list(op)).getField("o").alias("ops"), sums.alias("stats"), F.max("degraded").alias("degraded"))
    return out.select(*keys, F.to_json(F.struct("ops", "stats", "degraded")).alias("diff"))
