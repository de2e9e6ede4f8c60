"""Queries on version histories: conversations are pages, turns are versions, lines are blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.text import count_words
from chronodiff.operators import align, delta
from chronodiff.plans.registry import query
from chronodiff.plans.sql import TURN_BLOCKS, TURN_DELTA, TURN_VERSIONS, words
from chronodiff.session import table


def turn_versions(spark: SparkSession, sf_dir: str, min_chars: int = 40) -> DataFrame:
    """Turns with hashes, rejection and outcome."""
    df = delta.version_hashes(table(spark, sf_dir, "conversations"), "text")
    df = df.withColumn("reject", delta.bad_fetch(F.col("text"), min_chars))
    return delta.classify_fetches(df, "conv_id", "turn")


def turn_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the old and the new side of every changed turn, keyed by conv_id and turn."""
    blocks = delta.line_blocks(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    pairs = turn_versions(spark, sf_dir).where("outcome = 'stored'").select("conv_id", "turn", "latest_at")
    new = pairs.join(blocks, ["conv_id", "turn"])
    old = pairs.join(blocks.withColumnRenamed("turn", "latest_at"), ["conv_id", "latest_at"])
    return old, new


def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id``, ``turn``, ``latest_at``, ``old_blocks``, ``new_blocks`` of every changed turn.

    The blocks of the latest version ride through the window that finds it, so the table is read and shuffled once.
    """
    rows = turn_versions(spark, sf_dir).withColumn("new_blocks", F.split(delta.joined_blocks(F.col("text")), "\n", -1))
    rows = rows.withColumn("new_blocks", F.filter("new_blocks", lambda x: x != ""))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    version = F.when(F.col("outcome").isin("first", "stored"), F.col("new_blocks"))
    rows = rows.withColumn("old_blocks", F.last(version, ignorenulls=True).over(before))
    return rows.where("outcome = 'stored'").select("conv_id", "turn", "latest_at", "old_blocks", "new_blocks")


@query("flagship_changes")
def flagship_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages changed at which version, how many words came, went and changed along the alignment, did it pass the gate."""
    keys = ["conv_id", "turn", "latest_at"]
    stats = align.diff_stats(align.align_blocks(stored_pairs(spark, sf_dir), keys), keys)
    return delta.gate_changes(stats, min_words=30).drop("changed_blocks", "degraded")


@query("a6_line_blocks", f"WITH {TURN_BLOCKS} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, text FROM blocks")
def a6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.line_blocks(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query("b13_version_hashes", f"WITH {TURN_VERSIONS} SELECT conv_id, turn, raw_hash, filtered_hash FROM versions")
def b13_version_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.version_hashes(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "raw_hash", "filtered_hash")


@query("c1_classify_fetches", f"WITH {TURN_VERSIONS} SELECT conv_id, turn, outcome, latest_at FROM classified")
def c1_classify_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_versions(spark, sf_dir).select("conv_id", "turn", "outcome", "latest_at")


@query("c2_block_delta", f"WITH {TURN_DELTA} SELECT conv_id, turn, text, CAST(n_ins AS BIGINT) AS n_ins, CAST(n_del AS BIGINT) AS n_del FROM delta")
def c2_block_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.block_delta(*turn_pairs(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "text", F.col("n_ins").cast("long"), F.col("n_del").cast("long"))


@query(
    "c5_diff_stats",
    f"""WITH {TURN_DELTA} SELECT conv_id, turn, CAST(sum({words("text")} * n_ins) AS BIGINT) AS added_words, CAST(sum({words("text")} * n_del) AS BIGINT) AS removed_words,
CAST(sum(n_ins) AS BIGINT) AS inserted_blocks, CAST(sum(n_del) AS BIGINT) AS deleted_blocks FROM delta GROUP BY ALL""",
)
def c5_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.delta_stats(delta.block_delta(*turn_pairs(spark, sf_dir), ["conv_id", "turn"]), ["conv_id", "turn"])


@query(
    "c6_word_delta",
    rf"""WITH {TURN_DELTA},
ws AS (SELECT conv_id, turn, d, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM sides),
net AS (SELECT conv_id, turn, word, sum(d) AS net FROM ws GROUP BY ALL)
SELECT conv_id, turn, CAST(sum(greatest(net, 0)) AS BIGINT) AS came, CAST(sum(greatest(-net, 0)) AS BIGINT) AS went FROM net GROUP BY ALL""",
)
def c6_word_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.word_delta(*turn_pairs(spark, sf_dir), ["conv_id", "turn"])


@query(
    "c11_baseline_to_latest",
    f"""WITH {TURN_VERSIONS},
ends AS (SELECT conv_id, min(turn) AS base, max(turn) AS tip FROM classified WHERE outcome IN ('first', 'stored') GROUP BY conv_id),
sides AS (
  SELECT e.conv_id, b.text, 1 AS d FROM ends e JOIN blocks b ON b.conv_id = e.conv_id AND b.turn = e.tip
  UNION ALL SELECT e.conv_id, b.text, -1 FROM ends e JOIN blocks b ON b.conv_id = e.conv_id AND b.turn = e.base)
SELECT conv_id, text, CAST(sum(d) AS BIGINT) AS net FROM sides GROUP BY ALL HAVING sum(d) <> 0""",
)
def c11_baseline_to_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stored version of each page against its last."""
    ends = turn_versions(spark, sf_dir).where("outcome in ('first', 'stored')").groupBy("conv_id").agg(F.min("turn").alias("base"), F.max("turn").alias("tip"))
    blocks = delta.line_blocks(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    new = ends.join(blocks.withColumnRenamed("turn", "tip"), ["conv_id", "tip"])
    old = ends.join(blocks.withColumnRenamed("turn", "base"), ["conv_id", "base"])
    return delta.block_delta(old, new, ["conv_id"]).select("conv_id", "text", (F.col("n_ins") - F.col("n_del")).cast("long").alias("net"))


@query(
    "c10_summary",
    f"""WITH {TURN_DELTA}
,
came AS (SELECT p.conv_id, p.turn, b.text, min(b.pos) AS pos FROM pairs p JOIN blocks b ON b.conv_id = p.conv_id AND b.turn = p.turn GROUP BY ALL)
SELECT conv_id, turn, substr(string_agg(text, ' ' ORDER BY pos), 1, 200) AS summary FROM delta JOIN came USING (conv_id, turn, text) WHERE n_ins > 0 GROUP BY ALL""",
)
def c10_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta.block_delta(*turn_pairs(spark, sf_dir), ["conv_id", "turn"], pos="pos").where("n_ins > 0")
    added = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return found.groupBy("conv_id", "turn").agg(delta.summary(added).alias("summary"))


@query(
    "d1_bad_fetch",
    rf"""WITH {TURN_BLOCKS},
j AS (SELECT conv_id, turn, lower(string_agg(text, chr(10) ORDER BY pos)) AS page, sum(length(text)) AS chars FROM blocks GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN coalesce(chars, 0) < 60 THEN 'too_short' WHEN contains(page, 'idiot') OR contains(page, 'moron') THEN 'blacklist' WHEN NOT (contains(page, 'the') OR contains(page, 'der')) THEN 'whitelist_miss' END AS reason
FROM conversations c LEFT JOIN j USING (conv_id, turn)""",
)
def d1_bad_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", delta.bad_fetch(F.col("text"), 60, ("idiot", " ", "moron"), ("", "the", "der")).alias("reason"))


@query(
    "d2_d5_gate",
    f"""WITH {TURN_DELTA},
st AS (SELECT p.conv_id, p.turn, coalesce(sum({words("d.text")} * n_ins), 0) AS aw, coalesce(sum(n_ins), 0) AS i, coalesce(sum(n_del), 0) AS x
       FROM pairs p LEFT JOIN delta d USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN i = 0 AND x = 0 THEN 'reorder_only' WHEN i = 0 THEN 'removed_only' WHEN aw < 50 THEN 'below_threshold' END AS reason FROM st""",
)
def d2_d5_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reorder-only, removed-only and the threshold on words of added blocks; that on aligned words is ``d5_word_threshold``."""
    old, new = turn_pairs(spark, sf_dir)
    stats = delta.delta_stats(delta.block_delta(old, new, ["conv_id", "turn"]), ["conv_id", "turn"])
    pairs = turn_versions(spark, sf_dir).where("outcome = 'stored'").select("conv_id", "turn")
    return delta.gate_changes(pairs.join(stats, ["conv_id", "turn"], "left").na.fill(0), 50, ignore_removed=True).select("conv_id", "turn", "reason")


@query(
    "c7_cell_delta",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS t FROM l),
p AS (SELECT doc_id, p, t AS old_text, regexp_replace(t, '[0-9]', '7', 'g') || CASE WHEN p % 3 = 0 THEN ' | new' ELSE '' END AS new_text FROM r WHERE contains(t, ' | ')),
c AS (SELECT doc_id, p, old_text, new_text, string_split(old_text, ' | ') AS o, string_split(new_text, ' | ') AS n FROM p)
SELECT doc_id, CAST(p - 1 AS INTEGER) AS pos, CAST(len(list_filter(generate_series(1, greatest(len(o), len(n))), lambda i: o[i] IS DISTINCT FROM n[i])) AS INTEGER) AS n_cells,
       regexp_replace(old_text, '[0-9.,]+', '#', 'g') = regexp_replace(new_text, '[0-9.,]+', '#', 'g') AS numeric FROM c""",
)
def c7_cell_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells in all documents, against an edit of digits and an added cell in every third line."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "old_text"))
    rows = rows.where(F.col("old_text").contains(" | "))
    edited = F.concat(F.regexp_replace("old_text", "[0-9]", "7"), F.when((F.col("pos") + 1) % 3 == 0, " | new").otherwise(""))
    found = delta.cell_delta(rows.withColumn("new_text", edited))
    return found.select("doc_id", "pos", F.size("cells").alias("n_cells"), "numeric")


@query("b14_word_counts", f"SELECT doc_id, CAST({words('text')} AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_characters FROM documents")
def b14_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", count_words(F.col("text")).alias("n_words"), F.char_length("text").cast("long").alias("n_characters"))
