"""Benchmark decontamination: which documents hold passages of benchmark items (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import cut

#: A word: digits, letters of ASCII (lower-cased before) and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a shingle; the token of the set join.
SHINGLE = 3
#: Up to so many item shingles are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000
#: Up to so many document ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Up to so many item windows are broadcast with their words; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII texts take the quicker ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``item``, ``window`` (array of words), ``len``: runs of ``size`` words; a shorter item is one."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("words"))
    items = items.where((F.size("words") > 0) & F.col("item").isNotNull())
    last = F.greatest(F.size("words") - size, F.lit(0))
    at = items.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    return at.select("item", F.slice("words", F.col("p") + 1, size).alias("window")).withColumn("len", F.size("window"))


def _shingle(words: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(n)])


def _window_tokens(windows: DataFrame) -> DataFrame:
    """``window``, ``len``, ``off``, ``sh``: the shingles of each window, of three words or of all where it has fewer."""
    n = F.least(F.col("len"), F.lit(SHINGLE))
    at = windows.select("window", "len", F.explode(F.sequence(F.lit(0), F.col("len") - n)).alias("off"))
    hashed = F.when(F.col("len") == 1, _shingle("window", F.col("off"), 1)).when(F.col("len") == 2, _shingle("window", F.col("off"), 2))
    return at.withColumn("sh", hashed.otherwise(_shingle("window", F.col("off"), SHINGLE)))


def _scan(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """One pass over all documents: where item tokens occur (``id``, ``pos``, ``sh``), and a row with ``sh`` 0 and ``pos`` the number of words for each row.

    Rows without id have only the latter. An occurrence is three numbers,
    without words, so that a token in every document costs no more than that.
    """
    sizes = sorted(r[0] for r in tokens.select(F.least("len", F.lit(SHINGLE))).distinct().collect())  # 1, 2, 3 at most
    keys = tokens.select("sh").distinct()
    small = keys.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    own = docs.select("id", words(F.col("text")).alias("words"))
    last = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.size("words") - 1)
    at = own.select("id", "words", F.explode(F.sequence(F.lit(-1), last)).alias("at"))
    found = [F.when(F.col("at") + n <= F.size("words"), _shingle("words", F.col("at"), n)) for n in sizes]
    if len(found) < 2:
        at = at.withColumn("sh", found[0] if found else F.lit(None).cast("long"))
    else:
        at = at.select("id", "words", "at", F.explode(F.when(F.col("at") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(*found))).alias("sh"))
    at = at.select("id", F.when(F.col("at") < 0, F.size("words")).otherwise(F.col("at")).alias("pos"), F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.col("sh")).alias("sh"))
    if small:
        mark = keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("sh"))
        return at.join(F.broadcast(keys.unionByName(mark)), "sh", "left_semi").select("id", "pos", "sh")
    return at.where("sh <> 0").join(keys, "sh", "left_semi").select("id", "pos", "sh").unionByName(own.select("id", F.size("words").alias("pos"), F.lit(0).cast("long").alias("sh")))


def _windows_and_scan(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    windows = cut(item_windows(benchmark, item_col, item_text, size), "item-windows")
    return rows, windows, cut(_scan(rows, _window_tokens(windows.select("window", "len").distinct())), "tokens")


def _matches(rows: DataFrame, windows: DataFrame, seen: DataFrame) -> DataFrame:
    """``id``, ``start``, ``len``, ``item`` of every window that a document holds.

    Every window is joined by its prefix alone: its rarest token. What the join
    brings is bounded by position and length (a window must lie inside the
    document), and only documents with such candidates are read again, to
    compare all words.
    """
    tokens = _window_tokens(windows.select("window", "len").distinct())
    counts = seen.where("sh <> 0").groupBy("sh").agg(F.count("*").alias("n"))
    prefix = cut(
        tokens.join(counts, "sh", "left").groupBy("window", "len")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "sh")).alias("rare"))
        .where("rare.n > 0").select("window", "len", "rare.off", "rare.sh"),
        "prefixes",
    )
    few = prefix.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    near = seen.where("sh <> 0").join(F.broadcast(prefix) if few else prefix, "sh")
    near = near.select("id", (F.col("pos") - F.col("off")).alias("start"), "len", "window").where("start >= 0")
    near = cut(near.groupBy("id").agg(F.collect_set(F.struct("start", "len", "window")).alias("near")), "candidates")
    asked = rows.where("id is not null")
    if near.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # so that the other texts are not shuffled
        asked = asked.join(F.broadcast(near.select("id")), "id", "left_semi")
    held = near.join(asked, "id").select("id", words(F.col("text")).alias("words"), "near")
    one = held.select("id", "words", F.explode("near").alias("c")).where(F.col("c.start") + F.col("c.len") <= F.size("words"))
    hits = one.where(F.slice("words", F.col("c.start") + 1, F.col("c.len")) == F.col("c.window")).select("id", "c.start", "c.len", "c.window")
    return hits.join(windows.select("window", "item").distinct(), "window").select("id", "start", "len", "item")


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every occurrence of an item window in a document: ``id``, ``start``, ``len``, ``item``.

    A set join with full containment as its threshold. Tokens are shingles of
    three words (of all words, where a window has fewer), ordered by how often
    they occur in the documents, which one scan of all documents counts. As a
    window must be held whole, one token is its necessary prefix: the rarest.
    See ``_matches`` for the bounds and the exact comparison.
    """
    return _matches(*_windows_and_scan(docs, benchmark, size, id_col, text_col, item_col, item_text))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document with a hit: ``id``, ``n_hit`` words under any occurrence, ``items`` (sorted ids as text).

    Defined cases: null texts have no words; items without words or id are
    skipped, items with equal texts all count; documents without id have no
    hits; rows that share an id count as one document; long texts are read
    whole, a document's occurrences being one array; an empty table on either
    side gives no rows.
    """
    return _summed(find_windows(docs, benchmark, size, id_col, text_col, item_col, item_text))


def _summed(found: DataFrame) -> DataFrame:
    spots = F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda w: F.sequence(w["start"], w["start"] + w["len"] - 1)))
    return found.groupBy("id").agg(
        F.size(F.array_distinct(spots)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item; columns as they come.

    Cases as in ``contamination``; rows without id stay.
    """
    hit = find_windows(docs, benchmark, size, id_col, text_col, item_col, item_text)
    hit = cut(hit.select(F.col("id").alias("hit_id")).distinct(), "hits")
    few = hit.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(hit) if few else hit, docs[f"`{id_col}`"] == hit["hit_id"], "left_anti")


def leak_report(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, words, hit words and items; texts are split into words once. Cases as in ``contamination``."""
    rows, windows, seen = _windows_and_scan(docs, benchmark, size, id_col, text_col, item_col, item_text)
    hits = _summed(_matches(rows, windows, seen))
    return seen.where("sh = 0").join(hits, "id", "left").select(
        F.col("id").alias(id_col),
        F.col("pos").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
