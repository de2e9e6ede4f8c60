"""Finding what makes a page change for nothing, and trying a configuration on history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodiff.functions.text import ignore_text
from chronodiff.operators import align, delta, dom, keywords
from chronodiff.session import written

#: Patterns of what changes by itself, the more specific first; case does not count (fixed values).
VOLATILE = (
    ("relative_time", r"\b(?:\d+\s*(?:seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\s+ago|just now|moments? ago|yesterday|today)\b"),
    ("iso_datetime", r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\b"),
    ("long_date", r"\b(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?|\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?(?:,?\s+\d{4})?)\b"),
    ("numeric_date", r"\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})\b"),
    ("clock_time", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]\.?m\.?)?(?:\s*(?:utc|gmt|[ecmp][sd]t))?\b"),
    ("counter", r"\b(?:\d[\d,. ]*\s*(?:views?|visitors?|visits?|hits?|readers?|users?|viewers?|downloads?|comments?|shares?|likes?|votes?|replies|members?|online|watching)|(?:views?|visitors?|visits?|hits?|readers?|downloads?|comments?|shares?|likes?|votes?|online)\s*[:#]?\s*\d[\d,. ]*)\b"),
    ("unix_timestamp", r"\b1[5-9]\d{8}(?:\d{3})?\b"),
    ("hex_token", r"\b[0-9a-f]{16,}\b"),
    ("currency_amount", r"(?:[$€£¥]\s?\d[\d,.]*|\b(?:usd|eur|gbp)\s?\d[\d,.]*|\d[\d,.]*\s?[€£¥])"),
)


def volatile_pattern(old: Column, new: Column) -> Column:
    """The first pattern that both texts have and without which they are equal."""
    out = None
    for name, body in VOLATILE:
        pattern = f"(?i){body}"
        hit = old.rlike(pattern) & new.rlike(pattern) & (F.regexp_replace(old, pattern, "") == F.regexp_replace(new, pattern, ""))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def propose_rules(pairs: DataFrame, page: str) -> DataFrame:
    """``page``, ``pattern``, ``pairs`` it resolves, ``all_pairs``, ``resolves_all``: rules verified by comparing again."""
    rows = pairs.withColumn("pattern", volatile_pattern(F.col("old_text"), F.col("new_text")))
    total = rows.groupBy(page).agg(F.count("*").alias("all_pairs"), F.count("pattern").alias("solved"))
    each = rows.where("pattern is not null").groupBy(page, "pattern").agg(F.count("*").alias("pairs"))
    return each.join(total, page).select(page, "pattern", "pairs", "all_pairs", (F.col("solved") == F.col("all_pairs")).alias("resolves_all"))


def propose_elements(pairs: DataFrame, page: str, pair: str, old: str = "old_html", new: str = "new_html") -> DataFrame:
    """``page``, ``selector``, ``pairs`` it resolves, ``all_pairs``, ``resolves_all``: elements to drop, verified by what changes without them.

    For pairs that no pattern resolves. Each changed block proposes the
    innermost element around it that has a lasting id or class; an element
    resolves a pair if all changed blocks of the pair lie in it.
    ``resolves_all`` tells whether all proposals of the page together resolve
    all its pairs. Pairs without a changed block do not count; ``pair`` names
    one row and is not null.
    """
    side = lambda c: dom.owned_blocks(pairs, pair, c)
    changed = delta.block_delta(side(old), side(new), [pair, "owners"]).join(pairs.select(page, pair), pair)
    inner = changed.withColumn("selector", F.get("owners", F.lit(0)))
    each = inner.groupBy(page, pair).agg(F.count("*").alias("blocks"), (F.count("selector") == F.count("*")).alias("solved"))
    total = each.groupBy(page).agg(F.count("*").alias("all_pairs"), F.bool_and("solved").alias("resolves_all"))
    inside = changed.select(pair, F.explode(F.array_distinct("owners")).alias("selector")).groupBy(pair, "selector").agg(F.count("*").alias("inside"))
    alone = inside.join(each, pair).where("inside = blocks").groupBy(page, "selector").agg(F.count("*").alias("pairs"))
    rules = inner.where("selector is not null").select(page, "selector").distinct()
    out = rules.join(alone, [page, "selector"], "left").join(total, page)
    return out.select(page, "selector", F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), "all_pairs", "resolves_all")


def unstable_blocks(samples: DataFrame, page: str, sample: str) -> DataFrame:
    """``page``, ``text``, ``share``: blocks that some samples of a page lack, and the share of samples that do."""
    n = samples.groupBy(page).agg(F.countDistinct(sample).alias("n"))
    has = samples.groupBy(page, "text").agg(F.countDistinct(sample).alias("has"))
    return has.join(n, page).where("has < n").select(page, "text", (1 - F.col("has") / F.col("n")).alias("share"))


def replay(old_verdicts: DataFrame, new_verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """``was``, ``would``, ``n``: how verdicts under a candidate configuration differ from those that stand."""
    a = old_verdicts.select(*keys, F.coalesce("verdict", F.lit("alert")).alias("was"))
    b = new_verdicts.select(*keys, F.coalesce("verdict", F.lit("alert")).alias("would"))
    return a.join(b, keys, "full_outer").groupBy("was", "would").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Config:
    """Filters and gate of a page; ``ignore`` has (pattern, kind), ``terms`` has (rule, term, kind)."""

    ignore: tuple[tuple[str, str], ...] = ()
    min_chars: int = 0
    blacklist: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    min_words: int = 0
    ignore_removed: bool = False
    terms: tuple[tuple[str, str, str], ...] = ()


def filtered_body(body: Column, config: Config) -> Column:
    """The lines of a stored body that the filters leave, one block a line."""

    def line(x: Column) -> Column:
        for pattern, kind in config.ignore:
            x = ignore_text(x, pattern, kind)
        return x

    left = F.transform(F.split(delta.joined_blocks(body), "\n", -1), line)
    return F.array_join(F.filter(left, lambda x: x != ""), "\n")


def _head(old: Column, new: Column, config: Config) -> Column:
    """The verdict that needs no alignment, else null."""
    return F.when(old == new, "unchanged").otherwise(delta.bad_fetch(new, config.min_chars, config.blacklist, config.whitelist))


def _sums(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """What ``align.diff_stats`` says of each pair of filtered bodies (``old_body``, ``new_body``).

    Alignment is long work on few bytes, so pairs are dealt to all of the
    session's shuffle partitions, which Spark then does not put together.
    """
    blocks = lambda c: F.filter(F.split(c, "\n", -1), lambda x: x != "")
    rows = bodies.repartition(int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return align.diff_stats(align.align_blocks(rows.select(*keys, blocks("old_body").alias("old_blocks"), blocks("new_body").alias("new_blocks")), keys), keys)


def _judged(rows: DataFrame, sums: DataFrame, keys: list[str], config: Config, by: list[str]) -> DataFrame:
    """``keys``, ``verdict`` from ``head``, the sums (by ``by``) and, with terms, the bodies."""
    stats = rows.select(*by, "head").join(sums, by, "left").na.fill(0, [c for c, t in sums.dtypes if c not in by and t != "boolean"])
    if config.terms:
        diff = delta.block_delta(delta.line_blocks(rows, keys, "old_body"), delta.line_blocks(rows, keys, "new_body"), keys)
        added = diff.where("n_ins > 0").withColumn("pos", F.lit(0))
        hits = keywords.term_hits(added, list(config.terms), keys).groupBy(*keys).agg(F.collect_set("term").alias("hits"))
        stats = stats.join(hits, keys, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    judged = delta.gate_changes(stats, config.min_words, config.ignore_removed, bool(config.terms))
    return judged.select(*keys, F.coalesce("head", "reason", F.lit("alert")).alias("verdict"))


def try_config(pairs: DataFrame, keys: list[str], config: Config, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """``keys``, ``verdict``: what ``config`` says of each pair of stored bodies.

    In order: ``unchanged`` (equal blocks in equal order), the reason of a bad
    fetch, the gate's reason, ``alert``. Filters run within a body's row; only
    bodies are shuffled, and those that the first two settle are not aligned. A
    null body has no blocks. Keys name one pair and are not null.
    """
    rows = pairs.select(*keys, filtered_body(F.col(old), config).alias("old_body"), filtered_body(F.col(new), config).alias("new_body"))
    rows = written(rows.withColumn("head", _head(F.col("old_body"), F.col("new_body"), config)), "bodies")
    return _judged(rows, _sums(rows.where("head is null"), keys), keys, config, keys)


def replay_bodies(pairs: DataFrame, keys: list[str], standing: Config, candidate: Config) -> DataFrame:
    """``was``, ``would``, ``n``: both configurations run over all stored pairs of bodies (``old_text``, ``new_text``).

    A pair that both configurations filter to the same bodies is aligned once.
    """
    sides = [F.struct(filtered_body(F.col("old_text"), c).alias("old_body"), filtered_body(F.col("new_text"), c).alias("new_body")) for c in (standing, candidate)]
    rows = pairs.select(*keys, sides[0].alias("a"), sides[1].alias("b"))
    heads = [_head(F.col(f"{x}.old_body"), F.col(f"{x}.new_body"), c).alias(f"head_{x}") for x, c in (("a", standing), ("b", candidate))]
    rows = written(rows.select(*keys, "a", "b", *heads, F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("body")), "bodies")
    first = F.when(F.col("head_a").isNull() | (F.col("head_b").isNull() & (F.col("body") == 0)), F.struct(F.lit(0).alias("body"), "a.*"))
    second = F.when(F.col("head_b").isNull() & (F.col("body") == 1), F.struct(F.lit(1).alias("body"), "b.*"))
    by = [*keys, "body"]
    bodies = rows.select(*keys, F.explode(F.array_compact(F.array(first, second))).alias("x")).select(*keys, "x.*")
    sums = written(_sums(bodies, by), "sums")
    own = lambda x, body: rows.select(*keys, body.alias("body"), F.col(f"head_{x}").alias("head"), f"{x}.*")
    was = _judged(own("a", F.lit(0)), sums, keys, standing, by)
    return replay(was, _judged(own("b", F.col("body")), sums, keys, candidate, by), keys)
