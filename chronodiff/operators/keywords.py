"""Keyword rules as table rows, matched against changed blocks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.text import WORD, parse_number


Rule = tuple[str, str, str]


def term_pattern(term: str, kind: str) -> str:
    """The pattern that finds a ``substring``, a whole ``word`` or phrase, or a ``regex``; case does not count."""
    literal = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)
    body = {"regex": term, "word": rf"(^|[^\p{{L}}\p{{N}}_]){literal}([^\p{{L}}\p{{N}}_]|$)", "substring": literal}[kind]
    return f"(?i){body}"


def term_hits(blocks: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """``keys``, ``pos``, ``rule``, ``term`` where a term of the rules (rule, term, kind) occurs.

    Every pattern is a constant of one projection, compiled once; no join.
    """
    hit = [F.when(F.col("text").rlike(term_pattern(term, kind)), F.struct(F.lit(rule).alias("rule"), F.lit(term).alias("term"))) for rule, term, kind in rules]
    found = blocks.select(*keys, "pos", F.explode(F.array_compact(F.array(*hit))).alias("h"))
    return found.select(*keys, "pos", "h.rule", "h.term")


def and_hits(hits: DataFrame, rules: list[Rule], keys: list[str], same_block: bool = False) -> DataFrame:
    """``keys``, ``rule``: rules all of whose terms occur, anywhere or in one block."""
    wanted = {r: len({t for q, t, _ in rules if q == r}) for r, _, _ in rules}
    group = [*keys, "pos", "rule"] if same_block else [*keys, "rule"]
    got = hits.groupBy(*group).agg(F.countDistinct("term").alias("got"))
    need = F.create_map(*[x for r, n in wanted.items() for x in (F.lit(r), F.lit(n))])
    return got.where(F.col("got") == need[F.col("rule")]).select(*keys, "rule").distinct()


def near_hits(df: DataFrame, keys: list[str], text_col: str, terms: list[str], within: int) -> DataFrame:
    """``keys`` and ``span``: the fewest words from the first to the last of one of each term, if at most ``within``.

    A term is a word or a phrase. Positions of the terms' first words; at each, the latest position of every term up
    to there gives the smallest window that ends there.
    """
    words = F.transform(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), 0), lambda x, i: F.struct(i.alias("i"), x.alias("w")))
    split = [(t, t.lower().split()) for t in terms]
    heads = df.select(*keys, words.alias("all")).select(*keys, "all", F.explode(F.filter("all", lambda s: s["w"].isin([w[0] for _, w in split]))).alias("s"))
    there = lambda w: F.transform(F.slice("all", F.col("s.i") + 1, len(w)), lambda s: s["w"]) == F.array(*map(F.lit, w))
    which = F.array_compact(F.array(*[F.when(there(w), F.struct(F.lit(t).alias("t"), F.lit(len(w)).alias("n"))) for t, w in split]))
    spots = heads.select(*keys, F.col("s.i").alias("i"), F.explode(which).alias("m")).select(*keys, "i", F.col("m.t").alias("w"))
    order = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("w") == t, F.col("i")), ignorenulls=True).over(order).alias(f"t{k}") for k, t in enumerate(terms)]
    cols = [F.col(f"t{k}") for k in range(len(terms))]
    found = spots.select(*keys, "i", *last).where(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]))
    low = F.least(*cols) if len(cols) > 1 else cols[0]
    return found.groupBy(*keys).agg(F.min(F.col("i") - low + 1).alias("span")).where(F.col("span") <= within)


def without_not(hits: DataFrame, not_hits: DataFrame, keys: list[str]) -> DataFrame:
    """Rule hits whose negated terms do not occur (``not_hits``: ``keys``, ``rule``)."""
    return hits.join(not_hits.select(*keys, "rule").distinct(), [*keys, "rule"], "left_anti")


def literal_offsets(df: DataFrame, keys: list[str], text_col: str, term: str) -> DataFrame:
    """``keys``, ``s``, ``e``: character offsets of a literal term (case-folded), from the lengths of what lies between."""
    pieces = F.split(F.lower(text_col), term_pattern(term.lower(), "substring").removeprefix("(?i)"), -1)
    lens = F.transform(pieces, F.char_length)
    step = F.aggregate(
        F.slice(lens, 1, F.size(lens) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, n: F.struct((a["at"] + n + len(term)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"],
    )
    return df.where(F.size(pieces) > 1).select(*keys, F.explode(step).alias("s")).withColumn("e", F.col("s") + len(term))


def overlapping(matches: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that overlap a changed span of the same text; an empty match must lie inside one."""
    joined = matches.join(spans.withColumnRenamed("s", "a").withColumnRenamed("e", "b"), keys)
    hit = ((F.col("s") < F.col("b")) & (F.col("a") < F.col("e"))) | ((F.col("s") == F.col("e")) & (F.col("s") >= F.col("a")) & (F.col("s") <= F.col("b")))
    return joined.where(hit).select(*keys, "s", "e").distinct()


def numeric_hit(text: Column, pattern: str, op: str, value: float, upper: float | None = None) -> Column:
    """Whether any number that group 1 of the pattern finds compares so; with ``upper``, lies between both."""
    ops = {"<": lambda a: a < value, "<=": lambda a: a <= value, ">": lambda a: a > value, ">=": lambda a: a >= value, "=": lambda a: a == value, "between": lambda a: (a >= value) & (a <= upper)}
    return F.exists(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.coalesce(ops[op](parse_number(x)), F.lit(False)))


def min_new_items(old: DataFrame, new: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys``, ``fresh``: pairs with at least n distinct blocks that the old side lacks, without regard to case."""
    a, b = (d.select(*keys, F.lower("text").alias("text")).distinct() for d in (old, new))
    return b.join(a, [*keys, "text"], "left_anti").groupBy(*keys).agg(F.count("*").alias("fresh")).where(F.col("fresh") >= n)
