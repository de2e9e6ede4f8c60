"""Keyword rules as table rows: all terms found in one pass, matches held against changed spans, rules evaluated by joins.

A rule is one or more rows: ``rule``, ``term``, ``kind`` (substr, word, regex,
num), ``negated``, ``page``, ``scope`` (any, block, near), ``near`` (words),
``op`` and ``value`` (num: the number in group 1 compared so), ``gates``.
However many rules there are, the plan is the same.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.text import parse_number
from chronodiff.session import written

RULE_ROWS = "rule string, term string, kind string, negated boolean, page boolean, scope string, near int, op string, value double, gates boolean"
#: Terms of one automaton, which the driver collects and every task gets; more are searched slice by slice.
SLICE = 100_000
#: Matches that are given on at once, with those of one more text.
GIVEN = 20_000
#: Rules up to which their terms and counts go to every task; more meet the matches in a shuffle by term.
BROADCAST_RULES = 100_000
#: Characters of a bucket when matches meet changed spans.
BUCKET = 256


def rule_rows(spark, rules: list[dict]) -> DataFrame:
    """Rules as a table; what a row leaves out is a plain, gating term anywhere in the changes."""
    plain = {"kind": "substr", "negated": False, "page": False, "scope": "any", "near": None, "op": None, "value": None, "gates": True}
    names = [f.split()[0] for f in RULE_ROWS.split(", ")]
    return spark.createDataFrame([tuple((plain | r)[n] for n in names) for r in rules], RULE_ROWS)


def _named(rules: DataFrame) -> DataFrame:
    """Rules with ``term_id``, by which equal terms of several rules are one."""
    out = rules.where(F.length("term") > 0)
    return out.withColumn("term_id", F.xxhash64("kind", "term", F.coalesce("op", F.lit("")), F.coalesce("value", F.lit(0.0))))


def _folded(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _found(text: str, automaton, patterns: list[tuple[int, re.Pattern]]) -> list[tuple[int, int, int, str | None]]:
    """(term, start, end, group 1) of all terms; matches of one term do not overlap."""
    out: list[tuple[int, int, int, str | None]] = []
    ends: dict[int, int] = {}
    letter = lambda c: c.isalnum() or c == "_"
    if automaton is not None:
        low = _folded(text)
        for last, uses in automaton.iter(low):
            for name, length, whole in uses:
                s, e = last + 1 - length, last + 1
                if s < ends.get(name, 0) or (whole and ((s and letter(low[s - 1])) or (e < len(low) and letter(low[e])))):
                    continue
                ends[name] = e
                out.append((name, s, e, None))
    for name, pattern in patterns:
        out += [(name, *m.span(), m.group(1) if pattern.groups else m.group(0)) for m in pattern.finditer(text)]
    return out


def _finder(sent, width: int, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_text: dict[str, list] = {}
        patterns = []
        for name, kind, term in sent.value:
            if kind in ("substr", "word"):
                by_text.setdefault(_folded(term), []).append((name, len(_folded(term)), kind == "word"))
            else:
                patterns.append((name, re.compile(term, re.IGNORECASE | re.MULTILINE)))
        automaton = ahocorasick.Automaton() if by_text else None
        for text, uses in by_text.items():
            automaton.add_word(text, uses)
        if automaton is not None:
            automaton.make_automaton()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())

        def given(batch: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:width]]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(width)):
                text = text.as_py()
                found = _found(text, automaton, patterns) if text else []
                if found:
                    starts = [m.start() for m in re.finditer(r"\S+", text)]
                    rows += [k] * len(found)
                    out += [(name, s, e, bisect_right(starts, s), g) for name, s, e, g in found]
                if len(out) >= GIVEN:
                    yield given(batch, rows, out)
                    rows, out = [], []
            if out:
                yield given(batch, rows, out)

    return work


def term_matches(texts: DataFrame, rules: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, ``term_id``, ``s``, ``e``, ``word`` for every match of every term; ``term_id`` is a term's (see ``with_ids``).

    Literal terms of all rules are one Aho-Corasick automaton, so a text is
    read once whatever their number; only regular expressions cost a pass each.
    Case does not count; ``word`` matches stand between no letters, digits or
    underscores. ``s`` and ``e`` are characters, ``word`` the number of words
    that begin at or before ``s``. A ``num`` term matches where its number
    compares as asked.
    """
    spark = texts.sparkSession
    terms = _named(rules).select("term_id", "kind", "term", "op", "value").dropDuplicates(["term_id"])
    n = -(-terms.count() // SLICE)
    kinds = dict(texts.dtypes)
    names = [*keys, "term_id", "s", "e", "word", "g"]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["term_id long, s int, e int, word int, g string"])
    found = None
    for k in range(n):
        own = terms.where(F.pmod("term_id", F.lit(n)) == k).select("term_id", "kind", "term").collect()  # SLICE terms, about
        sent = spark.sparkContext.broadcast([(r["term_id"], r["kind"], r["term"]) for r in sorted(own, key=lambda r: r["term_id"])])
        part = texts.select(*keys, text_col).mapInArrow(_finder(sent, len(keys), names), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema).drop("g")
    numbers = terms.where("kind = 'num'").select("term_id", F.col("op").alias("_op"), F.col("value").alias("_value"))
    numbers = F.broadcast(numbers) if n == 1 else numbers
    found = found.join(numbers, "term_id", "left")
    x, v, op = parse_number(F.col("g")), F.col("_value"), F.col("_op")
    holds = F.when(op == "<", x < v).when(op == "<=", x <= v).when(op == ">", x > v).when(op == ">=", x >= v).otherwise(F.abs(x - v) < 1e-9)
    return found.where(op.isNull() | holds).select(*keys, "term_id", "s", "e", "word")


def with_ids(rules: DataFrame) -> DataFrame:
    """The rules with the ``term_id`` that ``term_matches`` gives their terms."""
    return _named(rules)


def changed_spans(ops: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``op``, ``k``, ``text``, ``spans``: blocks of the new side that came or were edited, and what changed in them.

    ``ops`` are operations of ``align.align_blocks``. Spans are characters of
    the block without trailing white space of a token; a block that came as a whole, or in a
    run without word script, is one span.
    """
    left = F.filter("tokens", lambda x: x["k"] != "del")
    whole = F.aggregate(left, F.lit(""), lambda a, x: F.concat(a, x["text"]))
    ends = F.transform(F.sequence(F.lit(1), F.size(left)), lambda i: F.aggregate(F.slice(left, 1, i), F.lit(0), lambda a, x: a + F.char_length(x["text"])))
    pieces = F.when(F.size(left) > 0, F.arrays_zip(left.alias("t"), ends.alias("e")))
    per_line = lambda x: F.split(x["t"]["text"], "\n", -1)

    def inner(x: Column) -> Column:
        """Changed spans of one token run, cut at line feeds, in characters of the whole run."""
        lines = per_line(x)
        begin = x["e"] - F.char_length(x["t"]["text"])
        at = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: begin + F.aggregate(F.slice(lines, 1, i - 1), F.lit(0), lambda a, y: a + F.char_length(y) + 1))
        return F.filter(F.transform(F.arrays_zip(at.alias("s"), lines.alias("y")), lambda z: F.struct(z["s"].alias("s"), (z["s"] + F.char_length(F.rtrim(z["y"]))).alias("e"))), lambda z: z["e"] > z["s"])

    spans = F.flatten(F.transform(F.filter(pieces, lambda x: x["t"]["k"] == "ins"), inner))
    rows = ops.where(F.col("t").isin("ins", "rep")).select(*keys, "op", "new_texts", whole.alias("run"), spans.alias("all"))
    rows = rows.withColumn("fits", F.col("run") == F.array_join("new_texts", "\n"))
    starts = F.transform(F.sequence(F.lit(1), F.size("new_texts")), lambda i: F.aggregate(F.slice("new_texts", 1, i - 1), F.lit(0), lambda a, y: a + F.char_length(y) + 1))
    blocks = F.transform(F.arrays_zip(F.col("new_texts").alias("text"), starts.alias("at")), lambda b: F.struct(b["text"].alias("text"), b["at"].alias("at"), (b["at"] + F.char_length(b["text"])).alias("to")))
    rows = rows.select(*keys, "op", "fits", "all", F.posexplode(blocks).alias("k", "b"))
    own = F.transform(F.filter("all", lambda z: (z["s"] < F.col("b.to")) & (z["e"] > F.col("b.at"))), lambda z: F.struct((z["s"] - F.col("b.at")).alias("s"), (z["e"] - F.col("b.at")).alias("e")))
    everything = F.array(F.struct(F.lit(0).alias("s"), F.char_length("b.text").alias("e")))
    return rows.select(*keys, "op", "k", F.col("b.text").alias("text"), F.when(F.col("fits"), own).otherwise(everything).alias("spans"))


def overlapping(matches: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Matches (``keys``, ``s``, ``e``, more) that overlap a span (``keys``, ``s``, ``e``) of the same text; an empty match must lie inside one.

    Both sides are dealt to buckets of ``BUCKET`` characters, so that a long
    text's matches meet only the spans near them.
    """
    bucket = lambda s, e: F.explode(F.sequence((s / BUCKET).cast("int"), (F.greatest(s, e - 1) / BUCKET).cast("int")))
    left = matches.withColumn("bucket", bucket(F.col("s"), F.col("e")))
    right = spans.where("e > s").select(*keys, F.col("s").alias("a"), F.col("e").alias("b"), bucket(F.col("s"), F.col("e")).alias("bucket"))
    hit = ((F.col("s") < F.col("b")) & (F.col("a") < F.col("e"))) | ((F.col("s") == F.col("e")) & (F.col("s") >= F.col("a")) & (F.col("s") < F.col("b")))
    return left.join(right, [*keys, "bucket"]).where(hit).select(*matches.columns).distinct()


def fired(changes: DataFrame, rules: DataFrame, keys: list[str], block: list[str], pages: DataFrame | None = None) -> DataFrame:
    """``keys``, ``rule``, ``gates``: the rules that fire on each change.

    ``changes``: changed blocks (``keys``, ``block`` in page order, ``text``,
    ``spans``); a match counts only where it overlaps a span. ``pages``: the
    whole new page (``keys``, ``text``), for terms of ``page``. A rule needs
    all its positive terms: anywhere in the changes, in one block, or within
    ``near`` words of each other; all its page terms on the page; and none of
    its negated terms. Rules without a term on the changes never fire.
    """
    named = with_ids(rules)
    uses = named.select("rule", "term_id", "negated", "page", "scope", "near")
    place = [*keys, *block]
    # a shuffle by term would put all matches of a frequent word in one task
    sent = F.broadcast if rules.count() <= BROADCAST_RULES else lambda df: df
    changes = written(changes.select(*place, "text", "spans"), "changes")
    on_change = uses.where(~F.col("page"))
    spans = changes.select(*place, F.explode("spans").alias("x")).select(*place, "x.s", "x.e")
    hits = written(overlapping(term_matches(changes, rules.where(~F.col("page")), place), spans, place), "hits")

    need = uses.where(~F.col("negated") & ~F.col("page")).groupBy("rule").agg(F.countDistinct("term_id").alias("need"), F.first("scope").alias("scope"), F.first("near").alias("near"))
    # a term that several rules have is one row in hits, and one a rule from here on
    positive = hits.join(sent(on_change.where(~F.col("negated")).select("rule", "term_id").distinct().join(need, "rule")), "term_id")
    enough = F.col("got") == F.col("need")
    anywhere = positive.where("scope = 'any'").groupBy(*keys, "rule", "need").agg(F.countDistinct("term_id").alias("got")).where(enough)
    together = positive.where("scope = 'block'").groupBy(*place, "rule", "need").agg(F.countDistinct("term_id").alias("got")).where(enough)
    good = anywhere.select(*keys, "rule").unionByName(together.select(*keys, "rule")).unionByName(_near(changes, positive.where("scope = 'near'"), need, on_change, keys, block, sent))

    bad = hits.join(sent(on_change.where("negated").select("rule", "term_id")), "term_id").select(*keys, "rule")
    good = good.distinct().join(bad.distinct(), [*keys, "rule"], "left_anti")
    if pages is not None:
        seen = term_matches(pages, rules.where("page"), keys).select(*keys, "term_id").distinct()
        context = seen.join(sent(uses.where("page")), "term_id")
        good = good.join(context.where("negated").select(*keys, "rule").distinct(), [*keys, "rule"], "left_anti")
        wanted = uses.where(F.col("page") & ~F.col("negated")).groupBy("rule").agg(F.countDistinct("term_id").alias("wanted"))
        there = context.where(~F.col("negated")).groupBy(*keys, "rule").agg(F.countDistinct("term_id").alias("there"))
        good = good.join(sent(wanted), "rule", "left").join(there, [*keys, "rule"], "left").where(F.coalesce("there", F.lit(0)) == F.coalesce("wanted", F.lit(0)))
    flags = rules.groupBy("rule").agg(F.min("gates").alias("gates"))
    return good.select(*keys, "rule").join(sent(flags), "rule").select(*keys, "rule", "gates")


def _near(changes: DataFrame, hits: DataFrame, need: DataFrame, uses: DataFrame, keys: list[str], block: list[str], sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keys``, ``rule`` whose terms all occur within the rule's words; words are counted through all changed blocks.

    Each occurrence meets each term of its rule; the latest occurrence of every
    term up to it bounds the smallest window that ends there.
    """
    before = F.sum(F.regexp_count("text", F.lit(r"(?U)\S+"))).over(W.partitionBy(*keys).orderBy(*block).rowsBetween(W.unboundedPreceding, -1))
    words = changes.select(*keys, *block, F.coalesce(before, F.lit(0)).alias("before"))
    spots = hits.join(words, [*keys, *block]).select(*keys, "rule", "term_id", F.greatest(F.col("before") + F.col("word") - 1, F.lit(0)).alias("i")).distinct()
    terms = uses.where(~F.col("negated")).select("rule", F.col("term_id").alias("term")).distinct().join(need.where("scope = 'near'"), "rule")
    met = spots.join(sent(terms), "rule").groupBy(*keys, "rule", "need", "near", "term", "i").agg(F.max(F.when(F.col("term_id") == F.col("term"), F.col("i"))).alias("own"))
    latest = F.last("own", ignorenulls=True).over(W.partitionBy(*keys, "rule", "term").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    ends = met.withColumn("latest", latest).groupBy(*keys, "rule", "need", "near", "i").agg(F.count("latest").alias("got"), F.min("latest").alias("low"))
    return ends.where((F.col("got") == F.col("need")) & (F.col("i") - F.col("low") <= F.col("near"))).select(*keys, "rule").distinct()


def rule_hits(fired_rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``hits`` (rules that gate) and ``marks`` (all that fired, for highlighting)."""
    gating = F.array_sort(F.collect_set(F.when(F.col("gates"), F.col("rule"))))
    return fired_rules.groupBy(*keys).agg(gating.alias("hits"), F.array_sort(F.collect_set("rule")).alias("marks"))
