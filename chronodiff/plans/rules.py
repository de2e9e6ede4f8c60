"""Queries on keyword rules, keyed records and candidate configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.operators import align, delta, keywords, records, replay, rulerows
from chronodiff.plans.changes import stored_pairs, turn_pairs, turn_versions
from chronodiff.plans.registry import query
from chronodiff.plans.sql import TURN_DELTA, norm, words
from chronodiff.session import table

DOC_BLOCKS = f"""
dl AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
de AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM dl),
dn AS (SELECT doc_id, p, {norm("line")} AS text FROM de),
doc_blocks AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, text FROM dn WHERE text <> '')"""

RULES = [("insult", "idiot", "word"), ("insult", "moron", "word"), ("licence", "licen[sc]ed? under", "regex"), ("pair", "the", "word"), ("pair", "scum", "substring")]
_RULE_SQL = "rules(rule, term) AS (VALUES " + ", ".join(f"('{r}', '{t}')" for r, t, _ in RULES) + "), hits AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id, pos, '{r}' AS rule, '{t}' AS term FROM doc_blocks WHERE regexp_matches(text, '{keywords.term_pattern(t, k)}')" for r, t, k in RULES
) + ")"


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.line_blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.term_hits(doc_blocks(spark, sf_dir), RULES, ["doc_id"])


@query("d8_keyword_terms", f"WITH {DOC_BLOCKS}, {_RULE_SQL} SELECT * FROM hits")
def d8_keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


@query("d10_and_terms", f"""WITH {DOC_BLOCKS}, {_RULE_SQL}, w AS (SELECT rule, count(DISTINCT term) AS n FROM rules GROUP BY rule),
a AS (SELECT doc_id, rule FROM hits GROUP BY doc_id, rule HAVING count(DISTINCT term) = (SELECT n FROM w WHERE w.rule = hits.rule)),
b AS (SELECT DISTINCT doc_id, rule FROM hits GROUP BY doc_id, pos, rule HAVING count(DISTINCT term) = (SELECT n FROM w WHERE w.rule = hits.rule))
SELECT doc_id, rule, 'page' AS scope FROM a UNION ALL SELECT doc_id, rule, 'block' FROM b""")
def d10_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of a rule anywhere in the document, and in one block."""
    h, r = hits(spark, sf_dir), RULES
    page = keywords.and_hits(h, r, ["doc_id"]).withColumn("scope", F.lit("page"))
    return page.unionByName(keywords.and_hits(h, r, ["doc_id"], same_block=True).withColumn("scope", F.lit("block")))


@query("d11_near_terms", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS t FROM w), a AS (SELECT doc_id, i FROM p WHERE t = 'the'), b AS (SELECT doc_id, i FROM p WHERE t = 'idiot')
SELECT doc_id, CAST(min(abs(a.i - b.i)) + 1 AS INTEGER) AS span FROM a JOIN b USING (doc_id) GROUP BY doc_id HAVING min(abs(a.i - b.i)) + 1 <= 12""")
def d11_near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.near_hits(table(spark, sf_dir, "documents"), ["doc_id"], "text", ["the", "idiot"], 12)


@query("d12_not_terms", f"WITH {DOC_BLOCKS}, {_RULE_SQL} SELECT DISTINCT doc_id FROM hits WHERE rule = 'insult' AND doc_id NOT IN (SELECT doc_id FROM hits WHERE rule = 'licence')")
def d12_not_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an insult and without a licence line."""
    h = hits(spark, sf_dir)
    wanted = h.where("rule = 'insult'").select("doc_id", "rule").distinct()
    return keywords.without_not(wanted, h.where("rule = 'licence'").withColumn("rule", F.lit("insult")), ["doc_id"]).select("doc_id")


@query("d13_changed_spans", r"""WITH m AS (SELECT doc_id, string_split(lower(text), 'the') AS ps FROM documents),
c AS (SELECT doc_id, generate_subscripts(ps, 1) AS k, len(ps) AS n, sum(length(unnest)) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM (SELECT doc_id, ps, generate_subscripts(ps, 1) AS k, unnest(ps) FROM m)),
o AS (SELECT doc_id, CAST(before + 3 * (k - 1) AS INTEGER) AS s FROM c WHERE k < n),
sp(a, b) AS (VALUES (10, 60), (200, 230), (231, 400))
SELECT DISTINCT doc_id, s, s + 3 AS e FROM o JOIN sp ON s < b AND a < s + 3""".replace("generate_subscripts(ps, 1) AS k, len(ps) AS n, sum(length(unnest))", "k, len(ps) AS n, sum(length(piece))").replace("unnest(ps) FROM m", "unnest(ps) AS piece FROM m"))
def d13_changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a term that touch one of three changed spans of each document."""
    docs = table(spark, sf_dir, "documents")
    spans = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((10, 60), (200, 230), (231, 400))])).alias("x")).select("doc_id", "x.s", "x.e")
    return keywords.overlapping(keywords.literal_offsets(docs, ["doc_id"], "text", "the"), spans, ["doc_id"])


@query("d9_d18_numeric_terms", r"""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '([0-9]{2,9})', 1), lambda x: CAST(x AS DOUBLE)) AS v FROM documents)
SELECT doc_id, len(list_filter(v, lambda x: x > 5000)) > 0 AS large, len(list_filter(v, lambda x: x BETWEEN 100 AND 999)) > 0 AS in_range FROM n""")
def d9_d18_numeric_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", keywords.numeric_hit(text, "([0-9]{2,9})", ">", 5000).alias("large"), keywords.numeric_hit(text, "([0-9]{2,9})", "between", 100, 999).alias("in_range"))


@query("d4_d14_keyword_gate", rf"""WITH {TURN_DELTA}, h AS (SELECT DISTINCT conv_id, turn FROM delta WHERE n_ins > 0 AND regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])the([^\p{{L}}\p{{N}}_]|$)')),
st AS (SELECT p.conv_id, p.turn, coalesce(sum({words("d.text")} * n_ins), 0) AS aw, coalesce(sum({words("d.text")} * n_del), 0) AS rw, coalesce(sum(n_ins + n_del), 0) AS c FROM pairs p LEFT JOIN delta d USING (conv_id, turn) GROUP BY ALL)
SELECT st.conv_id, st.turn, CASE WHEN c = 0 THEN 'reorder_only' WHEN h.conv_id IS NULL THEN 'keyword_miss' END AS reason FROM st LEFT JOIN h ON h.conv_id = st.conv_id AND h.turn = st.turn""")
def d4_d14_keyword_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes pass only with a keyword in an added block; a hit passes any threshold."""
    old, new = turn_pairs(spark, sf_dir)
    diff = delta.block_delta(old, new, ["conv_id", "turn"])
    added = diff.where("n_ins > 0").withColumn("pos", F.lit(0))
    found = keywords.term_hits(added, [("word", "the", "word")], ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.collect_set("term").alias("hits"))
    base = turn_versions(spark, sf_dir).where("outcome = 'stored'").select("conv_id", "turn")
    stats = base.join(delta.delta_stats(diff, ["conv_id", "turn"]), ["conv_id", "turn"], "left").na.fill(0).join(found, ["conv_id", "turn"], "left")
    stats = stats.withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    return delta.gate_changes(stats, 1000, keywords=True).select("conv_id", "turn", "reason")


@query("d19_min_new_items", f"""WITH {TURN_DELTA}, o AS (SELECT DISTINCT conv_id, turn, lower(text) AS t FROM sides WHERE d < 0), n AS (SELECT DISTINCT conv_id, turn, lower(text) AS t FROM sides WHERE d > 0)
SELECT n.conv_id, n.turn, count(*) AS fresh FROM n LEFT JOIN o ON o.conv_id = n.conv_id AND o.turn = n.turn AND o.t = n.t WHERE o.t IS NULL GROUP BY ALL HAVING count(*) >= 3""")
def d19_min_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.min_new_items(*turn_pairs(spark, sf_dir), ["conv_id", "turn"], 3)


_OLD = "SELECT * FROM customer WHERE c_custkey % 10 <> 3"
_NEW = "SELECT * REPLACE (CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal) FROM customer WHERE c_custkey % 10 <> 7"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of all customers: rows that came, went and changed by their key."""
    c = table(spark, sf_dir, "customer")
    moved = F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return c.where("c_custkey % 10 <> 3"), c.where("c_custkey % 10 <> 7").withColumn("c_acctbal", moved)


_EVENTS = f"""ev AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS rid, CASE WHEN o.c_custkey IS NULL THEN 'new' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_acctbal <> n.c_acctbal OR o.c_mktsegment <> n.c_mktsegment THEN 'changed' END AS event
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey)"""


@query("c14_record_events", f"WITH {_EVENTS} SELECT * FROM ev WHERE event IS NOT NULL")
def c14_record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_events(*snapshots(spark, sf_dir), "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("d7_event_gate", f"WITH {_EVENTS} SELECT event, count(*) AS n FROM ev WHERE event IN ('new', 'removed') GROUP BY event")
def d7_event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts for two of the three kinds of event."""
    found = records.record_events(*snapshots(spark, sf_dir), "c_custkey", ["c_mktsegment", "c_acctbal"])
    return found.where(F.col("event").isin("new", "removed")).groupBy("event").agg(F.count("*").alias("n"))


@query("c16_describe_events", f"""WITH {_EVENTS}, e AS (SELECT c_nationkey AS folder, event, CAST(rid AS VARCHAR) AS r FROM ev JOIN customer ON rid = c_custkey WHERE event IS NOT NULL),
k AS (SELECT folder, event, count(*) AS n, list_sort(list(r)) AS ids FROM e GROUP BY ALL),
t AS (SELECT folder, event || ': ' || array_to_string(ids[1:3], ', ') || CASE WHEN n > 3 THEN ' (+' || (n - 3) || ' more)' ELSE '' END AS s FROM k)
SELECT folder, string_agg(s, '; ' ORDER BY s) AS description FROM t GROUP BY folder""")
def c16_describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.record_events(*snapshots(spark, sf_dir), "c_custkey", ["c_mktsegment", "c_acctbal"])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_nationkey").alias("folder"))
    return records.describe_events(found.join(c, "rid"), ["folder"])


_HISTORY = "r AS (SELECT o_custkey * 0 + s AS snap, o_orderkey AS rid, o_orderstatus || CASE WHEN o_orderkey % 7 = s THEN '!' ELSE '' END AS row FROM orders, range(4) t(s) WHERE o_orderkey % 5 <> s)"


@query("c15_record_history", f"""WITH {_HISTORY}, l AS (SELECT *, lag(row) OVER w AS pr, lag(snap) OVER w AS ps FROM r WINDOW w AS (PARTITION BY rid ORDER BY snap)),
c AS (SELECT snap, rid, CASE WHEN ps IS NULL OR ps < snap - 1 THEN 'new' WHEN pr <> row THEN 'changed' END AS event FROM l WHERE snap > 0)
SELECT CAST(snap AS BIGINT) AS snap, rid, event FROM c WHERE event IS NOT NULL UNION ALL SELECT snap + 1, rid, 'removed' FROM r WHERE snap < 3 AND (snap + 1, rid) NOT IN (SELECT (snap, rid) FROM r)""")
def c15_record_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over four snapshots of all orders, each lacking and changing some by key."""
    o = table(spark, sf_dir, "orders").withColumn("snap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    o = o.where("o_orderkey % 5 <> snap")
    row = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 7 == F.col("snap"), "!").otherwise(""))
    return records.record_history(o.select("snap", F.col("o_orderkey").alias("rid"), row.alias("row")), spark.range(4).toDF("snap"))


@query("d15_d16_loose_filters", """SELECT o_orderkey FROM orders WHERE (o_totalprice >= 100000 AND lower(o_orderpriority) IN ('1-urgent', '2-high')) OR (lower(o_orderstatus) = 'p' AND NOT contains(lower(o_orderpriority), 'low') AND starts_with(o_orderpriority, '3'))""")
def d15_d16_loose_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    price = records.loose_cmp(F.format_string("%,.2f", c("o_totalprice")), ">=", "100,000")
    hit = (price & records.in_list(c("o_orderpriority"), ["1-URGENT", "2-High"])) | (records.loose_cmp(c("o_orderstatus"), "=", "p") & ~F.lower("o_orderpriority").contains("low") & c("o_orderpriority").startswith("3"))
    return table(spark, sf_dir, "orders").where(hit).select("o_orderkey")


_VOL = "".join(f" WHEN regexp_matches(o, '{p}') AND regexp_matches(n, '{p}') AND regexp_replace(o, '{p}', '', 'g') = regexp_replace(n, '{p}', '', 'g') THEN '{k}'" for k, p in ((k, "(?i)" + p) for k, p in replay.VOLATILE))
_VPAIRS = """vp AS (SELECT e.event_id, e.user_id, CASE event_id % 4 WHEN 0 THEN 'updated ' || strftime(ts, '%H:%M:%S') WHEN 1 THEN 'day ' || strftime(ts, '%Y-%m-%d') WHEN 2 THEN (event_id % 50 + 1) || ' comments, USD ' || (event_id % 9) ELSE event_type END AS o,
CASE event_id % 4 WHEN 0 THEN 'updated 23:59' WHEN 1 THEN 'day 2025-01-01' WHEN 2 THEN '7 comments, USD 5' ELSE 'just now' END AS n FROM events e)"""


def volatile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line with a clock, a date, a counter or none, and its next version."""
    k = F.col("event_id") % 4
    old = F.when(k == 0, F.concat(F.lit("updated "), F.date_format("ts", "HH:mm:ss"))).when(k == 1, F.concat(F.lit("day "), F.date_format("ts", "yyyy-MM-dd"))).when(k == 2, F.concat((F.col("event_id") % 50 + 1).cast("string"), F.lit(" comments, USD "), (F.col("event_id") % 9).cast("string"))).otherwise(F.col("event_type"))
    new = F.when(k == 0, "updated 23:59").when(k == 1, "day 2025-01-01").when(k == 2, "7 comments, USD 5").otherwise("just now")
    return table(spark, sf_dir, "events").select("event_id", "user_id", old.alias("old_text"), new.alias("new_text"))


@query("c18_volatile_pattern", f"WITH {_VPAIRS} SELECT event_id, CASE{_VOL} END AS pattern FROM vp")
def c18_volatile_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatile_pairs(spark, sf_dir).select("event_id", replay.volatile_pattern(F.col("old_text"), F.col("new_text")).alias("pattern"))


@query("c19_propose_rules", f"""WITH {_VPAIRS}, r AS (SELECT user_id, CASE{_VOL} END AS pattern FROM vp WHERE o <> n), t AS (SELECT user_id, count(*) AS all_pairs, count(pattern) AS solved FROM r GROUP BY 1)
SELECT r.user_id, pattern, count(*) AS pairs, any_value(all_pairs) AS all_pairs, any_value(solved = all_pairs) AS resolves_all FROM r JOIN t ON r.user_id = t.user_id WHERE pattern IS NOT NULL GROUP BY 1, 2""")
def c19_propose_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.propose_rules(volatile_pairs(spark, sf_dir).where("old_text <> new_text"), "user_id")


@query("c17_unstable_blocks", f"""WITH {DOC_BLOCKS}, s AS (SELECT source, doc_id, text FROM doc_blocks JOIN documents d USING (doc_id, text) UNION ALL SELECT d.source, b.doc_id, b.text FROM doc_blocks b JOIN documents d ON b.doc_id = d.doc_id AND b.text <> d.text),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM s GROUP BY 1), h AS (SELECT source, text, count(DISTINCT doc_id) AS has FROM s GROUP BY ALL)
SELECT h.source, text, round(1 - has / n, 9) AS share FROM h JOIN n ON h.source = n.source WHERE has < n""")
def c17_unstable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as samples of one page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = replay.unstable_blocks(doc_blocks(spark, sf_dir).join(docs, "doc_id"), "source", "doc_id")
    return found.withColumn("share", F.round("share", 9))


@query("c12_replay")
def c12_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a threshold of 80 words would have said where 20 stood."""
    keys = ["conv_id", "turn"]
    stats = align.diff_stats(align.align_blocks(stored_pairs(spark, sf_dir), keys), keys)
    verdict = lambda n: delta.gate_changes(stats, n).select(*keys, F.col("reason").alias("verdict"))
    return replay.replay(verdict(20), verdict(80), keys)


@query("d5_word_threshold")
def d5_word_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each change adds, removes and changes along the alignment, and the verdicts of both thresholds."""
    keys = ["conv_id", "turn"]
    stats = align.diff_stats(align.align_blocks(stored_pairs(spark, sf_dir), keys), keys)
    both = delta.gate_changes(stats, 30).withColumnRenamed("reason", "changed_below")
    return delta.gate_changes(both, 30, ignore_removed=True).select(*keys, "added_words", "removed_words", "changed_words", "changed_below", F.col("reason").alias("added_below"))


@query("c12_replay_bodies")
def c12_replay_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ignoring numbered words and a threshold of 40 would have said of all stored turns, where 20 words stood."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turn_versions(spark, sf_dir).where("outcome = 'stored'").select("conv_id", "turn", "latest_at")
    pairs = pairs.join(turns.select("conv_id", "turn", F.col("text").alias("new_text")), ["conv_id", "turn"])
    pairs = pairs.join(turns.select("conv_id", F.col("turn").alias("latest_at"), F.col("text").alias("old_text")), ["conv_id", "latest_at"])
    standing = replay.Config(min_chars=40, min_words=20)
    candidate = replay.Config(ignore=(("(?-i)[a-z]*[0-9]+", "regex"),), min_chars=40, min_words=40)
    return replay.replay_bodies(pairs, ["conv_id", "turn"], standing, candidate)


@query("c19_propose_elements", """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, 'div.ad' AS selector, count(*) FILTER (page_id % 5 <> 0) AS pairs,
count(*) AS all_pairs, bool_and(page_id % 5 <> 0) AS resolves_all FROM pages WHERE contains(html, '<div class="ad">') AND contains(html, '</article>') GROUP BY 1""")
def c19_propose_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with another advertisement, every fifth also with a new paragraph; hosts are the unit of rules."""
    p = table(spark, sf_dir, "pages").where(F.col("html").contains('<div class="ad">') & F.col("html").contains("</article>"))
    ad = F.regexp_replace("html", F.lit('<div class="ad">[^<]*'), F.concat(F.lit('<div class="ad">Offer '), F.col("page_id").cast("string")))
    new = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(ad, "</article>", "<p>one more</p></article>")).otherwise(ad)
    pairs = p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.col("html").alias("old_html"), new.alias("new_html"))
    return replay.propose_elements(pairs, "host", "page_id")


def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of four letters or more of the benchmark as a rule: whole words of even length, substrings of odd length."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))
    terms = table(spark, sf_dir, "benchmark").select(found.alias("term")).where(F.char_length("term") >= 4).distinct()
    kind = F.when(F.char_length("term") % 2 == 0, "word").otherwise("substr")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("near", "int"), ("op", "string"), ("value", "double"))]
    return terms.select(F.col("term").alias("rule"), "term", kind.alias("kind"), F.lit(False).alias("negated"), F.lit(False).alias("page"), F.lit("any").alias("scope"), *empty, F.lit(True).alias("gates"))


@query("d8_rule_rows", rf"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark), r AS (SELECT term FROM b WHERE length(term) >= 4),
d AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents), ws AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS term FROM d),
w AS (SELECT doc_id, term, count(*) AS n FROM ws JOIN r USING (term) WHERE length(term) % 2 = 0 GROUP BY ALL),
s AS (SELECT doc_id, term, (length(t) - length(replace(t, term, ''))) // length(term) AS n FROM d JOIN r ON contains(t, term) WHERE length(term) % 2 = 1)
SELECT doc_id, term AS rule, CAST(n AS BIGINT) AS n FROM (SELECT * FROM w UNION ALL SELECT * FROM s)""")
def d8_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each benchmark word, as a rule row, occurs in each whole document: one automaton, one pass."""
    rules = benchmark_rules(spark, sf_dir)
    found = rulerows.term_matches(table(spark, sf_dir, "documents"), rules, ["doc_id"])
    return found.join(rulerows.with_ids(rules).select("term_id", "rule"), "term_id").groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


SPAN_TERMS = [("the", "word"), ("licensed under", "substr"), ("[0-9]{2,}", "regex"), ("w[a-z]+s", "regex"), ("of the", "word")]
_SPAN_SQL = " UNION ALL ".join(
    rf"SELECT doc_id, '{t}' AS term, string_split_regex(lower(text), '{p}') AS ps, regexp_extract_all(lower(text), '{p}') AS ms FROM documents"
    for t, p in ((t, rf"\b{t}\b" if k == "word" else t) for t, k in SPAN_TERMS)
)


@query("d13_rule_spans", rf"""WITH RECURSIVE m AS ({_SPAN_SQL}),
p AS (SELECT doc_id, term, generate_subscripts(ms, 1) AS k, unnest(ms) AS x, unnest(ps[1:len(ms)]) AS gap FROM m),
o AS (SELECT doc_id, term, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, term ORDER BY k) AS e, length(x) AS n FROM p),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
sp AS (SELECT doc_id, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS a, length(line) AS n FROM l)
SELECT DISTINCT doc_id, term, CAST(e - o.n AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM o JOIN sp USING (doc_id) WHERE k % 2 = 0 AND sp.n > 0 AND e - o.n < a + sp.n AND a < e""")
def d13_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of words, phrases and regular expressions in whole documents that touch every second line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    rules = rulerows.rule_rows(spark, [{"rule": t, "term": t, "kind": k} for t, k in SPAN_TERMS])
    lines = F.split("text", "\n", -1)
    starts = F.transform(F.sequence(F.lit(1), F.size("ls")), lambda i: F.aggregate(F.slice("ls", 1, i - 1), F.lit(0), lambda a, y: a + F.char_length(y) + 1))
    spans = docs.where("text is not null").select("doc_id", lines.alias("ls")).select("doc_id", F.posexplode(F.arrays_zip(starts.alias("s"), "ls")).alias("k", "x")).where("k % 2 = 1")
    spans = spans.select("doc_id", "x.s", (F.col("x.s") + F.char_length("x.ls")).alias("e"))
    found = rulerows.overlapping(rulerows.term_matches(docs, rules, ["doc_id"]), spans, ["doc_id"])
    return found.join(rulerows.with_ids(rules).select("term_id", F.col("rule").alias("term")), "term_id").select("doc_id", "term", "s", "e")


#: Rules of every form; a name says which.
CHANGE_RULES = [
    {"rule": "any", "term": "the", "kind": "word"}, {"rule": "any", "term": "ing"},
    {"rule": "block", "term": "the", "kind": "word", "scope": "block"}, {"rule": "block", "term": "and", "kind": "word", "scope": "block"},
    {"rule": "near", "term": "the", "kind": "word", "scope": "near", "near": 3}, {"rule": "near", "term": "of", "kind": "word", "scope": "near", "near": 3},
    {"rule": "not", "term": "the", "kind": "word"}, {"rule": "not", "term": "tion", "negated": True},
    {"rule": "page", "term": "th"}, {"rule": "page", "term": "from", "kind": "word", "page": True},
    {"rule": "not page", "term": "en"}, {"rule": "not page", "term": "the", "kind": "word", "page": True, "negated": True},
    {"rule": "marked", "term": "[a-z]{12,}", "kind": "regex", "gates": False},
]


@query("d12_rules_on_changes", rf"""WITH {TURN_DELTA}, a AS (SELECT p.conv_id, p.turn, b.pos, lower(b.text) AS t FROM pairs p JOIN blocks b ON b.conv_id = p.conv_id AND b.turn = p.turn
  WHERE NOT EXISTS (SELECT 1 FROM blocks o WHERE o.conv_id = p.conv_id AND o.turn = p.latest_at AND o.text = b.text)),
g AS MATERIALIZED (SELECT conv_id, turn, string_agg(t, chr(10) ORDER BY pos) AS c FROM a GROUP BY ALL),
pg AS (SELECT p.conv_id, p.turn, string_agg(lower(b.text), chr(10) ORDER BY b.pos) AS page FROM pairs p JOIN blocks b ON b.conv_id = p.conv_id AND b.turn = p.turn GROUP BY ALL),
w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT conv_id, turn, regexp_extract_all(c, '\S+') AS ws FROM g)),
nr AS (SELECT DISTINCT x.conv_id, x.turn FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.turn = y.turn AND abs(x.i - y.i) <= 3 WHERE regexp_matches(x.w, '\bthe\b') AND regexp_matches(y.w, '\bof\b')),
f AS (SELECT conv_id, turn, 'any' AS rule FROM g WHERE regexp_matches(c, '\bthe\b') AND contains(c, 'ing')
  UNION ALL SELECT DISTINCT conv_id, turn, 'block' FROM a WHERE regexp_matches(t, '\bthe\b') AND regexp_matches(t, '\band\b')
  UNION ALL SELECT conv_id, turn, 'near' FROM nr
  UNION ALL SELECT conv_id, turn, 'not' FROM g WHERE regexp_matches(c, '\bthe\b') AND NOT contains(c, 'tion')
  UNION ALL SELECT conv_id, turn, 'page' FROM g JOIN pg USING (conv_id, turn) WHERE contains(c, 'th') AND regexp_matches(page, '\bfrom\b')
  UNION ALL SELECT conv_id, turn, 'not page' FROM g JOIN pg USING (conv_id, turn) WHERE contains(c, 'en') AND NOT regexp_matches(page, '\bthe\b')
  UNION ALL SELECT DISTINCT conv_id, turn, 'marked' FROM a WHERE regexp_matches(t, '[a-z]{{12,}}'))
SELECT conv_id, turn, array_to_string(list_sort(list(rule) FILTER (rule <> 'marked')), ',') AS hits, array_to_string(list_sort(list(rule)), ',') AS marks FROM f GROUP BY ALL""".replace(
    "list_sort(list(rule) FILTER (rule <> 'marked'))", "list_sort(coalesce(list(rule) FILTER (rule <> 'marked'), []))"))
def d12_rules_on_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with every scope, negated and page terms, and one for highlighting alone, on the lines that each changed turn has anew."""
    keys = ["conv_id", "turn"]
    old, new = turn_pairs(spark, sf_dir)
    fresh = new.join(old.select(*keys, "text").distinct(), [*keys, "text"], "left_anti")
    changes = fresh.select(*keys, "pos", "text", F.array(F.struct(F.lit(0).alias("s"), F.char_length("text").alias("e"))).alias("spans"))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", delta.joined_blocks(F.col("text")).alias("text"))
    fired = rulerows.fired(changes, rulerows.rule_rows(spark, CHANGE_RULES), keys, ["pos"], pages)
    return rulerows.rule_hits(fired, keys).select(*keys, F.array_join("hits", ",").alias("hits"), F.array_join("marks", ",").alias("marks"))
