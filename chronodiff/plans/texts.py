"""Queries on texts and pages: extraction, filters, links, addresses, content copies."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.functions import text as T
from chronodiff.functions import urls as U
from chronodiff.operators import blocks as B
from chronodiff.operators import dom
from chronodiff.plans.registry import query
from chronodiff.plans.sql import norm
from chronodiff.session import shared_folder, table
from chronodiff.sources import json_paths as J
from chronodiff.sources import records as R
from chronodiff.sources import sinks


#: Characters that the test pages name; ``&amp;`` is last, so that nothing is decoded twice there.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&amp;", "&"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\x01", "'||chr(1)||'") + "'"


def _page_text_sql(x: str) -> str:
    for pattern, new in B.STEPS:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    for name, char in ENTITIES:
        x = f"replace({x}, {_quoted(name)}, {_quoted(char)})"
    return x


PAGE_BLOCKS = f"""
pt AS (SELECT page_id, string_split({_page_text_sql("html")}, chr(1)) AS ls FROM pages),
pe AS (SELECT page_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM pt),
pn AS (SELECT page_id, p, {norm("line")} AS text FROM pe),
page_blocks AS MATERIALIZED (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INTEGER) AS pos, text FROM pn WHERE text <> '')"""


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extract_blocks(table(spark, sf_dir, "pages"), ["page_id"], "html")


@query("b1_extract_blocks", f"WITH {PAGE_BLOCKS} SELECT * FROM page_blocks")
def b1_extract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(spark, sf_dir)


@query("b2_normalize_text", f"SELECT doc_id, sha256({norm('text')}) AS digest FROM documents")
def b2_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("digest"))


@query("b2_nfkc_text", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def b2_nfkc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On these texts compatibility composition and canonical composition agree."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.nfkc(F.col("text")), 256).alias("digest"))


_URL_SQL = r"""
parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1)) AS sc,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)) AS ho,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3) AS pa,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4) AS qu FROM pages),
urls AS (SELECT page_id, url, sc || '://' || regexp_replace(ho, CASE sc WHEN 'http' THEN ':80$' ELSE ':443$' END, '') || regexp_replace(pa, '/+$', '') || qu AS norm_url,
  regexp_replace(regexp_replace(ho, '^.*@', ''), ':[0-9]+$', '') AS host, sc, pa, ho FROM parts)"""


@query("b16_b17_urls", f"WITH {_URL_SQL} SELECT page_id, norm_url, host, regexp_replace(host, '^www\\.', '') AS host_key FROM urls")
def b16_b17_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(url).alias("norm_url"), U.host_of(url).alias("host"), U.host_key(url).alias("host_key"))


LINKS = _URL_SQL + r""",
hrefs AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages),
he AS (SELECT page_id, generate_subscripts(hs, 1) - 1 AS spot, trim(unnest(hs)) AS href FROM hrefs),
hk AS (SELECT * FROM he WHERE href <> '' AND NOT regexp_matches(href, '(?i)^\s*(#|javascript:|mailto:|tel:|data:)')),
ha AS (SELECT page_id, spot, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN sc || ':' || href
   WHEN starts_with(href, '/') THEN sc || '://' || ho || href WHEN starts_with(href, '?') THEN sc || '://' || ho || pa || href
   ELSE sc || '://' || ho || CASE WHEN regexp_replace(pa, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(pa, '[^/]*$', '') END || href END, '#.*$', '') AS link FROM hk JOIN urls USING (page_id)),
l1 AS (SELECT page_id, link, min(spot) AS spot FROM ha GROUP BY ALL),
links AS MATERIALIZED (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY spot, link) AS INTEGER) AS n, link AS url FROM l1)"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extract_links(table(spark, sf_dir, "pages"), ["page_id"], "url", "html")


@query("b4_extract_links", f"WITH {LINKS} SELECT * FROM links")
def b4_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir)


@query("b4_extract_images", f"WITH {LINKS} SELECT * FROM links")
def b4_extract_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with an image, by its late-loading attribute, in place of each link."""
    html = F.regexp_replace("html", r"(?i)<a\s+href\s*=", "<img alt='' src='' data-src=")
    return B.extract_images(table(spark, sf_dir, "pages").withColumn("html", html), ["page_id"], "url", "html")


@query("b21_pdf_links", f"WITH {LINKS} SELECT page_id, url FROM links WHERE regexp_matches(lower(url), '(\\.pdf|,)([?#].*)?$')")
def b21_pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the end of their path; the test pages have commas where real ones have ``.pdf``."""
    return page_links(spark, sf_dir).where(F.lower("url").rlike(r"(\.pdf|,)([?#].*)?$")).select("page_id", "url")


@query("b5_drop_elements")
def b5_drop_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.drop_elements(table(spark, sf_dir, "pages"), "page_id", "html", [*dom.CONSENT_SELECTORS, ".ad", "nav"])


@query("b6_watch_elements")
def b6_watch_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.watch_elements(table(spark, sf_dir, "pages"), "page_id", "html", ["article > h1", "nav li a"])


@query("b7_scope")
def b7_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text rule limited to elements: digits are masked inside articles and table rows only."""
    found = dom.scoped_blocks(table(spark, sf_dir, "pages"), "page_id", "html", "article, tr, main")
    masked = F.when(F.col("inside"), T.mask_numbers(F.col("text"))).otherwise(F.col("text"))
    return found.select("page_id", "pos", "inside", masked.alias("text"))


@query(
    "b8_between_markers",
    rf"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM l), n AS (SELECT doc_id, p, {norm("line")} AS text FROM e),
pg AS (SELECT doc_id, string_agg(text, chr(1) ORDER BY p) AS page FROM n WHERE text <> '' GROUP BY doc_id),
m AS (SELECT doc_id, string_split_regex(regexp_replace(page, '(?is)(\[|license)(.*?)(\]|copyright)', '\1' || chr(2) || '\2' || chr(3) || '\3', 'g'), '[\x02\x03]') AS parts FROM pg),
s AS (SELECT doc_id, parts, list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN ' ' || x || ' ' ELSE ' ' || regexp_replace(x, '[^\x01]+', ' ', 'g') || ' ' END) AS inn,
      list_transform(parts, lambda x, i: CASE WHEN i % 2 = 1 THEN ' ' || x || ' ' ELSE ' ' || regexp_replace(x, '[^\x01]+', ' ', 'g') || ' ' END) AS outs FROM m),
f AS (SELECT doc_id, len(parts) > 1 AS ranged, string_split(array_to_string(inn, ''), chr(1)) AS a, string_split(array_to_string(outs, ''), chr(1)) AS b, parts FROM s),
c AS (SELECT doc_id, ranged, list_filter(list_transform(a, lambda x: {norm("x")}), lambda x: x <> '') AS kept, list_filter(list_transform(CASE WHEN ranged THEN b ELSE string_split(parts[1], chr(1)) END, lambda x: {norm("x")}), lambda x: x <> '') AS rest FROM f)
SELECT d.doc_id, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept, sha256(coalesce(array_to_string(rest, chr(10)), '')) AS rest FROM documents d LEFT JOIN c USING (doc_id)""",
)
def b8_between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document holds between two markers, again and again, and what is left without it; markers stay outside."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), T.normalize_text), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("texts"))
    digest = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    start, end = ("[", "license"), ("]", "copyright")
    return rows.select("doc_id", digest(B.keep_between(F.col("texts"), start, end)).alias("kept"), digest(B.remove_between(F.col("texts"), start, end)).alias("rest"))


@query("b9_watch_text", "SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)[0-9]{3,}|token'), ' ') AS found FROM documents")
def b9_watch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.watch_text(F.col("text"), "[0-9]{3,}|token").alias("found"))


@query("b10_ignore_text", f"""SELECT doc_id, sha256({norm("regexp_replace(text, '(?i)the.*?of', '', 'g')")}) AS digest FROM documents""")
def b10_ignore_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.ignore_text(F.col("text"), "the*of", "wildcard"), 256).alias("digest"))


@query("b11_mask_numbers", "SELECT doc_id, sha256(CASE WHEN regexp_matches(text, 'token|[+]') THEN regexp_replace(text, '[0-9]', '#', 'g') ELSE text END) AS digest FROM documents")
def b11_mask_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.mask_numbers(F.col("text"), "token|[+]"), 256).alias("digest"))


@query(
    "b12_special",
    f"""WITH {PAGE_BLOCKS}, {LINKS},
a AS (SELECT page_id, pos, lower(text) AS text FROM page_blocks UNION ALL SELECT page_id, 1000000 + n, lower(url) FROM links)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY encode(text), pos) - 1 AS INTEGER) AS pos, text FROM a""",
)
def b12_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.apply_special(page_blocks(spark, sf_dir), ["page_id"], sort_content=True, ignore_case=True, links=page_links(spark, sf_dir))


@query(
    "b15_page_class",
    f"""WITH t AS (SELECT page_id, html, {norm("replace(" + _page_text_sql("html") + ", chr(1), ' ')")} AS text FROM pages)
SELECT page_id, CASE WHEN html IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) < 200 AND (regexp_matches(html, '(?i)<div[^>]*id\\s*=\\s*["''](root|app|__next)["'']')
  OR len(regexp_extract_all(html, '(?i)<script')) >= 3) THEN 'js_app' WHEN length(text) < 200 THEN 'little_text' ELSE 'text' END AS class FROM t""",
)
def b15_page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", B.page_class(F.col("html")).alias("class"))


@query(
    "b18_scrape_fields",
    r"""WITH f AS (SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS a, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS b FROM pages)
SELECT page_id, CASE WHEN len(a) > 0 THEN substr(a[1], 1, 2000) END AS headline, CASE WHEN len(b) > 0 THEN substr(array_to_string(b, ' | '), 1, 2000) END AS targets FROM f""",
)
def b18_scrape_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", B.scrape_field(html, "<h1>([^<]*)</h1>").alias("headline"), B.scrape_field(html, 'href="/([^"]*)"', every=True).alias("targets"))




def _redact_sql(x: str) -> str:
    for pattern, stays in T.REDACTIONS:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(stays.replace('$', chr(92)))}, 'g')"
    return x


_REDACT_SQL = f"SELECT doc_id, sha256({_redact_sql('text')}) AS digest FROM documents"


@query(
    "b19_redact",
    _REDACT_SQL,
)
def b19_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


@query(
    "b20_merge_pages",
    f"""WITH {_URL_SQL},
p AS (SELECT p.page_id, host, norm_url, sha256(html) AS body FROM pages p JOIN urls USING (page_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY host, norm_url ORDER BY page_id) > 1 OR row_number() OVER (PARTITION BY host, body ORDER BY page_id) > 1 AS again FROM p),
e AS (SELECT *, max(CAST(again AS INTEGER)) OVER (PARTITION BY host ORDER BY page_id) AS ended, row_number() OVER (PARTITION BY host ORDER BY page_id) AS page_no FROM a)
SELECT host, page_id, CAST(page_no AS INTEGER) AS page_no FROM e WHERE ended = 0 AND page_no <= 20""",
)
def b20_merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("host", U.host_of(F.col("url")))
    return B.merge_pages(rows, "host", "page_id", "url", "html").select("host", "page_id", "page_no")


@query("b22_text_templates", f"WITH {PAGE_BLOCKS} SELECT regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[ \\t\\n\\r\\f\\x{{00a0}}]+', ' ', 'g') AS template, count(*) AS n FROM page_blocks GROUP BY 1")
def b22_text_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.text_templates(page_blocks(spark, sf_dir))


@query(
    "b23_marker_uniqueness",
    f"""WITH {PAGE_BLOCKS}, c(marker) AS (VALUES ('©'), ('the'), ('In'))
SELECT page_id, marker, CAST(sum((length(text) - length(replace(text, marker, ''))) / length(marker)) AS BIGINT) AS hits, min(pos) AS first_pos
FROM page_blocks JOIN c ON contains(text, marker) GROUP BY ALL""",
)
def b23_marker_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = spark.createDataFrame([("©",), ("the",), ("In",)], "marker string")
    return B.marker_uniqueness(page_blocks(spark, sf_dir), ["page_id"], candidates)


@query(
    "a8_resolve_kind",
    r"""SELECT page_id, CASE WHEN contains(coalesce(ct, ''), 'html') THEN 'html' WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext = 'json' THEN 'json' WHEN ext IN ('rss', 'atom', 'xml') THEN 'feed'
 WHEN starts_with(head, '<!doctype html') OR starts_with(head, '<html') THEN 'html' ELSE 'text' END AS kind
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' END AS ct, lower(regexp_extract(url, '\.([A-Za-z0-9]{2,5})([?#].*)?$', 1)) AS ext, lower(trim(substr(html, 1, 64))) AS head FROM pages)""",
)
def a8_resolve_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8")
    return table(spark, sf_dir, "pages").select("page_id", R.resolve_kind(F.lit(None).cast("string"), mime, F.col("url"), F.col("html")).alias("kind"))


@query("a14_dedupe_content", "SELECT sha256(coalesce(text, '')) AS content, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def a14_dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_content(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("a1_snapshot_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages WHERE contains(url, 'example.com')")
def a1_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of one domain; filter and columns reach the scan."""
    rows = R.read_snapshots(spark, f"{sf_dir}/pages.parquet")
    return rows.where(F.col("url").contains("example.com")).select("page_id", "url", F.char_length("html").cast("long").alias("n_chars"))


@query("a6_json_blocks", "SELECT event_id, k AS name, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def a6_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.json_leaves(table(spark, sf_dir, "events"), ["event_id"], "props").drop("pos")


@query(
    "a2_records_json",
    "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, CAST(event_id AS VARCHAR) AS rid, event_type AS kind FROM events",
)
def a2_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one JSON document, read back as keyed rows by path."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.struct(rows.alias("rows")).alias("data"))).alias("body"))
    found = R.read_records_json(docs, ["user_id"], "body", "$.data.rows", "event_id")
    return found.select("user_id", "pos", "rid", F.try_variant_get("row", "$.event_type", "string").alias("kind"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a nested JSON document: its key, and its lines with their parts."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.col("l_partkey").alias("key")).alias("part"))
    lines = F.sort_array(F.collect_list(line))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    return rows.select("l_orderkey", F.to_json(F.struct(F.struct("lines", F.col("l_orderkey").alias("key")).alias("order"))).alias("body"))


JSON_PATHS = ("$.order.lines[*].part.key", "$..key", "$.order.*", "$['order'][\"lines\"][0].n", "$.order.lines[-1].n", "$.order.lines[*].*")
_LINE = """'{"n":' || l_linenumber || ',"part":{"key":' || l_partkey || '}}'"""


@query(
    "a2_json_paths",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS i, {_LINE} AS j FROM lineitem),
o AS (SELECT l_orderkey, '[' || string_agg(j, ',' ORDER BY i) || ']' AS lines, max(i) AS top FROM l GROUP BY 1)
SELECT l_orderkey, 0 AS path, i AS pos, CAST(l_partkey AS VARCHAR) AS value FROM l
UNION ALL SELECT l_orderkey, 1, 0, CAST(l_orderkey AS VARCHAR) FROM o UNION ALL SELECT l_orderkey, 1, i + 1, CAST(l_partkey AS VARCHAR) FROM l
UNION ALL SELECT l_orderkey, 2, 0, CAST(l_orderkey AS VARCHAR) FROM o UNION ALL SELECT l_orderkey, 2, 1, lines FROM o
UNION ALL SELECT l_orderkey, 3, 0, CAST(l_linenumber AS VARCHAR) FROM l WHERE i = 0
UNION ALL SELECT l.l_orderkey, 4, 0, CAST(l_linenumber AS VARCHAR) FROM l JOIN o USING (l_orderkey) WHERE i = top
UNION ALL SELECT l_orderkey, 5, 2 * i, CAST(l_linenumber AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, 5, 2 * i + 1, '{{"key":' || l_partkey || '}}' FROM l""",
)
def a2_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with every kind of step on all orders."""
    docs = order_documents(spark, sf_dir)
    found = J.json_paths(docs, ["l_orderkey"], "body", list(JSON_PATHS), max_depth=4)
    return found.select("l_orderkey", "path", "pos", J.json_text(F.col("node")).alias("value"))


@query(
    "a6_json_lines",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
o AS (SELECT l_orderkey, ['{', '"order": {', '"key": ' || l_orderkey || ',', '"lines": ['] || flatten(list(['{', '"n": ' || l_linenumber || ',', '"part": {', '"key": ' || l_partkey, '}', CASE WHEN i < n THEN '},' ELSE '}' END] ORDER BY i)) || [']', '}', '}'] AS ls FROM l GROUP BY 1)
SELECT l_orderkey, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos, unnest(ls) AS text FROM o""",
)
def a6_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents as lines, a field a line, fields by name."""
    return order_documents(spark, sf_dir).select("l_orderkey", F.posexplode(J.json_lines(F.col("body"))).alias("pos", "text"))


@query(
    "a6_n4_json_leaves",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem)
SELECT DISTINCT l_orderkey, 'order.key' AS name, CAST(l_orderkey AS VARCHAR) AS value FROM l UNION ALL SELECT l_orderkey, 'order.lines[' || i || '].n', CAST(l_linenumber AS VARCHAR) FROM l
UNION ALL SELECT l_orderkey, 'order.lines[' || i || '].part.key', CAST(l_partkey AS VARCHAR) FROM l""",
)
def a6_n4_json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of nested documents by its path."""
    return J.json_leaves(order_documents(spark, sf_dir), ["l_orderkey"], "body", max_depth=5).drop("pos")


@query("n4_merge_json", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"meta":{"kind":"' || event_type || '","user":' || user_id || '},"n":{"deep":{"a":1,"b":' || (event_id % 3) || '}}}' AS merged FROM events""")
def n4_merge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties over defaults, merged at depth and written with fields by name."""
    base = F.parse_json(F.lit('{"meta": {"user": 0, "kind": "none"}, "n": {"deep": {"a": 1, "b": 7}}}'))
    own = F.to_json(F.struct(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("meta"), F.struct(F.struct((F.col("event_id") % 3).alias("b")).alias("deep")).alias("n")))
    merged = J.deep_merge(J.deep_merge(base, F.parse_json("props")), F.parse_json(own))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(merged).alias("merged"))


@query(
    "a5_feed_entries",
    """WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host, url ORDER BY page_id) AS nth FROM h)
SELECT host, url AS entry, 'Page ' || page_id AS title, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS INTEGER) AS pos FROM r WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 200""",
)
def a5_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each host as an RSS feed, read back as entries."""
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), safe, F.lit("</link></item>"))
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", item.alias("item"))
    # a second, repeated item keeps single-item feeds an array
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "")
    feeds = rows.groupBy("host").agg(F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")).alias("body"))
    return R.feed_entries(feeds, ["host"], "body").select("host", "entry", "title", F.col("pos"))


@query(
    "a11_append_once",
    """SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[=+@-]') THEN '''' || x ELSE x END AS comment
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '=' || o_orderpriority ELSE o_orderpriority END AS x FROM orders WHERE o_orderkey % 10 <> 7) WHERE o_orderkey % 10 = 3""",
)
def a11_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second delivery adds to a target that lacks every tenth order; formula-like values escaped."""
    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("="), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    rows = orders.select("o_orderkey", R.escape_formula(value).alias("comment"))
    return R.append_once(rows.where("o_orderkey % 10 <> 7"), rows.where("o_orderkey % 10 <> 3"), "o_orderkey")


@query(
    "n5_parse_number",
    r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(o_totalprice AS VARCHAR) WHEN 2 THEN 'EUR ' || replace(CAST(o_totalprice AS VARCHAR), '.', ',')
  WHEN 3 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.5 now' ELSE 'none' END AS t, o_totalprice AS p FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN floor(p) WHEN 1 THEN p WHEN 2 THEN p WHEN 3 THEN 1000 + o_orderkey % 1000 + 0.5 END AS value FROM x""",
)
def n5_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    text = (
        F.when(key % 5 == 0, F.concat(F.lit("$"), F.floor(price).cast("string")))
        .when(key % 5 == 1, F.format_string("%.2f", price))
        .when(key % 5 == 2, F.concat(F.lit("EUR "), F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(","))))
        .when(key % 5 == 3, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5 now")))
        .otherwise("none")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_number(text).alias("value"))


@query(
    "n6_intervals",
    """WITH x AS (SELECT p_partkey, p_size, ['s', 'm', 'h', 'd', 'w', ''][p_partkey % 6 + 1] AS u FROM part),
s AS (SELECT *, greatest(p_size * CASE u WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 ELSE 1 END, 60) AS sec FROM x)
SELECT p_partkey, CAST(sec AS BIGINT) AS seconds, CASE WHEN sec % 604800 = 0 THEN (sec // 604800) || 'w' WHEN sec % 86400 = 0 THEN (sec // 86400) || 'd' WHEN sec % 3600 = 0 THEN (sec // 3600) || 'h'
  WHEN sec % 60 = 0 THEN (sec // 60) || 'm' ELSE sec || 's' END AS text FROM s""",
)
def n6_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "w", "")]), (F.col("p_partkey") % 6).cast("int"))
    seconds = T.parse_interval(F.concat(F.col("p_size").cast("string"), unit))
    return table(spark, sf_dir, "part").select("p_partkey", seconds.alias("seconds"), T.fmt_interval(seconds).alias("text"))


@query("c13_rebuild", f"SELECT doc_id, sha256(lower({norm(chr(34) + 'text' + chr(34))})) AS digest FROM (SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS text FROM documents)")
def c13_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts normalised again after a filter edit that masks numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(T.normalize_text(T.mask_numbers(F.col("text")))), 256).alias("digest"))




DATE_FORMATS = ("%Y-%m-%d", "%d %b %y, %H:%M:%S", "it's %A, %B %d", "100%% %j %I %p")


@query("n2_date_formats", "SELECT o_orderkey, " + ", ".join("strftime(o_orderdate, '{}') AS d{}".format(f.replace("'", "''"), k) for k, f in enumerate(DATE_FORMATS)) + " FROM orders")
def n2_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *[T.format_date(F.col("o_orderdate"), f).alias(f"d{k}") for k, f in enumerate(DATE_FORMATS)])


@query("a3_csv_records", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a3_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a CSV table and read back as keyed records."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").write.csv(path, header=True)
    return R.read_records_csv(spark, path, "c_custkey").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("a9_change_sink", "SELECT event_id, event_type, CAST(event_id % 3 AS INTEGER) AS batch FROM events")
def a9_change_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes, written in three batches by kind, one of which comes twice."""
    path = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 1):
        sinks.write_batch(table(spark, sf_dir, "events").where(F.col("event_id") % 3 == batch).select("event_id", "event_type"), path, batch, ("event_type",))
    return sinks.read_batches(spark, path).select("event_id", "event_type", "batch")


@query("a10_report_csv", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 3 WHEN 0 THEN '''=' || c_name WHEN 1 THEN '''-' || c_name ELSE c_name END AS name FROM customer")
def a10_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV: names that a spreadsheet would compute stand behind an apostrophe."""
    path, key = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}", F.col("c_custkey")
    sign = F.when(key % 3 == 0, "=").when(key % 3 == 1, "-").otherwise("")
    R.write_report(table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(sign, "c_name").alias("name")), path)
    return spark.read.csv(path, header=True)
