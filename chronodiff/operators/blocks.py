"""Page content as ordered text blocks: extraction, markers, special treatments, links, classes of pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.text import decode_entities, normalize_text, text_template
from chronodiff.functions.urls import absolute_url, normalize_url

#: Elements whose content is no text of the page (fixed values).
HIDDEN = ("script", "style", "noscript", "template", "svg", "head", "iframe", "object")
#: Elements that begin and end a block (fixed values).
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|caption|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h1|h2|h3|h4|h5|h6|header|html|li|main|nav|ol|option|p|pre|section|select|summary|table|tbody|tfoot|thead|title|tr|ul|br|hr"
)
#: Patterns and replacements in their order, common to Java's and RE2's dialect.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</(html|body)\s*>", "\x01"),
    *((rf"(?is)<{t}(\s[^>]*)?>.*?</{t}\s*>", "") for t in HIDDEN),
    (r"(?i)</t[dh]\s*>\s*<t[dh](\s[^>]*)?>", " | "),
    (rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>", "\x01"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)


def page_text(html: Column) -> Column:
    """The text of a page with ``\\x01`` between blocks; content after the closing tags is kept."""
    out = html
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return decode_entities(out)


def extract_blocks(df: DataFrame, keys: list[str], html_col: str) -> DataFrame:
    """``keys``, ``pos``, ``text``: the blocks of each page in order; cells of a row are joined by `` | ``."""
    parts = F.filter(F.transform(F.split(page_text(F.col(html_col)), "\x01", -1), normalize_text), lambda x: x != "")
    return df.select(*keys, F.posexplode(parts).alias("pos", "text"))


#: A start tag with quoted values, which may hold ``>``; possessive, so that long ones cost no stack.
_TAG = r"(?i)<{name}(?=[\s/>])(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
_NAME, _VALUE = r"([^\s=>\"'/]+)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", r"[^\s=>\"'/]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def _tags(html: Column, name: str) -> Column:
    """The start tags of the elements of one name (a pattern), in order, outside comments."""
    return F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->", ""), F.lit(_TAG.replace("{name}", name)), 0)


def _attributes(tag: Column) -> Column:
    """Names (in lower case) and values of a start tag's attributes, in order; a value's quotes are still there."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_NAME), 1), lambda x: F.lower(x))
    return F.arrays_zip(names.alias("name"), F.regexp_extract_all(tag, F.lit(_VALUE), 1).alias("value"))


def _attribute(attributes: Column, name: str) -> Column:
    """The first attribute of a name, without quotes, decoded and trimmed; null where it is missing."""
    value = F.get(F.filter(attributes, lambda x: x["name"] == name), F.lit(0))["value"]
    return F.trim(decode_entities(F.regexp_replace(value, "^[\"']|[\"']$", "")))


def _targets(df: DataFrame, keys: list[str], base_col: str, html_col: str, tag: str, names: tuple[str, ...], limit: int, obey: bool) -> DataFrame:
    """Targets of one kind of tag; each step is a column of its own, so that none is computed twice."""
    pages = df.select(*keys, F.col(base_col).alias("_own"), _tags(F.col(html_col), f"(?:{tag}|base|meta)").alias("_tags"))
    kind = lambda t: F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1))
    pages = pages.withColumn("_base", _attributes(F.get(F.filter("_tags", lambda t: kind(t) == "base"), F.lit(0))))
    pages = pages.withColumn("_base", _attribute(F.col("_base"), "href"))
    pages = pages.withColumn("_base", F.when(F.coalesce("_base", F.lit("")) != "", absolute_url(F.col("_own"), F.col("_base"))).otherwise(F.col("_own")))
    if obey:
        robots = F.transform(F.filter("_tags", lambda t: kind(t) == "meta"), _attributes)
        closed = F.exists(robots, lambda m: (F.lower(_attribute(m, "name")) == "robots") & F.lower(_attribute(m, "content")).contains("nofollow"))
        pages = pages.where(~F.coalesce(closed, F.lit(False)))
    rows = pages.select(*keys, "_base", F.posexplode(F.filter("_tags", lambda t: ~kind(t).isin("base", "meta"))).alias("at", "_tag"))
    rows = rows.select(*keys, "_base", "at", _attributes(F.col("_tag")).alias("_tag"))
    href = F.coalesce(*[F.nullif(_attribute(F.col("_tag"), n), F.lit("")) for n in names])
    rows = rows.select(*keys, "_base", "at", href.alias("href")).where("href is not null")
    rows = rows.where(~F.col("href").rlike(r"(?i)^(#|javascript:|mailto:|tel:|data:|sms:)"))
    rows = rows.withColumn("url", absolute_url(F.col("_base"), F.col("href"))).withColumn("url", F.regexp_replace("url", "#.*$", "")).where(F.col("url").rlike("(?i)^https?://"))
    once = rows.groupBy(*keys, "url").agg(F.min("at").alias("at"))
    ranked = once.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("at", "url")))
    return ranked.where(F.col("n") <= limit).select(*keys, "n", "url")


def extract_links(df: DataFrame, keys: list[str], base_col: str, html_col: str, limit: int = 5000) -> DataFrame:
    """``keys``, ``n``, ``url``: absolute link targets in order, each once a page.

    ``<base>`` counts; fragments are cut; only http and https addresses are
    links. A page whose robots meta element says ``nofollow`` has none.
    """
    return _targets(df, keys, base_col, html_col, "a", ("href",), limit, obey=True)


def extract_images(df: DataFrame, keys: list[str], base_col: str, html_col: str, limit: int = 5000) -> DataFrame:
    """``keys``, ``n``, ``url``: absolute addresses of the images of each page in order, each once; ``data-src`` stands in for ``src``."""
    return _targets(df, keys, base_col, html_col, "img", ("src", "data-src"), limit, obey=False)


def page_class(html: Column) -> Column:
    """``empty``, ``js_app`` (a shell that scripts fill), ``little_text`` or ``text``."""
    text = normalize_text(F.regexp_replace(page_text(html), "\x01", " "))
    scripts = F.regexp_count(html, F.lit(r"(?i)<script"))
    shell = html.rlike(r"(?i)<div[^>]*id\s*=\s*[\"'](root|app|__next)[\"']")
    return (
        F.when(html.isNull() | (F.char_length(text) == 0), "empty").when((F.char_length(text) < 200) & (shell | (scripts >= 3)), "js_app").when(F.char_length(text) < 200, "little_text").otherwise("text")
    )


def _marker(words: str | tuple[str, ...]) -> str:
    words = (words,) if isinstance(words, str) else words
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def _between(texts: Column, start: str | tuple[str, ...] | None, end: str | tuple[str, ...] | None, inclusive: bool, keep: bool) -> Column:
    """Parts of a page's blocks inside or outside the ranges.

    The blocks are one text with a separator that no marker contains. One
    pattern finds the ranges in order, each from a start to the next end, and
    puts a mark before and after each; between the marks parts lie inside and
    outside by turns. Of a part that goes only its separators stay, so that
    blocks stay apart.
    """
    first, last = (rf"({_marker(start)})" if start else "(^)"), (rf"({_marker(end)})" if end else "($)")
    body = "(.*?)" if end else "(.*)"
    stays = "\x02$1$2$3\x03" if inclusive else "$1\x02$2\x03$3"
    marked = F.split(F.regexp_replace(F.array_join(texts, "\x01"), rf"(?isu){first}{body}{last}", stays), "[\x02\x03]", -1)
    emptied = lambda x: F.regexp_replace(x, "[^\x01]+", " ")
    parts = F.transform(marked, lambda x, i: F.concat(F.lit(" "), F.when((i % 2 == 1) == F.lit(keep), x).otherwise(emptied(x)), F.lit(" ")))
    cut = F.filter(F.transform(F.split(F.array_join(parts, ""), "\x01", -1), normalize_text), lambda x: x != "")
    return F.when(F.size(marked) > 1, cut).otherwise(F.array().cast("array<string>") if keep else texts)


def keep_between(texts: Column, start: str | tuple[str, ...] | None, end: str | tuple[str, ...] | None, inclusive: bool = False) -> Column:
    """What lies between the markers, again and again, as blocks; the parts of one block are joined by a space.

    Markers (one text, or several that count alike) are found anywhere in a
    block, without regard to case. No start is the start of the page, no end
    its end, once each; a marker that is given and never comes makes no range,
    so a start whose end is missing keeps nothing.
    """
    return _between(texts, start, end, inclusive, True)


def remove_between(texts: Column, start: str | tuple[str, ...] | None, end: str | tuple[str, ...] | None, inclusive: bool = False) -> Column:
    """The blocks without what lies between the markers (see ``keep_between``); blocks that become empty go."""
    return _between(texts, start, end, inclusive, False)


def apply_special(blocks: DataFrame, keys: list[str], sort_content: bool = False, ignore_case: bool = False, links: DataFrame | None = None) -> DataFrame:
    """Blocks with links appended, in lower case, or ordered by text instead of position."""
    out = blocks.select(*keys, "pos", "text")
    if links is not None:
        tail = links.select(*keys, (F.lit(1_000_000) + F.col("n")).alias("pos"), F.col("url").alias("text"))
        out = out.unionByName(tail)
    if ignore_case:
        out = out.withColumn("text", F.lower("text"))
    order = ["text", "pos"] if sort_content else ["pos"]
    return out.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def text_templates(blocks: DataFrame) -> DataFrame:
    """``template``, ``n``: blocks that are equal but for digits and white space."""
    return blocks.groupBy(text_template(F.col("text")).alias("template")).agg(F.count("*").alias("n"))


def marker_uniqueness(blocks: DataFrame, keys: list[str], candidates: DataFrame) -> DataFrame:
    """``keys``, ``marker``, ``hits``, ``first_pos``: where each candidate marker occurs on each page.

    ``candidates`` (``marker``) is a short list of rules; it is broadcast.
    """
    found = blocks.join(F.broadcast(candidates), F.col("text").contains(F.col("marker")))
    times = (F.char_length("text") - F.char_length(F.replace("text", "marker", F.lit("")))) / F.char_length("marker")
    return found.groupBy(*keys, "marker").agg(F.sum(times).cast("long").alias("hits"), F.min("pos").alias("first_pos"))


def scrape_field(text: Column, pattern: str, every: bool = False, limit: int = 2000) -> Column:
    """Group 1 of the first match, or of all joined by `` | ``, cut at ``limit`` characters; null without one."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    value = F.array_join(found, " | ") if every else F.get(found, F.lit(0))
    return F.when(F.size(found) > 0, F.substring(value, 1, limit))


def merge_pages(df: DataFrame, listing: str, n: str, url: str, body: str, max_pages: int = 20) -> DataFrame:
    """The pages of each listing in order up to the first repeated address or body, ``max_pages`` at most."""
    key, digest = normalize_url(F.col(url)), F.sha2(F.col(body), 256)
    seen = df.withColumn("again", (F.row_number().over(W.partitionBy(listing, key).orderBy(n)) > 1) | (F.row_number().over(W.partitionBy(listing, digest).orderBy(n)) > 1))
    order = W.partitionBy(listing).orderBy(n)
    ended = seen.withColumn("ended", F.max(F.col("again").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("page_no", F.row_number().over(order))
    return ended.where((F.col("ended") == 0) & (F.col("page_no") <= max_pages)).drop("again", "ended")
