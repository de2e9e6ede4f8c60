"""Watch lists from bookmark files, tables and lists of addresses: rows with their problems, none lost."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.text import decode_entities, parse_interval

#: Columns of an imported table, by their names without blanks and case.
COLUMNS = ("url", "name", "folder", "interval", "keywords")
_ADDRESS = r"(?:https?|ftps?|file)://\S+"
_TOKEN = r"(?is)<dl[\s>]|</dl\s*>|<h3[^>]*>.*?</h3\s*>|<a\s[^>]*>.*?</a\s*>"


def bookmark_rows(files: DataFrame, file: str, html: str) -> DataFrame:
    """``file``, ``row``, ``url``, ``name``, ``folder`` (path) of the links of nested bookmark files, in order.

    A folder's name stands before the list that it opens. How deep a tag lies is
    a running sum over the list tags; the folders of a link are, for each level
    above it, the last name before it on that level.
    """
    tokens = F.regexp_extract_all(F.col(html), F.lit(_TOKEN), 0)
    rows = files.select(F.col(file).alias("file"), F.posexplode(tokens).alias("pos", "tag"))
    order = W.partitionBy("file").orderBy("pos")
    step = F.when(F.lower("tag").startswith("<dl"), 1).when(F.lower("tag").startswith("</dl"), -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(step).over(order.rowsBetween(W.unboundedPreceding, 0)))
    inner = F.trim(F.regexp_replace(decode_entities(F.regexp_replace("tag", r"(?s)^<[^>]*>|</[^>]*>\s*$|<[^>]*>", "")), r"\s+", " "))
    rows = rows.where(step == 0).select("file", "pos", "depth", F.lower(F.substring("tag", 2, 1)).alias("kind"), inner.alias("label"), "tag")
    heads = rows.where("kind = 'h'").select("file", "pos", F.col("depth").alias("level"), "label", F.lit(False).alias("asks"))
    links = rows.where("kind = 'a'")
    asked = links.select("file", "pos", F.explode(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1)))).alias("level"), F.col("depth").alias("d")).where("level < d").select("file", "pos", "level", F.lit(None).cast("string").alias("label"), F.lit(True).alias("asks"))
    last = F.last("label", ignorenulls=True).over(W.partitionBy("file", "level").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    paths = heads.unionByName(asked).withColumn("name", last).where("asks").groupBy("file", "pos")
    paths = paths.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), "/").alias("folder"))
    url = F.trim(decode_entities(F.regexp_replace(F.regexp_extract("tag", r"(?is)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1), "^[\"']|[\"']$", "")))
    out = links.select("file", "pos", url.alias("url"), F.col("label").alias("name")).join(paths, ["file", "pos"], "left")
    return out.select("file", (F.row_number().over(order)).alias("row"), "url", "name", "folder")


def address_rows(lines: DataFrame, line: str) -> DataFrame:
    """The lines with ``url`` and ``name``: an address anywhere in the line, else a bare host, else the line as it stands.

    Blank lines and comments (``#``, ``//``) go.
    """
    text = F.trim(F.col(line))
    found = F.regexp_extract(text, f"(?i){_ADDRESS}", 0)
    rest = F.concat(F.regexp_extract(text, rf"(?is)^(.*?){_ADDRESS}", 1), F.lit(" "), F.regexp_extract(text, rf"(?is)^.*?{_ADDRESS}(.*)$", 1))
    name = F.nullif(F.regexp_replace(rest, r"^[\s\-,;|]+|[\s\-,;|]+$", ""), F.lit(""))
    url = F.when(found != "", found).when(text.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+(:[0-9]+)?(/\S*)?$"), F.concat(F.lit("https://"), text)).otherwise(text)
    return lines.where((text != "") & ~text.startswith("#") & ~text.startswith("//")).withColumns({"url": url, "name": F.when(found != "", name)})


def table_rows(df: DataFrame) -> DataFrame:
    """A table's columns under the names of ``COLUMNS``; without a ``url`` column it fails. Rows that are blank go."""
    named = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in df.columns}
    if "url" not in named:
        raise ValueError(f"no url column: {df.columns}")
    cols = [(F.col(f"`{named[c]}`").cast("string") if c in named else F.lit(None).cast("string")).alias(c) for c in COLUMNS]
    extra = [F.col(f"`{c}`") for c in df.columns if re.sub(r"[^a-z0-9]", "", c.lower()) not in COLUMNS]
    out = df.select(*extra, *cols)
    return out.where(F.trim(F.concat_ws("", *COLUMNS)) != "")


def read_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV watch list with header (see ``table_rows``); cells may hold line feeds."""
    return table_rows(spark.read.csv(path, header=True, sep=delimiter, multiLine=True, escape='"'))


def folder_path(col: Column) -> Column:
    """``a / b`` as ``a/b``: parts trimmed, empty ones gone; null where nothing is left."""
    parts = F.filter(F.transform(F.split(col, r"[/\\]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


def import_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``url``, ``name``, ``folder``, ``interval``, ``keywords`` read, ``interval_s`` and ``problem`` added; none is left out.

    ``problem`` says what is wrong with a row: ``no address``, ``bad address``
    (no http, https, ftp, ftps or file address) or ``bad interval``.
    """
    absent = [c for c in COLUMNS if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else rows
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    seconds = parse_interval(text("interval"))
    bad = F.when(text("url").isNull(), "no address").when(~text("url").rlike(r"(?i)^(https?|ftps?|file)://[^\s/]*\S+$"), "bad address")
    problem = F.coalesce(bad, F.when(text("interval").isNotNull() & seconds.isNull(), "bad interval"))
    words = F.nullif(F.replace(F.trim("keywords"), F.lit("\r\n"), F.lit("\n")), F.lit(""))
    new = {"url": text("url"), "name": text("name"), "folder": folder_path(F.col("folder")), "interval_s": seconds, "keywords": words, "problem": problem}
    return rows.withColumns(new).drop("interval")


def export_json(pages: DataFrame, folders: DataFrame) -> DataFrame:
    """``kind``, ``id``, ``json``: every folder and page of a watch list as a JSON line; a page's folder is its path.

    ``pages`` has id, name, url, folder, interval_s, keywords; ``folders`` id, parent, name.
    """
    a = folders.select(F.lit("folder").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("id", "parent", "name")).alias("json"))
    fields = ["id", "name", "url", "folder", "interval_s", "keywords"]
    return a.unionByName(pages.select(F.lit("page").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*fields)).alias("json")))
