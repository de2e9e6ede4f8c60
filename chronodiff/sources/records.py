"""Reading snapshots, keyed records, feeds and listings; writing changes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.sources.json_paths import as_list, as_map, selected


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of page versions; filters and columns reach the scan."""
    return spark.read.parquet(path)


def read_records_csv(spark: SparkSession, path: str, id_field: str, delimiter: str = ",") -> DataFrame:
    """A CSV table with header; without the id column it fails rather than read as "all removed"."""
    return assert_shape(spark.read.csv(path, header=True, sep=delimiter), id_field)


def assert_shape(df: DataFrame, id_field: str) -> DataFrame:
    """The table, if it has the id column."""
    if id_field not in df.columns:
        raise ValueError(f"no column {id_field}: {df.columns}")
    return df


def read_records_json(df: DataFrame, keys: list[str], json_col: str, path: str, id_field: str, max_depth: int | None = None) -> DataFrame:
    """``keys``, ``pos``, ``rid``, ``row`` (variant): the rows that a JSON path selects, arrays element by element.

    An object of objects gives a row a field, named by the field where the row
    has no id of its own; any other object is a row. What is no object is
    skipped. A path that matches nothing, or a value that is neither object nor
    array, fails the query rather than read as "all removed".
    """
    found = selected(df, keys, json_col, path, max_depth)
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<struct<key:string,row:variant>>")
    row = lambda key, node: F.struct(key.cast("string").alias("key"), node.alias("row"))

    def rows(x: Column) -> Column:
        node = x["node"]
        items, fields = as_list(node), as_map(node)
        named = (F.size(fields) > 0) & F.forall(F.map_values(fields), lambda v: as_map(v).isNotNull())
        return (
            F.when(items.isNotNull(), F.transform(items, lambda y: row(F.lit(None), y)))
            .when(named, F.transform(F.map_entries(fields), lambda e: row(e["key"], e["value"])))
            .when(fields.isNotNull(), F.array(row(F.lit(None), node)))
            .otherwise(fail(f"{path} does not select rows"))
        )

    every = F.when(F.size("nodes") == 0, fail(f"nothing at {path}")).otherwise(F.flatten(F.transform("nodes", rows)))
    out = found.select(*keys, F.posexplode(F.filter(every, lambda r: as_map(r["row"]).isNotNull())).alias("pos", "r"))
    rid = F.coalesce(F.try_variant_get("r.row", f"$['{id_field}']", "string"), F.col("r.key"))
    return out.select(*keys, "pos", rid.alias("rid"), F.col("r.row").alias("row"))


#: Longest summary of a feed entry (fixed value).
SUMMARY_CHARS = 2000


def _plain(col: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, "<[^>]*>", " "), r"\s+", " "))


def feed_entries(df: DataFrame, keys: list[str], xml_col: str, max_entries: int = 200) -> DataFrame:
    """``keys``, ``pos``, ``entry`` (id, else link, else title), ``title``, ``link``, ``summary`` of RSS items or Atom entries; each entry once.

    Of an Atom entry's links the first without a relation, or of relation
    ``alternate``, counts; its content stands in for a missing summary.
    """
    marked = "struct<_VALUE:string,_type:string>"
    item = "struct<title:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,description:string>"
    entry = f"struct<id:string,title:{marked},link:array<struct<_href:string,_rel:string>>,summary:{marked},content:{marked}>"
    parsed = F.from_xml(F.col(xml_col), f"channel struct<item:array<{item}>>, entry array<{entry}>")

    def one(key: Column, title: Column, link: Column, summary: Column) -> Column:
        return F.struct(F.coalesce(key, link, title).alias("entry"), _plain(title).alias("title"), link.alias("link"), F.substring(_plain(summary), 1, SUMMARY_CHARS).alias("summary"))

    def page_of(links: Column) -> Column:
        return F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]

    rss = F.transform(parsed["channel"]["item"], lambda i: one(i["guid"]["_VALUE"], i["title"], i["link"], i["description"]))
    atom = F.transform(parsed["entry"], lambda e: one(e["id"], e["title"]["_VALUE"], page_of(e["link"]), F.coalesce(e["summary"]["_VALUE"], e["content"]["_VALUE"])))
    rows = df.select(*keys, F.posexplode(F.coalesce(rss, atom)).alias("at", "i")).select(*keys, "at", "i.*")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys, "entry").orderBy("at"))).where("nth = 1")
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy("at"))).where(F.col("pos") <= max_entries).drop("at", "nth")


def listing_blocks(spark: SparkSession, folder: str, limit: int = 5000) -> DataFrame:
    """``name``, ``size``, ``modified`` of the files below a folder, by name; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("name").limit(limit)


def resolve_kind(explicit: Column, content_type: Column, url: Column, head: Column) -> Column:
    """html, json, csv, feed, pdf or text: explicit kind, else content type, else extension, else first bytes."""
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    ext = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\.([A-Za-z0-9]{2,5})([?#].*)?$", 1))
    start = F.lower(F.trim(F.substring(F.coalesce(head, F.lit("")), 1, 64)))
    by_mime = F.when(mime.contains("html"), "html").when(mime.contains("json"), "json").when(mime.contains("csv"), "csv").when(mime.contains("rss") | mime.contains("atom"), "feed").when(mime.contains("pdf"), "pdf")
    by_ext = F.when(ext.isin("html", "htm"), "html").when(ext == "json", "json").when(ext == "csv", "csv").when(ext.isin("rss", "atom", "xml"), "feed").when(ext == "pdf", "pdf").when(ext.isin("txt", "md", "log"), "text")
    by_head = F.when(start.startswith("<!doctype html") | start.startswith("<html"), "html").when(start.startswith("%pdf-"), "pdf").when(start.startswith("<rss") | start.startswith("<?xml"), "feed").when(start.startswith("{") | start.startswith("["), "json")
    return F.coalesce(explicit, by_mime, by_ext, by_head, F.lit("text"))


def dedupe_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``content`` (SHA-256), ``first_id``, ``copies``: equal content once."""
    return df.groupBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


def escape_formula(col: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with an apostrophe before it."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def append_once(new: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` that ``target`` lacks, by key, each once; columns must be the same."""
    if set(new.columns) != set(target.columns):
        raise ValueError(f"columns differ: {sorted(set(new.columns) ^ set(target.columns))}")
    return new.dropDuplicates([key]).join(target.select(key), key, "left_anti").select(target.columns)


def write_changes(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Changes as JSON lines, or as text lines of the column ``text``."""
    (df.select("text").write.text(path) if fmt == "text" else df.write.json(path))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report as csv, json or xml; formula-like texts are escaped in csv."""
    if fmt == "csv":
        texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
        df.select(*[escape_formula(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]).write.csv(path, header=True)
    elif fmt == "json":
        df.write.json(path)
    elif fmt == "xml":
        df.write.option("rowTag", "row").format("xml").save(path)
    else:
        raise ValueError(f"unknown format {fmt}")
