"""Nodes of JSON documents by path, their leaves and lines, and merging: VARIANT columns, no user function, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(
    r"""\.\.(?P<descend>[\w$-]+) | \.(?P<star>\*) | \.(?P<name>[\w$-]+)
      | \[\s*(?:(?P<any>\*) | (?P<index>-?\d+) | '(?P<single>[^']*)' | "(?P<double>[^"]*)")\s*\]""",
    re.VERBOSE,
)


def path_steps(path: str) -> list[tuple[str, str | int | None]]:
    """(key, name), (index, n), (wildcard, None) or (descend, name) for each step of ``$.a['b'][0][-1][*].*..c``."""
    at, out = 1 if path.startswith("$") else 0, []
    text = path if at else "." + path
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None:
            raise ValueError(f"path {path!r}: cannot read {text[at:]!r}")
        got = m.groupdict()
        if got["descend"] is not None:
            out.append(("descend", got["descend"]))
        elif got["star"] or got["any"]:
            out.append(("wildcard", None))
        elif got["index"] is not None:
            out.append(("index", int(got["index"])))
        else:
            out.append(("key", next(got[k] for k in ("name", "single", "double") if got[k] is not None)))
        at = m.end()
    return out


def as_list(node: Column) -> Column:
    """The elements of a variant that is an array, else null."""
    return F.try_variant_get(node, "$", "array<variant>")


def as_map(node: Column) -> Column:
    """The fields of a variant that is an object, else null."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def nesting(text: Column) -> Column:
    """How deep objects and arrays of a JSON text lie in each other."""
    marks = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), F.lit(r"[\[\]{}]"), 0)
    step = lambda a, m: F.struct((a["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["top"], a["now"] + 1).alias("top"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda a: a["top"])


def _depth(df: DataFrame, json_col: str, max_depth: int | None) -> int:
    return max_depth if max_depth is not None else int(df.agg(F.max(nesting(F.col(json_col)))).first()[0] or 0)


def _children(x: Column) -> Column:
    """A node's elements or fields in order, each with its path."""
    own = F.coalesce(as_list(x["node"]), F.map_values(as_map(x["node"])))
    step = lambda y, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), y.alias("node"))
    return F.coalesce(F.transform(own, step), F.array().cast("array<struct<path:array<int>,node:variant>>"))


def _in_order(nodes: Column) -> Column:
    """Nodes by path; the paths are sorted with their places, in Spark's own order, which no function compares."""
    places = F.sort_array(F.transform(nodes, lambda x, i: F.struct(x["path"].alias("path"), i.alias("i"))))
    return F.transform(places, lambda p: F.get(nodes, p["i"]))


def _direct(name: str | int) -> str | None:
    """A step to a field or an element as a variant path says it; null if it cannot."""
    if isinstance(name, int):
        return f"[{name}]" if name >= 0 else None
    quote = next((q for q in "'\"" if q not in name), None)
    return f"[{quote}{name}{quote}]" if name and quote else None


def _walk(rows: DataFrame, out: str, path: str, depth: int) -> DataFrame:
    """``rows`` with ``out``: what the path selects in the variant ``node``, as an array of ``path`` and ``node``."""
    kind_of = "array<struct<path:array<int>,node:variant>>"
    there = lambda xs: F.filter(xs, lambda x: x["node"].isNotNull())
    each = lambda xs, get: there(F.transform(xs, lambda x: F.struct(x["path"].alias("path"), get(x["node"]).alias("node"))))
    rows = rows.withColumn(out, F.when(F.col("node").isNull(), F.array().cast(kind_of)).otherwise(F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col("node").alias("node")))))
    found, straight = F.col(out), ""
    for kind, value in [*path_steps(path), ("end", None)]:
        step = _direct(value) if kind in ("key", "index") else None
        if step is not None:
            straight += step
            continue
        if straight:  # fields and elements below each other are one look into the variant
            found, straight = each(found, lambda n, at=straight: F.try_variant_get(n, "$" + at, "variant")), ""
        if kind == "key":
            found = each(found, lambda n, at=value: F.try_element_at(as_map(n), F.lit(at)))
        elif kind == "index":
            found = each(found, lambda n, at=value: F.try_element_at(as_list(n), F.lit(at)))
        elif kind == "wildcard":
            found = F.flatten(F.transform(found, _children))
        elif kind == "descend":
            kept = [c for c in rows.columns if c != out]
            rows = rows.select(*kept, found.alias("level"), F.array().cast(kind_of).alias(out))
            match = lambda x, at="$" + _direct(value): F.struct(F.concat(x["path"], F.array(F.lit(-1))).alias("path"), F.try_variant_get(x["node"], at, "variant").alias("node"))
            for _ in range(depth + 1):  # the match of a node comes before those below it
                rows = rows.select(*kept, F.concat(out, there(F.transform("level", lambda x: match(x)))).alias(out), F.flatten(F.transform("level", _children)).alias("level"))
            found = _in_order(F.col(out))
    return rows.select(*[c for c in rows.columns if c not in (out, "level")], found.alias(out))


def selected(df: DataFrame, keys: list[str], json_col: str, path: str, max_depth: int | None = None) -> DataFrame:
    """``keys``, ``nodes``: what a JSON path selects in each document, in document order, as an array of ``path`` and ``node`` (variant).

    Steps: ``.name``, ``['name']``, ``[n]`` (from the end if negative), ``[*]``
    and ``.*`` (elements or fields), ``..name`` (at any depth). Fields count in
    order of their names. ``..`` walks level by level, as deep as ``max_depth``
    or as the deepest document lies, which is then looked for first. A text that
    is no JSON, and null, select nothing.
    """
    rows = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("node")).where("node is not null")
    return _walk(rows, "nodes", path, _deepest(df, json_col, [path], max_depth)).select(*keys, "nodes")


def _deepest(df: DataFrame, json_col: str, paths: list[str], max_depth: int | None) -> int:
    return _depth(df, json_col, max_depth) if any(kind == "descend" for path in paths for kind, _ in path_steps(path)) else 0


def json_paths(df: DataFrame, keys: list[str], json_col: str, paths: list[str], max_depth: int | None = None) -> DataFrame:
    """``keys``, ``path`` (its place in the list), ``pos``, ``node`` (variant): a row for each node that each path selects (see ``selected``).

    A document is read and parsed once for all paths.
    """
    depth = _deepest(df, json_col, paths, max_depth)
    rows = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("node"))
    for k, path in enumerate(paths):
        rows = _walk(rows, f"nodes{k}", path, depth)
    named = lambda k: F.transform(f"nodes{k}", lambda x, i: F.struct(F.lit(k).alias("path"), i.alias("pos"), x["node"].alias("node")))
    found = rows.select(*keys, F.explode(F.concat(*map(named, range(len(paths))))).alias("x"))
    return found.select(*keys, "x.path", "x.pos", "x.node")


def json_nodes(df: DataFrame, keys: list[str], json_col: str, path: str, max_depth: int | None = None) -> DataFrame:
    """``keys``, ``pos``, ``node`` (variant): a row for each node that the path selects (see ``selected``)."""
    return json_paths(df, keys, json_col, [path], max_depth).select(*keys, "pos", "node")


def json_leaves(df: DataFrame, keys: list[str], json_col: str, max_depth: int | None = None) -> DataFrame:
    """``keys``, ``pos``, ``name``, ``value``: every scalar of a JSON document, however deep, fields by name.

    ``name`` is its path (``a.b[0].c``). An empty object or array is a leaf.
    """
    start = F.array(F.struct(F.lit("").alias("name"), F.col("node").alias("node"), F.lit(False).alias("leaf")))
    rows = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("node")).where("node is not null").select(*keys, start.alias("nodes"))
    some = lambda xs: F.get(F.filter(F.array(xs), lambda own: F.size(own) > 0), 0)

    def below(x: Column) -> Column:
        """A node's fields or elements in its place; a leaf stays."""
        dotted = lambda k: F.when(x["name"] == "", k).otherwise(F.concat(x["name"], F.lit("."), k))
        step = lambda name, node: F.struct(name.alias("name"), node.alias("node"), F.lit(False).alias("leaf"))
        fields = F.transform(F.map_entries(as_map(x["node"])), lambda e: step(dotted(e["key"]), e["value"]))
        items = F.transform(as_list(x["node"]), lambda y, i: step(F.concat(x["name"], F.lit("["), i.cast("string"), F.lit("]")), y))
        leaf = F.array(F.struct(x["name"].alias("name"), x["node"].alias("node"), F.lit(True).alias("leaf")))
        return F.when(x["leaf"], leaf).otherwise(F.coalesce(some(fields), some(items), leaf))

    for _ in range(_depth(df, json_col, max_depth) + 1):
        rows = rows.select(*keys, F.flatten(F.transform("nodes", below)).alias("nodes"))
    rows = rows.select(*keys, F.posexplode(F.filter("nodes", lambda x: x["leaf"])).alias("pos", "x"))
    return rows.select(*keys, "pos", F.col("x.name").alias("name"), json_text(F.col("x.node")).alias("value"))


def json_text(node: Column) -> Column:
    """A variant as text: scalars as they are, objects and arrays as JSON with fields by name and no blanks."""
    return node.cast("string")


def sorted_json(text: Column) -> Column:
    """A JSON text with fields by name and no blanks, so that equal documents are equal texts; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def json_lines(text: Column) -> Column:
    """The trimmed lines of a JSON text laid out with one field or element a line, fields by name.

    A change of one field is a change of one line. A text that is no JSON gives its own lines.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    line = rf'[}}\]],?|(?:{string}:)?(?:(?:\{{\}}|\[\]|{string}|[^\[\]{{}},:"]++),?|[{{\[])'
    laid = F.transform(F.regexp_extract_all(sorted_json(text), F.lit(line), 0), lambda x: F.regexp_replace(x, f"^({string}):", "$1: "))
    own = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(laid, own)


def deep_merge(base: Column, over: Column, depth: int = 8) -> Column:
    """Two variants as one: objects are merged field by field, ``depth`` levels deep, and whatever else ``over`` has replaces."""
    if depth == 0:
        return over
    a, b = as_map(base), as_map(over)
    field = lambda k, x, y: F.when(y.isNull(), x).when(x.isNull(), y).otherwise(deep_merge(x, y, depth - 1))  # noqa: E731, ARG005
    return F.when(a.isNotNull() & b.isNotNull(), F.to_variant_object(F.map_zip_with(a, b, field))).otherwise(over)
