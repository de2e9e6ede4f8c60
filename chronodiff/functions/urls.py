"""Column functions on web addresses; malformed ones never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(col: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(col), _PARTS, n)


def normalize_url(col: Column) -> Column:
    """Scheme and host (not user and password) in lower case, without default port, fragment and trailing slash; the query stays."""
    scheme, path, query = F.lower(_part(col, 1)), _part(col, 3), _part(col, 4)
    user, host = F.regexp_extract(_part(col, 2), "^(.*@)?", 1), F.lower(F.regexp_replace(_part(col, 2), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    joined = F.concat(scheme, F.lit("://"), user, host, F.regexp_replace(path, "/+$", ""), query)
    return F.when(scheme == "", F.trim(col)).otherwise(joined)


def host_of(col: Column) -> Column:
    """Host in lower case without port and user; ``local`` where an address has none."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(col, 2)), "^.*@", ""), ":[0-9]+$", "")
    return F.when(host == "", F.lit("local")).otherwise(host)


def host_key(col: Column) -> Column:
    """The host without a leading ``www.``: what politeness and capacity are counted by."""
    return F.regexp_replace(host_of(col), r"^www\.", "")


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``: absolute, protocol-relative, rooted, query-only and relative forms."""
    root = F.concat(F.lower(_part(base, 1)), F.lit("://"), F.lower(_part(base, 2)))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lower(_part(base, 1)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, _part(base, 3), href))
        .otherwise(F.concat(root, folder, href))
    )
