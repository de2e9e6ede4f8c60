"""Column functions on text: normalising, counting, masking, numbers and interval texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Zero-width and formatting characters that a reader does not see (fixed values).
INVISIBLE = "[­​‌‍⁠﻿]"
SPACE = r"[ \t\n\r\f\x{00a0}]+"
#: Seconds of an interval's unit (fixed values).
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def normalize_text(col: Column) -> Column:
    """White space collapsed to single spaces, invisible characters gone, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, INVISIBLE, ""), SPACE, " "))


def nfkc(col: Column) -> Column:
    """Compatibility composition; only texts beyond ASCII leave the JVM."""

    @F.pandas_udf("string")
    def compose(s):  # noqa: ANN001, ANN202
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(compose(col))


def _entities() -> Column:
    """A map from the names of characters, as HTML defines them, to what they stand for; one constant of a plan."""
    from html.entities import html5

    named = [(name[:-1], chars) for name, chars in html5.items() if name.endswith(";")]
    names, chars = (F.split(F.lit("\x00".join(side)), "\x00", -1) for side in zip(*named, strict=True))
    return F.map_from_arrays(names, chars)


#: Names that most references have (fixed values).
COMMON_NAMES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"))


def decode_entities(col: Column) -> Column:
    """Character references, named or numeric, as the characters they stand for, once; unknown ones stay as they are.

    Only texts with an ampersand are taken apart.
    """
    names = _entities()
    def decoded(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substring(part, F.char_length(ref) + 2, F.lit(1 << 30))
        number = F.when(F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7)).try_cast("int")
        sound = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        value = F.when(ref.startswith("#"), F.when(sound, char))
        for name, common in COMMON_NAMES:  # a map is searched from its start
            value = value.when(ref == name, common)
        value = value.when(ref != "", F.try_element_at(names, ref))
        return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), part))

    def whole(text: Column) -> Column:
        parts = F.split(text, "&", -1)
        joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
        return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)

    # bound to a name, so that whatever makes the text is computed once
    return F.get(F.transform(F.array(col), whole), F.lit(0))


def count_words(col: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def wildcard_to_regex(pattern: str) -> str:
    """``*`` is any text, as short as possible but at the end; ``?`` is one character; the rest is literal."""
    parts = re.split(r"([*?])", pattern)
    out = []
    for k, part in enumerate(parts):
        last = not any(parts[k + 1 :])
        out.append({"*": ".*" if last else ".*?", "?": "."}.get(part, re.escape(part)))
    return "".join(out)


def pattern_regex(pattern: str, kind: str = "literal", ignore_case: bool = True) -> str:
    """A regular expression for a ``literal``, ``wildcard`` or ``regex`` rule."""
    body = {"literal": re.escape, "wildcard": wildcard_to_regex, "regex": str}[kind](pattern)
    return f"(?i){body}" if ignore_case else body


def ignore_text(col: Column, pattern: str, kind: str = "literal", ignore_case: bool = True) -> Column:
    """The text without what the rule matches, normalised again; drop blocks that become empty."""
    return normalize_text(F.regexp_replace(col, pattern_regex(pattern, kind, ignore_case), ""))


def watch_text(col: Column, pattern: str, kind: str = "regex", ignore_case: bool = True) -> Column:
    """Only what the rule matches, matches joined by a space."""
    found = F.regexp_extract_all(col, F.lit(pattern_regex(pattern, kind, ignore_case)), 0)
    return F.array_join(found, " ")


def mask_numbers(col: Column, pattern: str | None = None) -> Column:
    """Digits become ``#``: everywhere, or in texts where ``pattern`` matches."""
    masked = F.regexp_replace(col, "[0-9]", "#")
    return masked if pattern is None else F.when(col.rlike(pattern), masked).otherwise(col)


def text_template(col: Column) -> Column:
    """Runs of digits as ``#`` and white space as one space: what equal blocks with other numbers share."""
    return F.regexp_replace(F.regexp_replace(col, "[0-9]+", "#"), SPACE, " ")


#: Blanks that group digits: space, no-break space, narrow no-break space, thin space (fixed values).
BLANK = r" \x{00a0}\x{202f}\x{2009}"


def parse_number(col: Column) -> Column:
    """The first number of a text as double: ``1,099`` ``1.099,50`` ``12.5`` ``1,5``; null without one.

    With both marks, the later one is the decimal mark; a single comma or point
    with exactly three digits behind and at most three before groups thousands
    if it is a comma; other single commas are decimal marks. Blanks, no-break
    ones too, may stand between groups of three digits: ``1 299,50``.
    """
    raw = F.regexp_extract(col, rf"[-+]?[0-9]{{1,3}}(?:[{BLANK}][0-9]{{3}})+(?![0-9])[0-9.,]*|[-+]?[0-9][0-9.,]*", 0)
    raw = F.regexp_replace(raw, f"[{BLANK}]", "")
    raw = F.regexp_replace(raw, r"[.,]+$", "")
    comma, point = F.instr(F.reverse(raw), ","), F.instr(F.reverse(raw), ".")
    plain = (
        F.when((comma > 0) & (point > 0) & (comma < point), F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", "."))
        .when((comma > 0) & (point > 0), F.regexp_replace(raw, ",", ""))
        .when(raw.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})+$"), F.regexp_replace(raw, ",", ""))
        .when(raw.rlike(r"^[-+]?[0-9]{1,3}(\.[0-9]{3}){2,}$"), F.regexp_replace(raw, r"\.", ""))
        .otherwise(F.regexp_replace(raw, ",", "."))
    )
    return plain.try_cast("double")


def parse_interval(col: Column) -> Column:
    """Seconds of ``90s 15m 2h 1d 1w`` (bare numbers are seconds), at least 60; null if it is none."""
    number = F.regexp_extract(F.lower(F.trim(col)), r"^([0-9]+) ?([smhdw]?)$", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(F.trim(col)), r"^([0-9]+) ?([smhdw]?)$", 2)
    factor = F.lit(1)
    for name, seconds in UNITS.items():
        factor = F.when(unit == name, F.lit(seconds)).otherwise(factor)
    return F.when(number.isNotNull(), F.greatest(number * factor, F.lit(60)))


def fmt_interval(col: Column) -> Column:
    """The largest unit that divides the seconds."""
    out = F.concat(col.cast("string"), F.lit("s"))
    for name in ("m", "h", "d", "w"):
        out = F.when(col % UNITS[name] == 0, F.concat((col / UNITS[name]).cast("long").cast("string"), F.lit(name))).otherwise(out)
    return out


#: Directives of a date format and the letters that say the same to Spark (fixed values).
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "z": "xx"}


def date_pattern(fmt: str) -> str:
    """A date format with ``%`` directives as Spark's pattern; unknown directives and an empty format are refused."""
    if not fmt:
        raise ValueError("a date needs a format, for example %Y-%m-%d")
    out, plain = "", ""
    for literal, directive in [*re.findall(r"([^%]+)|%(.?)", fmt), ("", None)]:
        if literal or directive == "%":
            plain += literal or "%"
            continue
        if directive is not None and directive not in DIRECTIVES:
            raise ValueError(f"bad date format {fmt!r}: %{directive}")
        out += "'" + plain.replace("'", "''") + "'" if plain else ""
        out, plain = out + DIRECTIVES.get(directive, ""), ""
    return out


def format_date(col: Column, fmt: str, zone: str | None = None) -> Column:
    """A time as text in a format with ``%`` directives; ``zone`` gives the wall time there."""
    local = F.from_utc_timestamp(col, zone) if zone else col
    return F.date_format(local, date_pattern(fmt))


#: A name whose last part is so holds something secret; the value follows ``=`` or ``:``, quoted or up to a blank or comma.
SECRET_NAME = r"(?:[a-z0-9]+[_-])*(?:pass(?:word|phrase|wd)?|secret|token|credentials?|api[_-]?key|private[_-]?key|session[_-]?id)"
#: (pattern, what stays): header lines first, then schemes in running text, then named values.
REDACTIONS = (
    (r"(?i)\b((?:proxy-)?authorization[ \t]*:[ \t]*)[^\r\n]+", "$1***"),
    (r"(?i)\b((?:set-)?cookie[ \t]*:[ \t]*)[^\r\n]+", "$1***"),
    (r"(?i)\b(bearer|basic|digest)([ \t]+)[^ \t\r\n,;\"']{6,}", "$1$2***"),
    (rf"(?i)\b({SECRET_NAME}[\"']?[ \t]*[:=][ \t]*)(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|[^ \t\r\n,;&]+)", "$1***"),
)


def redact(col: Column) -> Column:
    """A text without credentials: authorisation and cookie headers, bearer, basic and digest schemes, values of secret names."""
    out = col
    for pattern, stays in REDACTIONS:
        out = F.regexp_replace(out, pattern, stays)
    return out


def redact_map(col: Column) -> Column:
    """A map of texts in which values of secret keys are gone wholly and the others are redacted as texts."""
    return F.transform_values(col, lambda k, v: F.when(k.rlike(rf"(?i)^(?:{SECRET_NAME}|(?:proxy-)?authorization|(?:set-)?cookie)$"), F.lit("***")).otherwise(redact(v)))
