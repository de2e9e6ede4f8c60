"""Element-level filters on HTML: remove or keep what a selector matches (Arrow batches, standard parser)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em i kbd label mark q s samp small span strong sub sup time u var".split())
_PIECE = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[#.][\w-]+|\[[\w-]+(?:\*?=\"?[^\]\"]*\"?)?\])*)")
_TEST = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:(\*?=)\"?([^\]\"]*)\"?)?\]")

#: Characters of blocks, with their paths, that are given on at once.
SLICE_CHARS = 2_000_000

#: Elements of consent banners (fixed values).
CONSENT_SELECTORS = (
    "#onetrust-consent-sdk", "#onetrust-banner-sdk", "#onetrust-pc-sdk", "#CybotCookiebotDialog", "#CybotCookiebotDialogBodyUnderlay",
    "#cookiebanner", "#cookie-banner", "#cookie-notice", "#cookie-consent", "#cookieconsent", "#cookie-law-info-bar", "#cookie-law-info-again",
    "#cmpbox", "#cmpwrapper", "#didomi-host", "#didomi-popup", "#usercentrics-root", "#truste-consent-track", "#consent_blackbar",
    "#hs-eu-cookie-confirmation", "#gdpr-cookie-notice", "#gdpr-cookie-message", "#sp-cc", "#qc-cmp2-container", "#termly-code-snippet-support",
    ".cc-window", ".cc-banner", ".cc-revoke", ".cookie-banner", ".cookie-notice", ".cookie-consent", ".cookie-bar", ".cookie-popup",
    ".cookie-law-info-bar", ".cookiebanner", ".cookies-banner", ".cookies-notice", ".cmp-banner", ".gdpr-banner", ".gdpr-notice", ".consent-banner",
    ".consent-modal", ".privacy-banner", ".evidon-banner", ".osano-cm-window", ".osano-cm-dialog", ".truste_overlay", ".fc-consent-root",
    ".qc-cmp2-container", ".sp_message_container", ".termly-consent-banner", ".cky-consent-container", ".cli-modal-dialog", ".pwa-install-banner",
    '[id*="cookie-banner"]', '[id*="cookie-consent"]', '[id*="cookie_consent"]', '[id*="cookiebanner"]', '[class*="cookie-banner"]',
    '[class*="cookie-consent"]', '[class*="cookie_consent"]', '[class*="cookiebanner"]', '[class*="CookieBanner"]', '[class*="CookieConsent"]',
    '[aria-label="Cookie banner"]', '[aria-label="Cookie consent"]', '[aria-label="Cookie Consent"]', '[data-testid="cookie-banner"]',
)


def parse_selector(selector: str) -> list[tuple[str, str, list[tuple]]]:
    """(combinator, tag, tests) of each step; tag, #id, .class, [attr], [attr=v], [attr*=v], descendant and child."""
    steps, link = [], " "
    for part in re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+|>", selector):
        if part == ">":
            link = ">"
            continue
        m = _PIECE.fullmatch(part)
        if not m:
            raise ValueError(f"unsupported selector: {selector}")
        tests = [("id" if t[0] == "#" else "class", "~=", t[1]) if t[0] else (t[2], t[3] or "", t[4]) for t in _TEST.findall(m[2])]
        steps.append((link, (m[1] or "*").lower(), tests))
        link = " "
    return steps


def _fits(step: tuple, element: tuple[str, dict]) -> bool:
    _, tag, tests = step
    if tag not in ("*", element[0]):
        return False
    for name, op, value in tests:
        have = element[1].get(name)
        if have is None or (op == "~=" and value not in have.split()) or (op == "=" and value != have) or (op == "*=" and value not in have):
            return False
    return True


def _matches(steps: list, stack: list) -> bool:
    """Whether the last element of the stack matches."""
    def at(k: int, depth: int) -> bool:
        if depth < 0 or not _fits(steps[k], stack[depth]):
            return False
        if k == 0:
            return True
        above = [depth - 1] if steps[k][0] == ">" else range(depth - 1, -1, -1)
        return any(at(k - 1, d) for d in above)

    return at(len(steps) - 1, len(stack) - 1)


class _Walker(HTMLParser):
    def __init__(self, selectors: list, keep: bool | None):
        super().__init__(convert_charrefs=True)
        self.selectors, self.keep = selectors, keep
        self.stack, self.marks, self.text, self.out, self.hit = [], [], [], [], False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append(("/".join(e[0] for e in self.stack), text, self.hit))
        self.text, self.hit = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE:
            self.flush()
        if tag in _VOID:
            return
        self.stack.append((tag, {k: v or "" for k, v in attrs}))
        self.marks.append(any(_matches(s, self.stack) for s in self.selectors))

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if any(e[0] == tag for e in self.stack):
            while self.stack.pop()[0] != tag:
                self.marks.pop()
            self.marks.pop()

    def handle_data(self, data: str) -> None:
        hidden = any(e[0] in ("script", "style", "noscript", "template", "head") for e in self.stack)
        inside = any(self.marks)
        if not hidden and self.keep in (None, inside):
            self.text.append(data)
            self.hit |= inside and bool(data.strip())


#: How names begin that style builders make anew at each build; like names with digits, no rule hangs on them.
BUILT = ("css-", "sc-", "jss-", "emotion-", "styled-", "svelte-", "_")


def stable_selector(tag: str, attrs: dict) -> str | None:
    """``#id`` or ``tag.class`` of an element whose id or first such class is likely to last; null without one."""
    ids, classes = attrs.get("id", "").split(), attrs.get("class", "").split()
    for name in ids[:1] + classes:
        if re.fullmatch(r"[A-Za-z_][A-Za-z_-]*", name) and not name.lower().startswith(BUILT):
            return f"#{name}" if name in ids[:1] else f"{tag}.{name}"
    return None


class _Owners(_Walker):
    """Blocks with the stable selectors of the elements around them, the innermost first."""

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((text, [s for e in reversed(self.stack) if (s := stable_selector(*e))]))
        self.text, self.hit = [], False


def _walked(df: DataFrame, key: str, html_col: str, make: Callable[[], _Walker], columns: list[tuple[str, DataType]]) -> DataFrame:
    """``key``, ``pos`` and ``columns`` of each page's blocks; a task holds ``SLICE_CHARS`` of them and one page, whatever its batch has."""
    kinds = [(key, df.schema[key].dataType), ("pos", IntegerType()), *columns]
    schema = pa.schema([(name, to_arrow_type(kind)) for name, kind in kinds])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, chars = [], 0
        for batch in batches:
            for k, html in zip(batch.column(0), batch.column(1), strict=True):
                walker = make()
                walker.feed(html.as_py() or "")
                walker.close()
                walker.flush()
                own = k.as_py()
                for pos, block in enumerate(walker.out):
                    rows.append((own, pos, *block))
                    chars += 100 + sum(len(x) if isinstance(x, str) else 50 * len(x) if isinstance(x, list) else 0 for x in block)
                    if chars > SLICE_CHARS:
                        yield give(rows)
                        rows, chars = [], 0
        if rows:
            yield give(rows)

    return df.select(key, html_col).mapInArrow(work, ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in kinds))


def owned_blocks(df: DataFrame, key: str, html_col: str) -> DataFrame:
    """``key``, ``pos``, ``text``, ``owners``: all blocks and the selectors that would drop each, innermost first; null HTML has none."""
    return _walked(df, key, html_col, lambda: _Owners([], None), [("text", StringType()), ("owners", ArrayType(StringType()))])


def _run(df: DataFrame, key: str, html_col: str, selectors: list[str], keep: bool | None) -> DataFrame:
    parsed = [parse_selector(s) for s in selectors]
    return _walked(df, key, html_col, lambda: _Walker(parsed, keep), [("path", StringType()), ("text", StringType()), ("inside", BooleanType())])


def drop_elements(df: DataFrame, key: str, html_col: str, selectors: list[str]) -> DataFrame:
    """``key``, ``pos``, ``path``, ``text``: blocks outside every matched element."""
    return _run(df, key, html_col, selectors, False).drop("inside")


def watch_elements(df: DataFrame, key: str, html_col: str, selectors: list[str]) -> DataFrame:
    """Blocks inside matched elements, in document order; nested matches once."""
    return _run(df, key, html_col, selectors, True).drop("inside")


def scoped_blocks(df: DataFrame, key: str, html_col: str, selector: str) -> DataFrame:
    """All blocks in order with ``inside``: whether a block lies in, or holds text of, an element that the selector (a list by commas) matches.

    The scope of a text rule: apply the rule where ``inside`` holds.
    """
    return _run(df, key, html_col, [s.strip() for s in selector.split(",")], None)
