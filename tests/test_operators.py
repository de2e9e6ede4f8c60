"""Small tables of cases for what SQL checks do not reach: sinks, readers, DOM, markers, null and empty input."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronodiff.functions import text as T
from chronodiff.functions import urls as U
from chronodiff.operators import blocks, capacity, crawl, delta, dom, history, keywords, raster, records, replay
from chronodiff.session import shared_folder
from chronodiff.sources import records as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "number"), [("1,099", 1099.0), ("€ 1.099,50", 1099.5), ("12.5", 12.5), ("1,5", 1.5), ("none", None), ("-3", -3.0), ("1.234.567", 1234567.0)])
def test_parse_number(spark, text, number):
    assert value(spark, T.parse_number(F.lit(text))) == number


@pytest.mark.parametrize(("text", "seconds"), [("90s", 90), ("15m", 900), ("2h", 7200), ("1w", 604800), ("5", 60), ("soon", None), ("", None)])
def test_parse_interval(spark, text, seconds):
    assert value(spark, T.parse_interval(F.lit(text))) == seconds


def test_wildcards():
    assert T.wildcard_to_regex("a*b?c*") == "a.*?b.c.*"


@pytest.mark.parametrize(("url", "norm"), [("HTTP://A.com:80/x/#top", "http://a.com/x"), ("https://a.com:443/?q=1", "https://a.com?q=1"), ("not a url", "not a url"), ("HTTP://Me:PassWord@A.com/", "http://Me:PassWord@a.com")])
def test_normalize_url(spark, url, norm):
    assert value(spark, U.normalize_url(F.lit(url))) == norm


def test_redact(spark):
    got = value(spark, T.redact(F.lit('token = "abc" and password: hunter2, Authorization: Bearer abcdefghijk')))
    assert "abc\"" not in got and "hunter2" not in got and "abcdefghijk" not in got


@pytest.mark.parametrize(("start", "end", "inclusive", "kept", "left"), [
    ("BEGIN", "END", False, ["b", "x"], ["a", "BEGIN", "END", "c begin", "end tail", "BEGIN", "d"]),
    ("begin", "end", True, ["BEGIN", "b", "END", "begin x end"], ["a", "c", "tail", "BEGIN", "d"]),
    ("NOWHERE", "END", False, [], None), ("BEGIN", "NOWHERE", False, [], None),
    (None, "END", False, ["a", "BEGIN", "b"], ["END", "c begin x end tail", "BEGIN", "d"]),
    ("begin x", None, False, ["end tail", "BEGIN", "d"], ["a", "BEGIN", "b", "END", "c begin x"]),
])
def test_markers(spark, start, end, inclusive, kept, left):
    texts = ["a", "BEGIN", "b", "END", "c begin x end tail", "BEGIN", "d"]
    x = F.array(*map(F.lit, texts))
    assert value(spark, blocks.keep_between(x, start, end, inclusive)) == kept
    got = value(spark, blocks.remove_between(x, start, end, inclusive))
    assert " ".join(got) == " ".join(left or texts)


def test_robots_rules_are_prefixes(spark):
    urls = ["http://a.com/theatre/x", "http://a.com/the", "http://a.com/other", "http://b.com/the", "http://a.com", "http://a.com/the/1/2/3/4/5/6/7/8/9/open?x=1"]
    rules = spark.createDataFrame([("a.com", "/the", False), ("a.com", "/the/1/2/3/4/5/6/7/8/9/open?x", True)], "host string, path string, allow boolean")
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == [False, False, True, True, True, True]


@pytest.mark.parametrize(("old", "new", "name"), [
    ("seen 5 minutes ago", "seen just now", "relative_time"), ("on 2024-01-02T10:00Z", "on 2025-01-02", "iso_datetime"), ("Sep 30", "Oct 1", "long_date"), ("10/05/2026", "11.05.2026", "numeric_date"),
    ("at 1:07 PM", "at 13:10 UTC", "clock_time"), ("1,204 VIEWS", "7 views", "counter"), ("t 1759669800", "t 1759669800123", "unix_timestamp"), ("id 0123456789abcdef", "id fedcba9876543210", "hex_token"),
    ("$1,299.00", "12,50 €", "currency_amount"), ("room 5", "room 6", None),
])
def test_volatile_patterns(spark, old, new, name):
    assert value(spark, replay.volatile_pattern(F.lit(old), F.lit(new))) == name


def test_first_row_of_an_id_wins(spark):
    old = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, n int")
    assert [r["event"] for r in records.record_events(old, new, "id", ["v"], order="n").collect()] == ["changed"]
    assert records.record_events(old, new, "id", ["v"]).count() == 0


def test_scope_and_phrases(spark):
    df = spark.createDataFrame([(1, "<body><article><p>a 1</p></article><p>b <span class=k>2</span></p><p>c 3</p></body>")], "id long, html string")
    assert [(r["text"], r["inside"]) for r in dom.scoped_blocks(df, "id", "html", "article, .k").orderBy("pos").collect()] == [("a 1", True), ("b 2", True), ("c 3", False)]
    text = spark.createDataFrame([(1, "a price drop (again) of the new phone")], "k int, t string")
    assert keywords.near_hits(text, ["k"], "t", ["price drop", "phone"], 8).first()["span"] == 7
    assert [r["s"] for r in keywords.literal_offsets(text, ["k"], "t", "(Again)").collect()] == [13]


def test_maps_are_redacted(spark):
    got = value(spark, T.redact_map(F.create_map(F.lit("X-Api-Key"), F.lit("abc"), F.lit("note"), F.lit("password=hunter2, fine"))))
    assert got == {"X-Api-Key": "***", "note": "password=***, fine"}


def test_dom_selectors(spark):
    html = '<body><div id="main"><p class="x">one<b>!</b></p><p>two</p></div><div class="cookie-banner"><p>buy</p></div><span data-k="v1">s</span></body>'
    df = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    texts = lambda d: [r["text"] for r in d.orderBy("id", "pos").collect()]
    assert texts(dom.drop_elements(df, "id", "html", [".cookie-banner"])) == ["one!", "two", "s"]
    assert texts(dom.watch_elements(df, "id", "html", ["#main > p.x", "[data-k*=v]"])) == ["one!", "s"]
    with pytest.raises(ValueError, match="unsupported"):
        dom.parse_selector("p:hover")


def test_blocks_of_a_page(spark):
    html = "<html><head><title>t</title></head><body><h1>A&amp;B</h1><table><tr><td>1</td><td>2</td></tr></table>x<br>y</body></html>tail"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    assert [r["text"] for r in blocks.extract_blocks(df, ["id"], "html").orderBy("pos").collect()] == ["A&B", "1 | 2", "x", "y", "tail"]


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, "ok")], "id int, text string")
    for fmt in ("csv", "json", "xml"):
        R.write_report(df, str(tmp_path / fmt), fmt)
    back = R.read_records_csv(spark, str(tmp_path / "csv"), "id")
    assert sorted(r["text"] for r in back.collect()) == ["'=1+1", "ok"]
    R.write_changes(df, str(tmp_path / "text"), "text")
    assert spark.read.text(str(tmp_path / "text")).count() == 2
    with pytest.raises(ValueError, match="no column"):
        R.read_records_csv(spark, str(tmp_path / "csv"), "key")
    with pytest.raises(ValueError, match="columns differ"):
        R.append_once(df, df.select("id"), "id")
    names = [r["name"] for r in R.listing_blocks(spark, str(tmp_path / "json")).collect()]
    assert names == sorted(names) and names


def test_a_path_that_matches_nothing_fails(spark):
    df = spark.createDataFrame([(1, '{"a": 1}')], "k int, body string")
    with pytest.raises(PySparkException, match="nothing at"):
        R.read_records_json(df, ["k"], "body", "$.rows", "id").collect()


def test_first_failure_wins_and_raw_hash_of_the_run(spark):
    rows = [(1, 1, "Alpha beta"), (1, 2, "ALPHA  beta"), (1, 3, "x"), (1, 4, "Alpha beta"), (1, 5, "ALPHA  beta"), (1, 6, "gamma delta"), (2, 1, None)]
    df = delta.version_hashes(spark.createDataFrame(rows, "page int, at int, text string"), "text")
    df = delta.classify_fetches(df.withColumn("reject", delta.bad_fetch(F.col("text"), 5)), "page", "at")
    assert [r["outcome"] for r in df.orderBy("page", "at").collect()] == ["first", "unchanged", "rejected", "unchanged_raw", "unchanged", "stored", "rejected"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, text string")
    assert delta.block_delta(none, none, ["k"]).count() == 0
    assert blocks.extract_blocks(none, ["k"], "text").count() == 0
    old = spark.createDataFrame([], "id int, v double")
    new = spark.createDataFrame([(1, 2.0)], "id int, v double")
    assert [r["event"] for r in records.record_events(old, new, "id", ["v"]).collect()] == ["new"]


def test_loose_comparison(spark):
    assert value(spark, records.loose_cmp(F.lit("1,000"), ">", "999")) is True
    assert value(spark, records.loose_cmp(F.lit(None).cast("string"), "=", "x")) is False
    assert value(spark, records.loose_cmp(F.lit(None).cast("string"), "!=", "x")) is True
    assert value(spark, records.loose_cmp(F.lit("Open"), "=", "OPEN")) is True


def test_clock_times_across_a_clock_change(spark):
    now = dt.datetime(2024, 3, 30, 12, 0)
    due = capacity.next_clock_time(F.lit(now).cast("timestamp"), F.array(F.lit(150)), F.array(*[F.lit(d) for d in range(7)]), "Europe/Berlin")
    assert value(spark, due.cast("string")) == "2024-03-31 01:30:00"


def test_saved_searches_that_contradict_match_nothing(spark):
    df = spark.createDataFrame([(1, "ok", True)], "id int, status string, unread boolean")
    assert df.where(history.narrow(history.list_filters(status="ok"), history.list_filters(status="error"))).count() == 0


def test_two_regions(spark):
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    cells = [(1, x, y, (x, y) in {(1, 1), (2, 2), (9, 9)}) for x in range(12) for y in range(12)]
    got = raster.raster_regions(spark.createDataFrame(cells, "shot int, x int, y int, differs boolean")).collect()
    assert sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in got) == [(1, 1, 2, 2), (9, 9, 9, 9)]


@pytest.mark.parametrize(("old", "new", "config", "verdict"), [
    ("a\nb", "a\nb", {}, "unchanged"),
    ("a\nb", "b\na", {}, "reorder_only"),
    ("a\nseen 5 times", "a\nseen 6 times", {}, "alert"),
    ("a\nseen 5 times", "a\nseen 6 times", {"ignore": (("[0-9]+", "regex"),)}, "unchanged"),
    ("a\n7", "a", {"ignore": (("7", "literal"),)}, "unchanged"),
    ("a", "a\nb c", {"min_words": 3}, "below_threshold"),
    ("a\nb", "a", {"ignore_removed": True}, "removed_only"),
    ("long enough", "x", {"min_chars": 5}, "too_short"),
    ("a", "Access denied", {"blacklist": ("access denied",)}, "blacklist"),
    ("a", "a\nsale", {"terms": (("r", "price", "word"),)}, "keyword_miss"),
    ("a", "a\nprice", {"terms": (("r", "price", "word"),), "min_words": 9}, "alert"),
    (None, "", {}, "unchanged"),
    ("a", None, {}, "alert"),
])
def test_try_config(spark, old, new, config, verdict):
    pairs = spark.createDataFrame([(1, old, new)], "k int, old_text string, new_text string")
    assert [r["verdict"] for r in replay.try_config(pairs, ["k"], replay.Config(**config)).collect()] == [verdict]


def test_replay_bodies_empty(spark):
    none = spark.createDataFrame([], "k int, old_text string, new_text string")
    assert replay.replay_bodies(none, ["k"], replay.Config(), replay.Config(min_words=5)).count() == 0


@pytest.mark.parametrize(("tag", "attrs", "selector"), [
    ("div", {"id": "clock"}, "#clock"), ("div", {"id": "x93fa", "class": "css-abc live-box"}, "div.live-box"),
    ("p", {"class": "a1"}, None), ("p", {}, None),
])
def test_stable_selector(tag, attrs, selector):
    assert dom.stable_selector(tag, attrs) == selector


def test_propose_elements(spark):
    html = '<div id="main"><p>{}</p><div class="live">{}</div></div><p>{}</p>'
    rows = [("a", 1, html.format("x", 1, "y"), html.format("x", 2, "y")), ("a", 2, html.format("x", 1, "y"), html.format("z", 2, "y")),
            ("b", 3, html.format("x", 1, "y"), html.format("x", 2, "w")), ("c", 4, html.format("x", 1, "y"), html.format("x", 1, "y")), ("c", 5, None, None)]
    pairs = spark.createDataFrame(rows, "page string, pair int, old_html string, new_html string")
    found = sorted(tuple(r) for r in replay.propose_elements(pairs, "page", "pair").collect())
    assert found == [("a", "#main", 2, 2, True), ("a", "div.live", 1, 2, True), ("b", "div.live", 0, 1, False)]
