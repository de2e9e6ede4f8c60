"""Links, images, feeds and schedules on hand-made cases that the test tables lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronodiff.operators import blocks, capacity
from chronodiff.sources import records as R


def urls(spark, html, take=blocks.extract_links):
    df = spark.createDataFrame([(1, "https://a.example/x/y", html)], "page int, url string, html string")
    return [r["url"] for r in take(df, ["page"], "url", "html").orderBy("n").collect()]


def test_links(spark):
    html = """<!-- <a href="/hidden">h</a> --><a class=k href=z.html>z</a><A HREF='/r?a=1&amp;b=2#top'>r</A><a href="z.html">again</a>
    <a href="ftp://f.example/">f</a><a href="sms:1">s</a><a href=" //B.example/c ">c</a><abbr href="no">n</abbr>"""
    assert urls(spark, html) == ["https://a.example/x/z.html", "https://a.example/r?a=1&b=2", "https://B.example/c"]


def test_links_base_and_nofollow(spark):
    assert urls(spark, '<base href="/deep/er/"><a href="p">p</a>') == ["https://a.example/deep/er/p"]
    assert urls(spark, '<base href="https://o.example/q/"><a href="p">p</a>') == ["https://o.example/q/p"]
    assert urls(spark, '<meta content="noindex, NOFOLLOW" name="Robots"><a href="p">p</a>') == []
    assert urls(spark, '<meta name="robots" content="noindex"><a href="p">p</a>') == ["https://a.example/x/p"]
    assert urls(spark, None) == [] and urls(spark, "") == []


def test_images(spark):
    html = '<base href="/i/"><img alt=a src="1.png"><img data-src="2.png"><img src="data:image/png;base64,AA"><img src="1.png"><img alt="none">'
    assert urls(spark, html, blocks.extract_images) == ["https://a.example/i/1.png", "https://a.example/i/2.png"]


RSS = """<rss version="2.0"><channel><title>T</title>
<item><title>One</title><link>https://e/1</link><guid isPermaLink="false">g1</guid><description>&lt;p&gt;a  b&lt;/p&gt;</description></item>
<item><title>One again</title><guid>g1</guid></item><item><title>Two</title><link>https://e/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title>
<entry><id>u1</id><title type="html">First</title><link rel="self" href="https://e/s"/><link href="https://e/a"/><summary>short</summary></entry>
<entry><title>Second</title><link rel="alternate" href="https://e/b"/><content type="text">long</content></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, None), (4, "<html></html>")], "k int, body string")
    rows = [tuple(r) for r in R.feed_entries(df, ["k"], "body").select("k", "pos", "entry", "title", "link", "summary").orderBy("k", "pos").collect()]
    assert rows == [
        (1, 1, "g1", "One", "https://e/1", "a b"), (1, 2, "https://e/2", "Two", "https://e/2", None),
        (2, 1, "u1", "First", "https://e/a", "short"), (2, 2, "https://e/b", "Second", "https://e/b", "long"),
    ]


@pytest.mark.parametrize(
    ("at", "start", "end", "days", "due"),
    [
        ("2024-01-15 17:00:00", 540, 1020, [0], "2024-01-15 17:00:00"),  # the end belongs to the window
        ("2024-01-15 17:00:01", 540, 1020, [0], "2024-01-22 09:00:00"),
        ("2024-01-15 08:00:00", 540, 1020, [], "2024-01-15 09:00:00"),
        ("2024-01-15 08:00:00", 540, 1020, [1], "2024-01-16 09:00:00"),
        ("2024-01-15 12:00:00", 1320, 360, None, "2024-01-15 22:00:00"),
        ("2024-01-15 06:00:00", 1320, 360, None, "2024-01-15 06:00:00"),
        ("2024-01-15 12:00:00", None, None, [5], "2024-01-20 00:00:00"),
        ("2024-01-15 12:00:00", None, None, None, "2024-01-15 12:00:00"),
        (None, 540, 1020, [0], None),
    ],
)
def test_limits(spark, at, start, end, days, due):
    row = spark.createDataFrame([(at, start, end, days)], "at string, s int, e int, d array<int>")
    got = row.select(capacity.apply_limits(F.col("at").cast("timestamp"), F.col("s"), F.col("e"), F.col("d")).cast("string").alias("v")).first()["v"]
    assert got == due


def test_limits_in_a_zone(spark):
    got = spark.range(1).select(capacity.apply_limits(F.lit("2024-01-15 07:30:00").cast("timestamp"), F.lit(540), F.lit(1020), zone="Europe/Berlin").cast("string").alias("v")).first()["v"]
    assert got == "2024-01-15 08:00:00"


def test_adaptive_next(spark):
    df = spark.createDataFrame([(1000, True), (1000, False), (1000, None), (None, False), (7000, False)], "c int, changed boolean")
    got = [r["v"] for r in df.select(capacity.adaptive_next(F.col("c"), F.col("changed"), 300, 7200, 1.5).alias("v")).collect()]
    assert got == [300, 1500, 1000, 300, 7200]


def test_due_now(spark):
    t = dt.datetime(2024, 1, 15, 12)
    rows = [(1, 0, t), (2, 1, t), (3, 1, t - dt.timedelta(hours=1)), (4, 2, t + dt.timedelta(seconds=1))]
    assert [r["page"] for r in capacity.due_now(spark.createDataFrame(rows, "page int, priority int, due timestamp"), t).collect()] == [3, 2, 1]
