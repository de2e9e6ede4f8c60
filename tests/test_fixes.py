"""Hand-made cases: what a word threshold counts, which fetches are rejected, numbers, references, links, secrets, lists."""

import pytest
from pyspark.sql import functions as F

from chronodiff.functions import text as T
from chronodiff.operators import align, blocks, delta, history, replay
from chronodiff.sources import watchlists as WL

TEN = "one two three four five six seven eight nine ten"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("old", "new", "words", "added", "removed"), [
    ([TEN, "same", "end"], ["same", TEN.replace("one", "new"), "end"], 20, 10, 10),  # gone here, come there: both count
    ([TEN], [TEN.replace("ten", "ten eleven")], 1, 1, 0),
    ([TEN], [TEN.replace("five", "5").replace("six", "6")], 2, 2, 2),  # of a replaced run the larger side
    ([TEN, "a"], ["a", TEN], 0, 0, 0),  # a move
    ([], [TEN], 10, 10, 0),
])
def test_threshold_counts_words_of_each_change(spark, old, new, words, added, removed):
    pair = spark.createDataFrame([(1, old, new)], "id int, old_blocks array<string>, new_blocks array<string>")
    stats = align.diff_stats(align.align_blocks(pair, ["id"]), ["id"])
    r = stats.first()
    assert (r["changed_words"], r["added_words"], r["removed_words"]) == (words, added, removed)
    verdict = lambda n, **k: delta.gate_changes(stats, n, **k).first()["reason"]
    if not words:
        assert verdict(1) == "reorder_only"
    else:
        assert verdict(words) is None and verdict(words + 1) == "below_threshold"
        assert verdict(added + 1, ignore_removed=True) == "below_threshold"
    bodies = spark.createDataFrame([(1, "\n".join(old), "\n".join(new))], "id int, old_text string, new_text string")
    got = replay.try_config(bodies, ["id"], replay.Config(min_words=max(words, 1))).first()["verdict"]
    assert got == ("alert" if words else "reorder_only")


def test_degraded_runs_count_all_words_of_both_sides(monkeypatch):
    monkeypatch.setattr(align, "MAX_TOKENS", 5)
    (op,) = align.block_script([TEN], [TEN + " eleven"])
    assert op[0] == "rep" and op[8:] == (11, 10, True)


@pytest.mark.parametrize(("text", "black", "white", "reason"), [
    ("in stock now", (), ("in stock", "sold out"), None), ("gone", (), ("in stock", "sold out"), "whitelist_miss"), ("gone", (" ", ""), ("", "  "), None),
    ("An Error 500", ("", "error"), (), "blacklist"), ("x", (), (), "too_short"), (None, (), ("a",), "too_short"),
])
def test_bad_fetches(spark, text, black, white, reason):
    assert one(spark, lambda c: delta.bad_fetch(c, 2, black, white), text) == reason


@pytest.mark.parametrize(("text", "value"), [
    ("1 299,50", 1299.5), ("1 299,50 €", 1299.5), ("12 345 678", 12345678.0), ("1 2", 1.0), ("5 1234", 5.0), ("from 1 000 to 2 000", 1000.0), ("1,099", 1099.0), ("1.099,50", 1099.5), ("-12.5", -12.5), ("none", None), (None, None),
])
def test_numbers(spark, text, value):
    assert one(spark, T.parse_number, text) == value


@pytest.mark.parametrize(("text", "shown"), [
    ("&eacute;&#8364;&#x41;&#X1F600;", "é€A😀"), ("&amp;lt; &unknown; &amp", "&lt; &unknown; &amp"), ("a & b &; &#; &#x; &#0; &#xD800; &#99999999;", "a & b &; &#; &#x; &#0; &#xD800; &#99999999;"), ("plain", "plain"), (None, None), ("&nbsp;&hellip;&", "\xa0…&"),
])
def test_character_references(spark, text, shown):
    assert one(spark, T.decode_entities, text) == shown


@pytest.mark.parametrize(("text", "shown"), [
    ("compass: north", "compass: north"), ("bypass=road", "bypass=road"), ("Digest abcdefgh12345", "Digest ***"), ("db_password=x1, token: y", "db_password=***, token: ***"), ("passenger: 5", "passenger: 5"), ('api-key="a b"', "api-key=***"),
])
def test_secrets(spark, text, shown):
    assert one(spark, T.redact, text) == shown


def test_links_and_images(spark):
    html = """<base href='https://h.org/dir/'><a title="a>b" href="/one">1</a><a data-x='href="no"' HREF=two>2</a><!-- <a href="/c"> --><a
      href = "three?q=1&amp;r=2#f">3</a><abbr href="/no">x</abbr><a href="mailto:x@y">m</a><a href="/one">again</a><a name="n">none</a>
      <img alt="x > y" src="/i.png"><img src='' data-src="late.png"><img alt=no><IMG SRC=/i.png>"""
    pages = spark.createDataFrame([(1, "http://own.net/p", html), (2, "http://own.net/p", '<meta content="noindex, NOFOLLOW" name="Robots"><a href="/x">x</a><img src="x.gif">'), (3, None, None), (4, "http://own.net/a/b", f'<a {"x" * 20_000}="{"y" * 50_000}" href="c">c</a>')], "id int, url string, html string")
    got = lambda rows: sorted((r["id"], r["n"], r["url"]) for r in rows.collect())
    assert got(blocks.extract_links(pages, ["id"], "url", "html")) == [(1, 1, "https://h.org/one"), (1, 2, "https://h.org/dir/two"), (1, 3, "https://h.org/dir/three?q=1&r=2"), (4, 1, "http://own.net/a/c")]
    assert got(blocks.extract_images(pages, ["id"], "url", "html")) == [(1, 1, "https://h.org/i.png"), (1, 2, "https://h.org/dir/late.png"), (2, 1, "http://own.net/x.gif")]


def test_nested_bookmark_files(spark):
    html = """<H1>B</H1><DL><p><DT><A HREF="http://top/">Top &amp; <i>all</i></A><DT><H3 X="1">News</H3><DL><p><DT><A HREF='http://n/?a&amp;b'>N</A>
      <DT><H3>Deep</H3><DL><p><DT><A HREF="http://d/">D</A></DL><p><DT><A HREF="http://m/">M</A></DL><p><DT><H3>Empty</H3><DL><p></DL><p><DT><H3>Last</H3><DL><p><DT><A HREF="">no</A></DL><p></DL>"""
    files = spark.createDataFrame([("f", html), ("g", "no list <a href='http://x/'>x</a>"), ("h", None)], "name string, html string")
    got = [tuple(r) for r in WL.bookmark_rows(files, "name", "html").orderBy("file", "row").collect()]
    assert got == [("f", 1, "http://top/", "Top & all", None), ("f", 2, "http://n/?a&b", "N", "News"), ("f", 3, "http://d/", "D", "News/Deep"), ("f", 4, "http://m/", "M", "News"), ("f", 5, "", "no", "Last"), ("g", 1, "http://x/", "x", None)]
    bad = {r["row"]: r["problem"] for r in WL.import_rows(WL.bookmark_rows(files, "name", "html").where("file = 'f'")).collect()}
    assert bad == {1: None, 2: None, 3: None, 4: None, 5: "no address"}


def test_lists_of_addresses_and_tables(spark, tmp_path):
    lines = spark.createDataFrame([(1, "# no"), (2, " "), (3, "My page - https://a.org/x?y | note"), (4, "example.com/path"), (5, "not an address"), (6, "FTP://f.org"), (7, "// no")], "n int, line string")
    got = {r["n"]: (r["url"], r["name"], r["problem"]) for r in WL.import_rows(WL.address_rows(lines, "line")).collect()}
    assert got == {3: ("https://a.org/x?y", "My page -   | note", None), 4: ("https://example.com/path", None, None), 5: ("not an address", None, "bad address"), 6: ("FTP://f.org", None, None)}
    (tmp_path / "list.csv").write_text('URL,"Inter val",Folder,Keywords,Name\nhttps://a.org,15m,a / b,"x\ny",A\n,,,,\nhttps://b.org,never,,,\n')
    rows = {r["url"]: (r["interval_s"], r["folder"], r["keywords"], r["problem"]) for r in WL.import_rows(WL.read_table(spark, str(tmp_path / "list.csv"))).collect()}
    assert rows == {"https://a.org": (900, "a/b", "x\ny", None), "https://b.org": (None, None, None, "bad interval")}
    with pytest.raises(ValueError, match="no url"):
        WL.table_rows(spark.createDataFrame([(1,)], "link int"))


def test_reading_a_page_moves_its_pointers(spark):
    pages = spark.createDataFrame([(1, "changed", True, 3, 9, 5, 7), (2, "error", False, 2, None, None, None), (3, "error", False, 1, 4, 4, 4), (4, "changed", True, 1, 8, 2, 2), (5, "needs_login", False, 0, 6, 6, 1)], "id int, status string, unread boolean, errors int, latest int, baseline int, anchor int")
    got = {r["id"]: tuple(r)[1:] for r in history.mark_pages_read(pages, spark.createDataFrame([(1,), (2,), (3,), (5,), (5,)], "page int")).collect()}
    assert got == {1: ("ok", False, 0, 9, 9, 9, True), 2: ("new", False, 0, None, None, None, False), 3: ("ok", False, 0, 4, 4, 4, False), 4: ("changed", True, 1, 8, 2, 2, False), 5: ("needs_login", False, 0, 6, 6, 6, False)}


@pytest.mark.parametrize(("fmt", "shown"), [("%Y-%m-%d", "2024-03-05"), ("it's %H:%M:%S.%f", "it's 07:08:09.123456"), ("%%%y%%", "%24%"), ("%A %B %j %I %p", "Tuesday March 065 07 AM")])
def test_date_formats(spark, fmt, shown):
    assert spark.sql("SELECT timestamp'2024-03-05 07:08:09.123456' AS t").select(T.format_date(F.col("t"), fmt).alias("v")).first()["v"] == shown


@pytest.mark.parametrize("fmt", ["", "%", "%q"])
def test_bad_date_formats(fmt):
    with pytest.raises(ValueError, match="format"):
        T.date_pattern(fmt)
