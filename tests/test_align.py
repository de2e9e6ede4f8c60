"""Block and word scripts: both sides come back, nothing shorter exists, no size changes the answer."""

import time

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronodiff.operators import align

texts = st.lists(st.sampled_from("abcd"), max_size=9)
PAIR = "k int, old_blocks array<string>, new_blocks array<string>"


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@given(texts, texts)
def test_script_rebuilds_both_sides_and_is_shortest(a, b):
    script = align.edit_script(a, b)
    assert [x for _, i, p, _, _ in script for x in a[i:p]] == a
    assert [x for _, _, _, j, q in script for x in b[j:q]] == b
    assert sum(p - i for t, i, p, _, _ in script if t == "eq") == lcs(a, b)
    assert all(a[i:p] == b[j:q] for t, i, p, j, q in script if t == "eq")


@given(st.text(alphabet="ab5. %\n'", max_size=30), st.text(alphabet="ab5. %\n'", max_size=30))
def test_word_script_is_the_new_text(old, new):
    tokens, degraded = align.word_script(old, new)
    assert not degraded and "".join(t for k, t in tokens if k != "del") == new


def test_many_edits_are_aligned_exactly():
    old = [f"block {k} " for k in range(10_000)]
    new = [f"other {k}" if k % 2 else t for k, t in enumerate(old)]
    began = time.time()
    script = align.edit_script(old, new)
    assert sum(p - i for t, i, p, _, _ in script if t == "eq") == 5_000 and time.time() - began < 2
    few = [f"b{(k * 7919) % 40}" for k in range(3_000)]
    assert sum(p - i for t, i, p, _, _ in align.edit_script(few, few[100:] + few[:50]) if t == "eq") >= 2_900


def test_huge_pages_are_aligned_and_flagged(monkeypatch):
    monkeypatch.setattr(align, "MAX_BLOCKS", 4)
    got = align.block_script(["a", "b", "c one", "d", "e"], ["a", "b", "c two", "d", "e"])
    assert [r[0] for r in got] == ["eq", "rep", "eq"] and got[1][8:] == (2, 2, True)


def test_marks(spark):
    old, new = ["one", "two words here", "three", "four", "5.0% off"], ["zero", "one", "two words there", "four", "three", "6.0% off", "tail"]
    got = align.render_marks(spark.createDataFrame([(1, old, new)], PAIR), ["k"]).orderBy("n").collect()
    assert [r["line"] for r in got] == ["+ zero", "  one", "~ two words [-here-]{+there+}", "  four", "> three", "~ [-5.0-]{+6.0+}% off", "~ {+tail+}"]


def test_changed_text_of_whole_blocks(spark):
    pairs = spark.createDataFrame([(1, ["a"], ["a", "new block"]), (2, ["a", "gone block"], ["a"]), (3, ["price 5 now"], ["price 6 now"]), (4, ["x", "y"], ["y", "x"])], PAIR)
    got = {(r["k"], r["t"]): (r["added"], r["removed"]) for r in align.changed_text(align.align_blocks(pairs, ["k"])).where("t <> 'eq'").collect()}
    assert got == {(1, "ins"): ("new block", ""), (2, "del"): ("", "gone block"), (3, "rep"): ("6", "5"), (4, "mov"): ("", "")}


def test_stats(spark):
    pairs = spark.createDataFrame([(1, ["a b c", "k"], ["a x c d", "k", "tail of four words"])], PAIR)
    r = align.diff_stats(align.align_blocks(pairs, ["k"]), ["k"]).first()
    assert (r["added_words"], r["removed_words"], r["changed_words"], r["changed_blocks"], r["degraded"]) == (6, 1, 6, 2, False)


def test_moves_can_count_as_changes():
    kinds = [op[0] for op in align.block_script(["a", "b", "c"], ["b", "c", "a"], moves=False)]
    assert "mov" not in kinds and {"del", "ins"} <= set(kinds)
    assert {op[0] for op in align.block_script(["a", "b", "c"], ["b", "c", "a"])} <= {"eq", "mov"}


def test_null_sides(spark):
    pairs = spark.createDataFrame([(1, None, ["x"]), (2, ["x"], None), (3, None, None)], PAIR)
    assert sorted((r["k"], r["t"]) for r in align.align_blocks(pairs, ["k"]).collect()) == [(1, "ins"), (2, "del")]
    assert align.diff_stats(align.align_blocks(pairs.where(F.lit(False)), ["k"]), ["k"]).count() == 0


def test_cumulative_threshold_counts_against_the_anchor(spark):
    rows = [(1, t, [" ".join(["w"] * n)]) for t, n in enumerate([3, 5, 7, 9, 11])]
    out = align.gate_cumulative(spark.createDataFrame(rows, "page int, at int, blocks array<string>"), "page", "at", 4).orderBy("at").collect()
    assert [(r["words"], r["alert"], r["checks"]) for r in out] == [(2, False, 1), (4, True, 2), (2, False, 1), (4, True, 2)]
