"""Cases of the third round's findings."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from chronodiff.operators import dom, rulerows
from chronodiff.plans import all as _all  # noqa: F401
from chronodiff.plans import registry
from chronodiff.sources import json_paths as J
from tests.oracle import same, views


def test_cells_are_told_in_single_precision(spark, tmp_path):
    """0.0155 as a float times 10,000 is 155 (5 * 31) in single precision and less in double."""
    values = [0.0155] + [0.00005] * 63
    spark.createDataFrame([(v, values, 0) for v in range(8)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.QUERIES["c21_raster_regions"](spark, str(tmp_path))
    same(found, registry.ORACLES["c21_raster_regions"], views(str(tmp_path)))


def test_the_gate_has_its_threshold(spark, sf_dir):
    reasons = {r["reason"] for r in registry.QUERIES["d2_d5_gate"](spark, sf_dir).collect()}
    assert "below_threshold" in reasons and "below_threshold" in registry.ORACLES["d2_d5_gate"]


def test_a_user_is_one_document(spark, sf_dir):
    rows = registry.QUERIES["a2_records_json"](spark, sf_dir)
    assert sorted(rows.columns) == ["kind", "pos", "rid", "user_id"]
    assert rows.groupBy("user_id", "pos").count().where("count > 1").count() == 0


def test_matches_are_given_on_in_slices(monkeypatch):
    monkeypatch.setattr(rulerows, "GIVEN", 10)
    texts = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["the end " * 4, None] * 25)], ["id", "text"])
    sent = type("Sent", (), {"value": [(1, "word", "the")]})
    out = list(rulerows._finder(sent, 1, ["id", "term_id", "s", "e", "word", "g"])(iter([texts])))
    assert [b.num_rows for b in out] == [12] * 8 + [4]
    assert sorted(set(pa.Table.from_batches(out)["id"].to_pylist())) == list(range(0, 50, 2))


def test_blocks_are_given_on_in_slices(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "<p>a 1</p><p>b</p>" if k % 3 else None) for k in range(30)], "id long, html string").coalesce(1)
    whole = sorted(map(tuple, dom.scoped_blocks(pages, "id", "html", "p").collect()))
    monkeypatch.setattr(dom, "SLICE_CHARS", 150)
    assert dom.SLICE_CHARS == 150 and sorted(map(tuple, dom.scoped_blocks(pages, "id", "html", "p").collect())) == whole and len(whole) == 40


def test_paths_take_a_document_apart_once(spark, sf_dir):
    """F8: every path grouped, wrote and parsed all documents again."""
    from chronodiff.plans import texts
    from chronodiff.sources import json_paths as J

    plan = texts.a2_json_paths(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1
    bodies = ['{"a": {"b": [1, {"c": null}, "x"]}, "it\'s": 2}', '{"a": {"b": {"0": 5}}}', '{"a": null}', "[[1, 2], [3]]", '"a"', "null", "no json", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    paths = ["$.a.b[0]", "$.a.b[1].c", "$.a.b[-1]", "$['a'][\"b\"]", '$["it\'s"]', "$[0][1]", "$..c", "$..b[0]", "$.a.*", "$", "$.a"]
    got = [tuple(r) for r in J.json_paths(docs, ["id"], "body", paths).select("id", "path", "pos", F.to_json("node")).collect()]
    want = {
        (0, 0, 0, "1"), (0, 1, 0, "null"), (0, 2, 0, '"x"'), (0, 3, 0, '[1,{"c":null},"x"]'), (1, 3, 0, '{"0":5}'), (0, 4, 0, "2"), (3, 5, 0, "2"), (0, 6, 0, "null"), (0, 7, 0, "1"),
        (0, 8, 0, '[1,{"c":null},"x"]'), (1, 8, 0, '{"0":5}'), (0, 9, 0, '{"a":{"b":[1,{"c":null},"x"]},"it\'s":2}'), (1, 9, 0, '{"a":{"b":{"0":5}}}'), (2, 9, 0, '{"a":null}'),
        (3, 9, 0, "[[1,2],[3]]"), (4, 9, 0, '"a"'), (5, 9, 0, "null"), (0, 10, 0, '{"b":[1,{"c":null},"x"]}'), (1, 10, 0, '{"b":{"0":5}}'), (2, 10, 0, "null"),
    }
    assert len(got) == len(want) and set(got) == want


def test_bodies_are_aligned_once(spark, monkeypatch):
    """both configurations aligned all pairs, also those that they filter alike or settle without."""
    from chronodiff.operators import align, replay

    aligned, align_blocks = [], align.align_blocks
    monkeypatch.setattr(align, "align_blocks", lambda pairs, keys: aligned.append(pairs.count()) or align_blocks(pairs, keys))
    texts = [("a b c", "a b d"), ("a 1 c", "a 2 c"), ("x", "x"), (None, "one two three four"), ("a 1 b", "a 2 c"), ("long enough", "s")]
    pairs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "id long, old_text string, new_text string")
    standing, candidate = replay.Config(min_chars=2, min_words=2), replay.Config(ignore=(("[0-9]+", "regex"),), min_chars=0, min_words=1)
    found = sorted(tuple(r) for r in replay.replay_bodies(pairs, ["id"], standing, candidate).collect())
    assert aligned == [6]  # 0, 1, 3 and 4 as they stand, 4 also without numbers, and 5 for the candidate alone
    alone = replay.replay(replay.try_config(pairs, ["id"], standing), replay.try_config(pairs, ["id"], candidate), ["id"])
    assert found == sorted(tuple(r) for r in alone.collect())
    assert found == [("alert", "alert", 2), ("below_threshold", "alert", 1), ("below_threshold", "unchanged", 1), ("too_short", "alert", 1), ("unchanged", "unchanged", 1)]


def test_json_lines_of_a_long_string(spark):
    """A string was matched character by character, which took time and overflowed the stack."""
    long = "x" * 300_000
    body = '{"b":[{},[],1.5,"u:v, [w]{\\"",null],"a":"%s","c,":{"d:":-1}}' % long
    rows = spark.createDataFrame([(1, body), (2, "no { json\n  two "), (3, None), (4, "7"), (5, "[]")], "id long, body string")
    got = dict(tuple(r) for r in rows.select("id", J.json_lines(F.col("body"))).collect())
    assert got[1] == ["{", f'"a": "{long}",', '"b": [', "{},", "[],", "1.5,", '"u:v, [w]{\\"",', "null", "],", '"c,": {', '"d:": -1', "}", "}"]
    assert (got[2], got[3], got[4], got[5]) == (["no { json", "two"], [], ["7"], ["[]"])


def test_json_leaves_stand_in_place_unsorted(spark):
    def leaves(x, name=""):
        below = [(f"{name}.{k}" if name else k, x[k]) for k in sorted(x)] if isinstance(x, dict) else [(f"{name}[{i}]", y) for i, y in enumerate(x)] if isinstance(x, list) else []
        return [z for n, y in below for z in leaves(y, n)] if below else [(name, x if isinstance(x, str) else json.dumps(x, separators=(",", ":")))]

    docs = [{"b": [1, {"c": [], "a": {"z": "t", "d": {}}}, [[2], 3]], "a": 4, "c": [{"k": i} for i in range(12)]}, [], {}, 5, "s", [[["x"]]]]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(docs)], "id long, body string")
    found = J.json_leaves(df, ["id"], "body")
    got = [tuple(r) for r in found.orderBy("id", "pos").collect()]
    assert got == [(k, i, n, v) for k, x in enumerate(docs) for i, (n, v) in enumerate(leaves(x))]
    assert "sort" not in found._jdf.queryExecution().optimizedPlan().toString()
