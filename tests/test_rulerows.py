"""Rules as rows against plain loops over Python's regular expressions."""

import itertools
import random
import re

from chronodiff.operators import align, rulerows

WORDS = ["sale", "Sale", "in stock", "stock", "sto", "1,099", "42", "über", "x_y", "the", "theme", "aa", "aaa", "İ", "end."]


def pattern(rule):
    term = re.escape(rule["term"])
    return re.compile({"substr": term, "word": rf"(?<!\w){term}(?!\w)"}.get(rule.get("kind", "substr"), rule["term"]), re.I | re.M)


def matches(rule, text):
    out = []
    for m in pattern(rule).finditer(text):
        if rule.get("kind") == "num":
            x = float(m.group(1).replace(",", ""))
            if not {"<": x < rule["value"], ">=": x >= rule["value"]}[rule["op"]]:
                continue
        out.append(m.span())
    return out


def plain(rules, changes, page):
    """Names of the rules that fire, from the meaning of their rows."""
    names = []
    hit = lambda r, text, spans: [(a, b) for a, b in matches(r, text) if any(a < e and s < b for s, e in spans)]
    words = [m.start() for m in re.finditer(r"\S+", "\n".join(t for t, _ in changes))]
    for name, rows in itertools.groupby(sorted(rules, key=lambda r: r["rule"]), key=lambda r: r["rule"]):
        rows = list(rows)
        yes = [r for r in rows if not r.get("negated") and not r.get("page")]
        if any(r.get("negated") and (bool(matches(r, page)) if r.get("page") else any(hit(r, *c) for c in changes)) for r in rows):
            continue
        if any(r.get("page") and not r.get("negated") and not matches(r, page) for r in rows):
            continue
        scope = yes[0].get("scope", "any")
        if scope == "any":
            good = all(any(hit(r, *c) for c in changes) for r in yes)
        elif scope == "block":
            good = any(all(hit(r, *c) for r in yes) for c in changes)
        else:
            spots, base = [[] for _ in yes], 0
            for text, spans in changes:
                for k, r in enumerate(yes):
                    spots[k] += [max(0, sum(w <= base + a for w in words) - 1) for a, _ in hit(r, text, spans)]
                base += len(text) + 1
            good = all(spots) and min(max(c) - min(c) for c in itertools.product(*spots)) <= yes[0]["near"]
        if good:
            names.append(name)
    return names


def test_rules_fire_as_their_rows_say(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))
    pairs = [(k, [line() for _ in range(rng.randrange(6))], [line() for _ in range(rng.randrange(7))]) for k in range(40)]
    pairs += [(100, ["Out of stock"], ["In stock"]), (101, ["now 12:00 sale today"], ["now 12:01 sale today"])]
    rules = []
    for k in range(60):
        scope = rng.choice(["any", "any", "block", "near"])
        for term in rng.sample(["sale", "in stock", "sto", "the", "aa", "ü", "x_y", "end"], rng.randrange(2, 4)):
            rules.append({"rule": f"r{k}", "term": term, "kind": rng.choice(["substr", "word"]), "scope": scope, "near": rng.randrange(1, 6) if scope == "near" else None})
        near = {r["near"] for r in rules if r["rule"] == f"r{k}"}
        for r in rules:
            if r["rule"] == f"r{k}":
                r["near"] = max((x for x in near if x), default=None)
        if k % 3 == 0:
            rules.append({"rule": f"r{k}", "term": rng.choice(["theme", "42"]), "negated": True, "page": k % 2 == 0, "scope": scope})
        if k % 4 == 0:
            rules.append({"rule": f"r{k}", "term": rng.choice(["sale", "42"]), "page": True, "scope": scope})
    rules += [{"rule": "number", "term": r"(\d[\d,]*)", "kind": "num", "op": ">=", "value": 1000.0}, {"rule": "small", "term": r"(\d[\d,]*)", "kind": "num", "op": "<", "value": 50.0, "gates": False}, {"rule": "re", "term": "^s.*k$", "kind": "regex"}]
    for r in rules:
        if r.get("negated") or r.get("page"):
            r["scope"] = next(x["scope"] for x in rules if x["rule"] == r["rule"])
    frame = spark.createDataFrame(pairs, "id int, old_blocks array<string>, new_blocks array<string>")
    changes = rulerows.changed_spans(align.align_blocks(frame, ["id"]), ["id"]).persist()
    pages = spark.createDataFrame([(k, "\n".join(new)) for k, _, new in pairs], "id int, text string")
    found = rulerows.fired(changes, rulerows.rule_rows(spark, rules), ["id"], ["op", "k"], pages)
    got = {r["id"]: r["marks"] for r in rulerows.rule_hits(found, ["id"]).collect()}
    own = {}
    for r in changes.orderBy("id", "op", "k").collect():
        own.setdefault(r["id"], []).append((r["text"], [(s["s"], s["e"]) for s in r["spans"]]))
    for k, _, new in pairs:
        want = plain(rules, own.get(k, []), "\n".join(new))
        assert got.get(k, []) == want, (k, own.get(k), [r for r in rules if r["rule"] in set(got.get(k, [])) ^ set(want)][:4])
    assert "small" not in {h for r in rulerows.rule_hits(found, ["id"]).collect() for h in r["hits"]}
    spans = {k: own[k] for k in (100, 101)}
    assert spans == {100: [("In stock", [(0, 2)])], 101: [("now 12:01 sale today", [(7, 9)])]}


def test_spans_of_runs_and_whole_blocks(spark):
    pairs = [(1, ["a one", "b two"], ["a 1 more", "b two", "c three"]), (2, ["x y"], ["x y z\tw", "new line"]), (3, [], ["all new"]), (4, ["gone"], [])]
    frame = spark.createDataFrame(pairs, "id int, old_blocks array<string>, new_blocks array<string>")
    rows = rulerows.changed_spans(align.align_blocks(frame, ["id"]), ["id"]).orderBy("id", "op", "k").collect()
    changed = [(r["id"], r["text"], [r["text"][s["s"] : s["e"]] for s in r["spans"]]) for r in rows]
    assert changed == [(1, "a 1 more", ["1 more"]), (1, "c three", ["c three"]), (2, "x y z\tw", ["z\tw"]), (2, "new line", ["new line"]), (3, "all new", ["all new"])]


def test_ten_thousand_rules_are_one_plan(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"term{k} and term{k * 7 % 10_000}x", None) for k in range(200)] + [(-1, None, None), (-2, "", None)], "id int, text string, extra int")
    few, many = ([{"rule": f"r{k}", "term": f"term{k}", "kind": "word"} for k in range(n)] for n in (10, 10_000))
    plans = []
    for rules in (few, many):
        found = rulerows.term_matches(texts, rulerows.rule_rows(spark, rules), ["id"])
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert found.count() == 200 and plans[1] < 2 * plans[0]
    monkeypatch.setattr(rulerows, "SLICE", 3000)
    assert rulerows.term_matches(texts, rulerows.rule_rows(spark, many), ["id"]).count() == 200
    assert rulerows.term_matches(texts, rulerows.rule_rows(spark, []), ["id"]).count() == 0


def test_matches_are_not_dealt_by_their_term(spark):
    """A shuffle by term has all matches of a frequent word in one task, whose memory grows with the input."""
    import re

    rules = rulerows.rule_rows(spark, [
        {"rule": "any", "term": "the", "kind": "word"}, {"rule": "near", "term": "the", "kind": "word", "scope": "near", "near": 3},
        {"rule": "near", "term": "of", "kind": "word", "scope": "near", "near": 3}, {"rule": "not", "term": "the"}, {"rule": "not", "term": "tion", "negated": True},
        {"rule": "page", "term": "the"}, {"rule": "page", "term": "from", "page": True}, {"rule": "large", "term": r"(\d+)", "kind": "num", "op": ">", "value": 9.0},
    ])
    changes = spark.createDataFrame([(k, 0, f"the end of the line {k}", [(0, 30)]) for k in range(20)], "id int, pos int, text string, spans array<struct<s:int,e:int>>")
    pages = spark.createDataFrame([(k, "from the page") for k in range(0, 20, 2)], "id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark takes for large is not left to its estimates
    try:
        found = rulerows.fired(changes, rules, ["id"], ["pos"], pages)
        matches = rulerows.term_matches(changes, rules, ["id"])
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (found, matches)]
        got = {(r["id"], r["rule"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [x for plan in plans for x in re.findall(r"SortMergeJoin \[term_id#.*", plan)]
    assert got == {(k, r) for k in range(20) for r in ("any", "near", "not")} | {(k, "page") for k in range(0, 20, 2)} | {(k, "large") for k in range(10, 20)}
