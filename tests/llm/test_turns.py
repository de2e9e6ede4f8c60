"""Repair of conversations, against plain searches over whole edit strings."""

import hashlib
import itertools
import random
import zlib

import pytest

from chronodiff.llm import queries as q
from chronodiff.llm import turns

BLANKS = " \t\n\x0b\f\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, edits, repaired rows): every state's best whole edit string, by plain comparison."""
    best = {"": (0, "", ())}

    def keep(into, state, path):
        if state not in into or path[:2] < into[state][:2]:
            into[state] = path

    def insertions(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, edits, done) in list(out.items()):
                keep(out, AFTER[state], (cost + 2, edits + "I", done + ((("user" if AFTER[state] == "u" else "assistant"), ""),)))
        return out

    for (role, text), fault in zip(rows, found, strict=True):
        new = {}
        for state, (cost, edits, done) in insertions(best).items():
            keep(new, state, (cost + 3, edits + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] == AFTER[state] or (role[:1] == "s" and state == ""):
                keep(new, role[0], (cost + more, edits + "K", done + ((role, text),)))
            keep(new, AFTER[state], (cost + 2 + more, edits + "R", done + (("user" if AFTER[state] == "u" else "assistant", text),)))
        best = new
    ends = insertions(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    """{conv: report} of (conv, turn, role, text) rows, damaged first."""
    space = lambda x: " " if x is None else x
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text, hit = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            if hit:
                text = "" if hit == 1 else text.translate({46: None, 33: None, 63: None}) if hit == 2 else text
                own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain = [(r, t) for _, r, t in own]
        found, some = faults(plain), {t for t, _, _ in own if t is not None}
        gaps = max(some) - min(some) + 1 - len(some) if some else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        cost, audit, done = cheapest(plain, found)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in q.op13_conversation_repair(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_BITS", 2)  # conversations of many pieces
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " \t", "a.", "a", "Yes! ", "What?\n", "no end", "x" * 50_000 + ".", "tie.", " ", f"n{rng.random()}."])
    role = lambda: rng.choice([None, "", "user", "assistant", "system", "tool", "umpire", "user", "assistant"])
    rows = [(c if c else None, rng.choice([None, *range(1 + c % 30)]), role(), text()) for c in range(60) for _ in range(rng.randrange(1, 3 + c % 40))]
    rows += rows[:40]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, conv int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in q.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == brute(rows)
    report, repaired = turns.repair(frame.limit(0))
    assert report.count() == 0 and repaired.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_least_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        codes = bytes(rng.choices(range(16), [1 if seed % 2 else rng.random() ** 3 for _ in range(16)], k=rng.randrange(1, 40)))
        rows = [("suat"[c >> 2], str(k)) for k, c in enumerate(codes)]
        cost, audit, done = cheapest(rows, [("", "blank", "duplicate", "truncated")[c & 3] for c in codes])
        talk = turns._Conversation(1)
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(3))})
        out = [row for a, b in itertools.pairwise(cuts) for row in talk.add(a, 0, codes[a:b])] + talk.end()
        assert ("".join("".join(r["edits"]) for r in out) + "I" * len(out[-1]["tail"]), out[-1]["cost"]) == (audit, cost)
        roles = "".join("".join(r["roles"]) for r in out) + out[-1]["tail"]
        assert roles == "".join(r[0] for r, _ in done)


def test_memory_follows_what_survivors_do_not_share():
    search, held = turns.Survivors(), 0

    def size():
        nodes = set()
        for _, _, node in search.tips.values():
            while node is not None and id(node) not in nodes:
                nodes.add(id(node))
                node = node.up
        return len(nodes)

    for k in range(20_000):  # clean turns, then deletions that keep several survivors apart, then foreign roles
        search.step([4, 8][k % 2] if k < 5000 else 1 if k < 10_000 else 12)
        search.settled()
        held = max(held, size())
    assert held < 40
