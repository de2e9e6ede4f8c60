"""Repair of conversations: cheapest edits by a Viterbi search that emits what all survivors agree on.

Rows are put in one global order, so that a conversation may lie over many
partitions, and each becomes one code (role class and fault). The search sees
codes alone, a byte a row, in pieces of bounded length, and returns edits by
piece; these are joined back to the rows, wherever they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import cut, small_batches

#: Rows of a piece, as a power of two: what one group of codes and one row of edits hold at most.
PIECE_BITS = 12
#: White space: space, tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: Costs of the edits (fixed values): keep, rerole, delete, insert; and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, STAYS = 0, 2, 3, 2, 1

#: States: nothing yet, system, user and assistant put out last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an insertion or a rerole makes in each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Insertions that lead from one state to another.
INSERTIONS = {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1}
LETTERS = "-sua"
#: Role classes of a code: initials s, u, a, and any other. Faults: none, blank, duplicate, truncated.
OTHER, NONE, BLANK, DUPLICATE, TRUNCATED = 3, 0, 1, 2, 3
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _moves(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of a row: its insertions, then its own edit.

    A deletion takes no insertions before it: after it they cost the same and sort lower.
    """
    kind, fault = divmod(code, 4)
    out = [(q, q, DELETE, "D") for q in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = STAYS if fault == TRUNCATED else 0
    for q in range(4):
        for at, n in [(q, 0)] + [(b, n) for (a, b), n in INSERTIONS.items() if a == q]:
            paid = INSERT * n + more
            out.append((q, NEXT[at], paid + REROLE, "I" * n + "R"))
            if kind == 0 and at == START:
                out.append((q, SYSTEM, paid + KEEP, "K"))
            if kind + 1 == NEXT[at]:
                out.append((q, NEXT[at], paid + KEEP, "I" * n + "K"))
    return out


MOVES = [_moves(code) for code in range(16)]


class _Node:
    """A run of equal edits in the tree of survivors, the run before it, and how many hold on to it."""

    __slots__ = ("up", "edit", "times", "refs")

    def __init__(self, up: _Node | None, edit: str):
        self.up, self.edit, self.times, self.refs = up, edit, 1, 1
        if up is not None:
            up.refs += 1


def _release(node: _Node) -> None:
    node.refs -= 1
    while not node.refs and node.up is not None:
        node = node.up
        node.refs -= 1


class Survivors:
    """The cheapest path into each state, ties to the ASCII-least edits.

    Paths hang in a tree of back pointers with reference counts. As soon as
    the root has one child and is no path's end, all survivors share that child,
    and it is emitted. The order of the complete unresolved suffixes is carried
    as a rank: two different paths over the same rows differ in some edit before
    either ends, so the rank before and the next edits decide.
    """

    def __init__(self):
        self.root = _Node(None, "")
        self.tips: dict[int, tuple[int, int, _Node]] = {START: (0, 0, self.root)}

    def step(self, code: int) -> None:
        tips, best = self.tips, {}
        for q, p, c, edit in MOVES[code]:
            if q in tips:
                cost, rank, _ = tips[q]
                found = (cost + c, rank, edit, q)
                if p not in best or found < best[p]:
                    best[p] = found
        for p in [p for p in best if self._idle(best, p)]:
            del best[p]
        used = [b[3] for b in best.values()]
        new = {}
        for rank, p in enumerate(sorted(best, key=lambda p: best[p][1:3])):
            cost, _, edit, q = best[p]
            node = tips[q][2]
            if node.refs == 1 and node.edit == edit and node is not self.root and used.count(q) == 1:
                node.times += 1
                node.refs += 1  # its old end is released below
                new[p] = (cost, rank, node)
            else:
                new[p] = (cost, rank, _Node(node, edit))
        for _, _, node in tips.values():
            _release(node)
        self.tips = new

    @staticmethod
    def _idle(best: dict[int, tuple], p: int) -> bool:
        """Whether another path can do all that this one can, for less, or for as much and with lesser edits."""
        cost, order = best[p][0], best[p][1:3]
        for q, other in best.items():
            if q == p:
                continue
            n = INSERTIONS.get((q, p))
            if n is None and p == SYSTEM and q == ASSISTANT:
                n = 0  # an assistant's turn may be followed by whatever may follow the system's
            if n is None and p == START and q == ASSISTANT and cost > other[0] + DELETE:
                return True  # a system row is the only one that the start can keep and this cannot
            if n is not None and (other[0] + INSERT * n, other[1:3]) < (cost, order):
                return True
        return False

    def settled(self) -> list[tuple[str, int]]:
        """Runs of edits that all survivors share, and that were not returned before."""
        out = []
        if self.root.refs == 1 and self.root is not next(iter(self.tips.values()))[2]:
            ends = {id(node) for _, _, node in self.tips.values()}
            path, node = [], next(iter(self.tips.values()))[2]
            while node is not self.root:
                path.append(node)
                node = node.up
            while path and self.root.refs == 1 and id(self.root) not in ends:
                node = path.pop()
                if id(node) in ends:
                    break
                out.append((node.edit, node.times))
                node.up, node.edit, self.root = None, "", node
        return out

    def finish(self) -> tuple[int, list[tuple[str, int]], int]:
        """Cost, the edits that are left, and how many insertions end the conversation."""
        ends = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, _, n, node = min(((c + INSERT * ends[q], rank, ends[q], node) for q, (c, rank, node) in self.tips.items()), key=lambda x: x[:3])
        out = []
        while node is not self.root:
            out.append((node.edit, node.times))
            node = node.up
        return cost, out[::-1], n


class _Conversation:
    """One conversation on its way through the search: pieces whose edits are not all known wait in order."""

    def __init__(self, conv):
        self.conv, self.search, self.waiting = conv, Survivors(), []
        self.edits: list[tuple[str, int]] = []
        self.known, self.state, self.last = 0, START, None

    def add(self, first: int, block: int, codes: bytes) -> list[dict]:
        faults = [0] * 4
        illegal = 0
        for c in codes:
            kind = c >> 2
            faults[c & 3] += 1
            illegal += self.last is not None and (self.last, kind) not in LEGAL
            self.last = kind
            self.search.step(c)
        self.waiting.append((first, block, codes, *faults[1:], illegal))
        self._take(self.search.settled())
        return self._ready()

    def _take(self, runs: list[tuple[str, int]]) -> None:
        self.edits += runs
        self.known += sum(n for _, n in runs)

    def _ready(self) -> list[dict]:
        out = []
        while self.waiting and len(self.waiting[0][2]) <= self.known:
            first, block, codes, blank, duplicate, truncated, illegal = self.waiting.pop(0)
            edits: list[str] = []
            while len(edits) < len(codes):
                edit, n = self.edits.pop(0)
                take = min(n, len(codes) - len(edits))
                edits += [edit] * take
                if take < n:
                    self.edits.insert(0, (edit, n - take))
            self.known -= len(codes)
            out.append({
                "conv": self.conv, "first": first, "block": block, "edits": edits, "roles": [self._roles(e, c >> 2) for e, c in zip(edits, codes, strict=True)],
                "tail": "", "cost": 0, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
            })
        return out

    def _roles(self, edits: str, kind: int) -> str:
        out = ""
        for e in edits:
            if e != "D":
                self.state = SYSTEM if e == "K" and kind == 0 else NEXT[self.state]
                out += LETTERS[self.state]
        return out

    def end(self) -> list[dict]:
        cost, runs, n = self.search.finish()
        self._take(runs)
        out = self._ready()
        out[-1]["cost"] = cost
        out[-1]["tail"] = self._roles("I" * n, OTHER)
        return out


def _edit(kind: pa.DataType):
    fields = pa.schema([
        ("conv", kind), ("first", pa.int64()), ("block", pa.int64()), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("tail", pa.string()),
        *((c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, first, block, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    out += now.end() if now is not None else []
                    now = _Conversation(conv)
                out += now.add(first, block, bytes(ord(c) - 97 for c in codes))
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out = []
        out += now.end() if now is not None else []
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    return work


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults put in, by the CRC-32 of ``conv:turn``: a trial of ``repair``.

    Remainder 0 of 20 drops the row, 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats the row, 4 makes its role ``user``.
    Null is one space in the number's text, and as role and text; a null turn
    stays null. Other columns go.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    hit = F.crc32(F.encode(F.concat(space(conv), F.lit(":"), space(turn)), "UTF-8")) % 20
    out = rows.select(conv.alias("conv"), turn.alias("turn"), space(role).alias("role"), space(text).alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    out = out.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return out.select(*(F.col(a).alias(b) for a, b in (("conv", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))))


def _class(role: Column) -> Column:
    """The number of the role's initial among s, u, a; 3 for any other."""
    at = F.instr(F.lit("sua"), F.substring(role, 1, 1))
    return F.when((role == "") | (at == 0), OTHER).otherwise(at - 1)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns): what is wrong with each conversation, and its rows after the cheapest edits.

    The report has ``conv_col``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost`` and ``audit``; the turns ``conv_col``, ``place``, ``k``
    (their order), ``role`` and ``text``. A row's first fault counts: blank (white
    space alone), duplicate (role and text seen earlier in the conversation),
    truncated (last other character none of ``.!?``). Edits are Keep (0), Rerole
    to user or assistant (2), Delete (3, required for blank and duplicate rows)
    and Insert of an empty user's or assistant's turn (2); a truncated row that
    stays adds 1. They lead to roles ``(s?(ua)+)?`` at the least cost; of equal
    costs the ASCII-least initials are the audit.

    A conversation is ordered by turn, nulls first; rows of one turn by role and
    text, which puts repeated rows side by side. It may be of any length: its rows lie over
    range partitions, the search streams a byte a row and keeps only what its
    survivors do not share, and only the audit, one string, is put together whole.
    Defined cases: null roles and texts count as one space (so the row is blank);
    rows without a conversation are one conversation; very long texts stay in
    their rows; an empty table gives empty results; other columns are not read.
    """
    small_batches(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # the first characters order as whole texts do, and keep the sample that finds the ranges small
    own = own.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    bare = F.expr(f"rtrim('{BLANKS}', text)")
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(*".!?"), NONE).otherwise(TRUNCATED)
    same = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    own = cut(own.select("*", _class(F.col("role")).alias("kind"), fault.alias("fault"), same.alias("same"), F.monotonically_increasing_id().alias("place")), "turns")

    firsts = own.where(F.col("fault") != BLANK).groupBy("conv", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    code = F.when(F.col("fault") == BLANK, BLANK).when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault")) + 4 * F.col("kind")
    block = F.shiftright("place", PIECE_BITS)
    codes = own.select("conv", "place", "kind", "fault").join(firsts, "place", "left").select("conv", "place", F.char(97 + code).alias("code"))
    pieces = codes.groupBy("conv", block.alias("block")).agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "code"))).alias("codes"))
    pieces = pieces.select("conv", "first", "block", F.array_join(F.col("codes.code"), "").alias("codes"))
    kind = own.schema["conv"].dataType.simpleString()
    counts = ("cost", "blank", "duplicate", "truncated", "illegal")
    from pyspark.sql.pandas.types import to_arrow_type

    work = _edit(to_arrow_type(own.schema["conv"].dataType))
    edits = pieces.repartition("conv").sortWithinPartitions("conv", "first")
    edits = cut(edits.mapInArrow(work, f"conv {kind}, first long, block long, edits array<string>, roles array<string>, tail string, {', '.join(f'{c} long' for c in counts)}"), "edits")

    written = F.concat(F.array_join("edits", ""), F.repeat(F.lit("I"), F.length("tail")))
    audit = F.array_join(F.array_sort(F.collect_list(F.struct("first", written.alias("e")))).getField("e"), "")
    gaps = F.coalesce((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long"), F.lit(0).cast("long"))
    report = edits.groupBy("conv").agg(*(F.sum(c).alias(c) for c in counts), audit.alias("audit"))
    spans = own.groupBy("conv").agg(gaps.alias("gaps")).withColumnRenamed("conv", "c")
    report = report.join(spans, F.col("conv").eqNullSafe(F.col("c"))).select(F.col("conv").alias(conv_col), "gaps", *counts[1:], "cost", "audit")

    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    added = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: turn(name(x), F.lit("")))
    part = edits.select(F.col("conv").alias("c"), F.col("block").alias("b"), "first", "edits", "roles", "tail")
    rows_ = own.select("conv", "place", "role", "text").withColumn("block", block)
    rows_ = rows_.join(part, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    at = (F.col("place") - F.col("first") + 1).cast("int")
    rows_ = rows_.select("conv", "place", "role", "text", F.element_at("edits", at).alias("edit"), F.element_at("roles", at).alias("to"), F.when(at == F.size("edits"), F.col("tail")).otherwise("").alias("tail"))
    stays = F.when(F.col("edit").endswith("K"), F.array(turn(F.col("role"), F.col("text")))).when(F.col("edit").endswith("R"), F.array(turn(name(F.right("to", F.lit(1))), F.col("text"))))
    before = added(F.expr("substring(to, 1, length(edit) - 1)"))
    whole = F.concat(before, F.coalesce(stays, F.array().cast("array<struct<role:string,text:string>>")), added(F.col("tail")))
    turns = rows_.select("conv", "place", F.posexplode(whole).alias("k", "t")).select(F.col("conv").alias(conv_col), "place", "k", "t.role", "t.text")
    return report, turns


def _hash(kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda conv, h: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([h.hexdigest()])], ["conv", "sha256"])
        conv, now = None, None
        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        yield one(conv, now)
                    conv, now = c, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
        if now is not None:
            yield one(conv, now)

    return work


def digest(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col`` and ``sha256`` of its repaired ``role:text`` lines, joined by line feeds.

    SHA-256 goes over its bytes one after the other, so a conversation is hashed
    by one task; rows stream through it, sorted, and it holds one batch of them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = turns.withColumnRenamed(conv_col, "conv").select("conv", "place", "k", "role", "text").repartition("conv").sortWithinPartitions("conv", "place", "k")
    kind = rows.schema["conv"].dataType
    out = rows.select("conv", "role", "text").mapInArrow(_hash(to_arrow_type(kind)), f"conv {kind.simpleString()}, sha256 string")
    return out.withColumnRenamed("conv", conv_col)
