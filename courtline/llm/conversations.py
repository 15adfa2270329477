"""Repair of the turn structure of conversations by a generalised LR parse with weighted edits.

The roles of a conversation must form a sentence of a grammar over the initials of the roles:
nothing, or an optional system turn and then user and assistant turns in alternation. Each turn may
be kept, given another role or deleted, and empty turns may be inserted. All edits are tried at once
on a graph-structured stack: one LR stack for each sequence of edits, where stacks with equal tops
are merged into the one of the smallest (cost, audit). (Tops determine the whole stack in this
grammar, so merging loses nothing, and two edit sequences of equal cost over the same turns are never
one a beginning of the other, so a comparison made early stays right.)

A conversation of any length is cut into chunks of ``CHUNK`` turns by its turns' positions, a running
count that cuts hot conversations. A chunk is parsed from every stack that it can begin with, in a
task of its own; what is left to one task per conversation is to link these results, to cut the
chosen edits into chunks again, and, where a digest is asked for, to hash the texts in order, all
of them reading sorted rows one batch at a time.

Nulls in any column read as one space, but a null turn sorts first and stands in no gap, and a null
conversation id is a conversation of its own. Turns with equal numbers are ordered by role and a
digest of the text; repeated rows are duplicates of the first. A role that begins with none of the
grammar's letters, an empty one too, can only be given another role or deleted. A table without
conversations gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import Agg, running
from .common import has_word, step_table

GRAMMAR = {"C": ["", "P"], "P": ["Hua", "Pua"], "H": ["", "s"]}
START, END = "C", "$"
ROLES = {"u": "user", "a": "assistant"}  # roles that may be given and inserted
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
CHUNK = 4096
BLANK_CHARS = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"


# ---------------------------------------------------------------- the LR automaton

@lru_cache
def _closure(items: frozenset) -> frozenset:
    found, todo = set(items), list(items)
    while todo:
        head, body, dot = todo.pop()
        for production in GRAMMAR.get(body[dot:dot + 1], []):
            new = (body[dot], production, 0)
            if new not in found:
                found.add(new)
                todo.append(new)
    return frozenset(found)


@lru_cache
def _goto(state: frozenset, symbol: str) -> frozenset:
    return _closure(frozenset((h, b, d + 1) for h, b, d in state if b[d:d + 1] == symbol))


@lru_cache
def _first(symbol: str) -> frozenset:
    if symbol not in GRAMMAR:
        return frozenset(symbol)
    out = set()
    for body in GRAMMAR[symbol]:
        for x in body:
            if x != symbol:
                out |= _first(x)
            if "" not in GRAMMAR.get(x, []):
                break
    return frozenset(out)


@lru_cache
def _follow(symbol: str) -> frozenset:
    """Terminals after ``symbol``; every symbol that follows another one here begins with a terminal."""
    out = {END} if symbol == START else set()
    for head, bodies in GRAMMAR.items():
        for body in bodies:
            for i, x in enumerate(body):
                if x == symbol:
                    out |= _first(body[i + 1]) if i + 1 < len(body) else (_follow(head) if head != symbol else set())
    return frozenset(out)


BOTTOM = (("", _closure(frozenset((START, b, 0) for b in GRAMMAR[START]))),)


def _reduced(stack: tuple, follow: str | None) -> tuple:
    """Reductions on the next terminal ``follow``; None: only those of states that can do nothing else."""
    while True:
        state = stack[-1][1]
        ready = [(h, b) for h, b, d in state if d == len(b) and h != START
                 and (follow in _follow(h) if follow is not None else len(state) == 1)]
        if not ready:
            return stack
        (head, body), = ready  # the grammar is SLR(1): at most one
        stack = stack[:len(stack) - len(body)]
        stack = (*stack, (head, _goto(stack[-1][1], head)))


def shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack after reading ``symbol``, or None where the grammar doesn't allow it."""
    stack = _reduced(stack, symbol)
    state = _goto(stack[-1][1], symbol)
    return _reduced((*stack, (symbol, state)), None) if state else None


def accepts(stack: tuple) -> bool:
    state = _reduced(stack, END)[-1][1]
    return any(h == START and d == len(b) for h, b, d in state)


@lru_cache
def tables() -> tuple[list[dict[str, int]], list[bool]]:
    """All stacks that can stand between two turns, numbered by first appearance (0: the empty one): for each the
    number of the stack after each possible terminal, and whether a conversation may end with it."""
    found, after = [BOTTOM], []
    for stack in found:
        nexts = {x: s for x in "sua" if (s := shift(stack, x))}
        found += [s for s in dict.fromkeys(nexts.values()) if s not in found]
        after.append({x: found.index(s) for x, s in nexts.items()})
    return after, [accepts(s) for s in found]


# ---------------------------------------------------------------- the graph-structured stack

def _offer(tops: dict[int, tuple[int, str]], stack: int, cost: int, audit: str) -> None:
    if stack not in tops or (cost, audit) < tops[stack]:
        tops[stack] = (cost, audit)


def with_inserts(tops: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """The tops and what inserted turns make of them."""
    after, _ = tables()
    out, new = dict(tops), tops
    while new:
        more: dict = {}
        for stack, (cost, audit) in new.items():
            for x in ROLES:
                if x in after[stack]:
                    _offer(more, after[stack][x], cost + INSERT, audit + "I")
        new = {s: v for s, v in more.items() if s not in out or v < out[s]}
        out |= new
    return out


@lru_cache(maxsize=None)
def _edits(stack: int, symbol: str) -> tuple:
    """(stack, cost, letter) of every edit of a turn; ``symbol``: k kept as it is, t truncated, d to be deleted, and its initial."""
    after, out = tables()[0][stack], [(stack, DELETE, "D")]
    if symbol[0] != "d":
        late = TRUNCATED if symbol[0] == "t" else 0
        out += [(after[symbol[1]], KEEP + late, "K")] if symbol[1] in after else []
        out += [(after[x], REROLE + late, "R") for x in ROLES if x in after]
    return tuple(out)


def parse(symbols: str, start: int) -> dict[int, tuple[int, str]]:
    """Tops after the turns of ``symbols`` (two letters each) begun at ``start``: stack to (cost, audit)."""
    tops, settled = {start: (0, "")}, []
    for i in range(0, len(symbols), 2):
        after: dict = {}
        for stack, (cost, audit) in with_inserts(tops).items():
            for s, more, letter in _edits(stack, symbols[i:i + 2]):
                _offer(after, s, cost + more, audit + letter)
        tops = after
        if i % 128 == 126:  # what all audits begin with is settled
            shared = commonprefix([a for _, a in tops.values()])
            settled.append(shared)
            tops = {s: (c, a[len(shared):]) for s, (c, a) in tops.items()}
    return {s: (c, "".join(settled) + a) for s, (c, a) in tops.items()}


def best(tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """(cost, audit) of the best finished conversation."""
    return min(v for s, v in with_inserts(tops).items() if tables()[1][s])


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def pieces(audit: str, size: int) -> Iterator[tuple[str, int]]:
    """An audit cut after every ``size`` turns, inserts with the turn that they precede, those at the end with the last;
    with each piece the place of its first turn among the user and assistant turns that are left. A system turn is
    there exactly when the number of all turns left is odd."""
    begin, turns, left = 0, 0, -((len(audit) - audit.count("D")) % 2)
    last = len(audit.rstrip("I"))
    for i, letter in enumerate(audit[:last]):
        turns += letter != "I"
        if turns == size and i + 1 < last:
            yield audit[begin:i + 1], left
            left += i + 1 - begin - audit.count("D", begin, i + 1)
            begin, turns = i + 1, 0
    yield audit[begin:], left


# ---------------------------------------------------------------- Spark

def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) after the damage by crc32 of ``conv:turn`` modulo 20."""
    key = "concat(coalesce(CAST(conv AS string), ' '), ':', coalesce(CAST(turn AS string), ' '))"
    return (rows.selectExpr("conv", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32({key}) % 20 AS damage")
            .where("damage <> 0")
            .selectExpr("conv", "turn", "if(damage = 4, 'user', role) AS role",
                        "CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
                        "explode(if(damage = 3, array(0, 1), array(0))) AS copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (row, conv, turn, role, text, copy) with position, fault and parse symbol, without their texts."""
    ended = f"substr(trim(TRAILING '{BLANK_CHARS}' FROM text), -1, 1)"
    narrow = rows.select("row", "conv", "turn", "role", "copy", F.md5("text").alias("mark"), (~has_word(F.col("text"))).alias("empty"),
                         F.expr(f"{ended} NOT IN ('.', '!', '?')").alias("open"))
    # turns without a number sort first: the order begins with a column that is never null
    placed = step_table(running(narrow.withColumn("numbered", F.col("turn").isNotNull()), ["conv"], ["numbered", "turn", "role", "mark", "copy"],
                                [Agg("pos", "count", F.lit(1))]))
    first = placed.groupBy("conv", "role", "mark").agg(F.min("pos").alias("first_pos"))
    joined = placed.alias("p").join(first.alias("f"), F.expr("p.conv <=> f.conv AND p.role = f.role AND p.mark = f.mark"))
    fault = "CASE WHEN empty THEN 'blank' WHEN pos > first_pos THEN 'duplicate' WHEN open THEN 'truncated' END"
    initial = "if(substr(p.role, 1, 1) IN ('s', 'u', 'a'), substr(p.role, 1, 1), '-')"
    return joined.selectExpr("row", "p.conv", "pos", "turn", f"{fault} AS fault", f"{initial} AS initial").selectExpr(
        "*", "concat(CASE fault WHEN 'truncated' THEN 't' WHEN 'blank' THEN 'd' WHEN 'duplicate' THEN 'd' ELSE 'k' END, initial) AS symbol")


def plans(faulty: DataFrame) -> DataFrame:
    """Per conversation the cheapest edits: a row per chunk with its ``piece`` of the audit and the place where it
    ``begins``, and, at chunk -1, the whole (cost, illegal, audit)."""
    chunks = faulty.groupBy("conv", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))
    size = CHUNK

    def parse_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(4096)
        def moves(symbols: str, first: bool) -> list[dict]:
            starts = [0] if first else range(len(tables()[0]))
            return [{"start": i, "end": s, "cost": c, "audit": a} for i in starts for s, (c, a) in parse(symbols, i).items()]

        for batch in batches:
            for one in (batch.slice(i, 16) for i in range(0, len(batch), 16)):
                symbols = one.column("symbols").to_pylist()
                found = [moves(s, c == 0) for s, c in zip(symbols, one.column("chunk").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [one.column("conv"), one.column("chunk"), pa.array([s[1::2] for s in symbols], pa.string()), pa.array(found, moves_type)],
                    ["conv", "chunk", "initials", "moves"])

    moves_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    parsed = chunks.mapInArrow(parse_chunks, "conv long, chunk long, initials string, moves array<struct<start int, end int, cost long, audit string>>")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished():
            cost, audit = best(tops)
            audit = "".join(settled) + audit
            out = [(conv, chunk, piece, left, None, None, None) for chunk, (piece, left) in enumerate(pieces(audit, size))]
            return [*out, (conv, -1, None, None, cost, illegal, audit)]

        def out_batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        schema = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("piece", pa.string()), ("begins", pa.int64()),
                            ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())])
        conv, tops, settled, illegal, last, rows = None, None, [], 0, "", []
        for batch in batches:
            for r in batch.to_pylist():
                if tops is None or r["conv"] != conv:
                    if tops is not None:
                        rows += finished()
                    conv, tops, settled, illegal, last = r["conv"], {0: (0, "")}, [], 0, ""
                after: dict = {}
                for m in r["moves"]:
                    if m["start"] in tops:
                        cost, audit = tops[m["start"]]
                        _offer(after, m["end"], cost + m["cost"], audit + m["audit"])
                shared = commonprefix([a for _, a in after.values()])
                settled.append(shared)
                tops = {s: (c, a[len(shared):]) for s, (c, a) in after.items()}
                illegal += illegal_pairs(last + r["initials"])
                last = r["initials"][-1:]
            if rows:
                yield out_batch(rows)
                rows = []
        if tops is not None:
            yield out_batch(finished())

    in_order = parsed.repartition("conv").sortWithinPartitions("conv", "chunk")
    return step_table(in_order.mapInArrow(link, "conv long, chunk long, piece string, begins long, cost long, illegal long, audit string"))


def repaired(rows: DataFrame, faulty: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns after the edits: conv, chunk, at (their order in it), role, text. Each chunk is edited by itself."""
    texts = rows.select("row", "role", "text").join(faulty.select("row", "conv", "pos"), "row").selectExpr(
        "conv", f"pos div {CHUNK} AS chunk", "pos", "role", "text", "CAST(NULL AS string) AS piece", "CAST(NULL AS long) AS begins")
    told = plan.where("chunk >= 0").selectExpr("conv", "chunk", "-1L AS pos", "CAST(NULL AS string) AS role", "CAST(NULL AS string) AS text",
                                               "piece", "begins")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "chunk", "pos", "role", "text", "piece", "begins"]
        piece, i, at, begins, last = "", 0, 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, chunk, pos, role, text, told_piece, told_begin in zip(*(batch.column(c).to_pylist() for c in names)):
                if pos < 0:  # comes before the chunk's turns
                    piece, begins, i, at, last = told_piece, told_begin, 0, 0, len(told_piece.rstrip("I"))
                    continue
                turn = next(j for j in range(i, last) if piece[j] != "I")
                stop = len(piece) if turn + 1 == last else turn + 1
                for letter in piece[i:stop]:
                    if letter != "D":
                        due = list(ROLES.values())[(begins + at) % 2]
                        out.append((conv, chunk, at, role if letter == "K" else due, "" if letter == "I" else text))
                        at += 1
                i = stop
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 ["conv", "chunk", "at", "role", "text"])

    in_order = texts.unionByName(told).repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
    return in_order.mapInArrow(edit, "conv long, chunk long, at long, role string, text string")


def hashed(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256: hash of the turns as role:text, joined by newlines. Reads sorted turns; a hash is one
    chain per conversation."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())],
                                              ["conv", "repaired_sha256"])
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if digest is not None and c == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            if done:
                yield out(done)
        if digest is not None:
            yield out([(conv, digest.hexdigest())])

    return turns.repartition("conv").sortWithinPartitions("conv", "chunk", "at").mapInArrow(fold, "conv long, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Per original conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256;
    ``damage`` first breaks the table by ``damaged``."""
    source = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", "text")
    broken = damaged(source) if damage else source.selectExpr("conv", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", "0 AS copy")
    rows = step_table(broken.withColumn("row", F.monotonically_increasing_id()))
    faulty = step_table(faults(rows))
    plan = plans(faulty)
    digests = hashed(repaired(rows, faulty, plan))
    counts = faulty.groupBy("conv").agg(
        F.expr("coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps"),
        *[F.expr(f"count_if(fault = '{f}') AS {f}") for f in ("blank", "duplicate", "truncated")])
    wholes = plan.where("chunk = -1").select("conv", "cost", "illegal", "audit")
    ids = source.select("conv").distinct().alias("i")
    out = (ids.join(counts.alias("c"), F.expr("i.conv <=> c.conv"), "left").join(wholes.alias("w"), F.expr("i.conv <=> w.conv"), "left")
           .join(digests.alias("d"), F.expr("i.conv <=> d.conv"), "left"))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.selectExpr("i.conv AS conv_id", *[f"coalesce({c}, 0L) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                          "coalesce(audit, '') AS audit", f"coalesce(repaired_sha256, '{nothing}') AS repaired_sha256")
