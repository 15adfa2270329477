"""Conversation repair against brute force: the automaton against the pattern, the parse against all edits, the
query against a plain recomputation, with conversations longer than a chunk and columns of nulls."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from courtline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, pos string, symbol string"
PATTERN = re.compile("(s?(ua)+)?")


def test_automaton_accepts_the_pattern():
    after, end = cv.tables()
    assert len(after) == 5
    for n in range(8):
        for word in map("".join, itertools.product("sua", repeat=n)):
            at = 0
            for x in word:
                at = after[at].get(x) if at is not None else None
            assert (at is not None and end[at]) == bool(PATTERN.fullmatch(word)), word


def brute(symbols):
    """All edits with up to two inserts before each turn and at the end."""
    out, turns = [], [symbols[i:i + 2] for i in range(0, len(symbols), 2)]

    def go(i, roles, cost, audit):
        if i > 0 and not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        for n in range(3):
            for extra in itertools.product("ua", repeat=n):
                r, c, a = roles + "".join(extra), cost + cv.INSERT * n, audit + "I" * n
                if i == len(turns):
                    if PATTERN.fullmatch(r):
                        out.append((c, a))
                    continue
                kind, initial = turns[i]
                go(i + 1, r, c + cv.DELETE, a + "D")
                if kind != "d":
                    late = cv.TRUNCATED if kind == "t" else 0
                    if initial in "sua":
                        go(i + 1, r + initial, c + late, a + "K")
                    for x in "ua":
                        go(i + 1, r + x, c + cv.REROLE + late, a + "R")

    go(0, "", 0, "")
    return min(out)


def test_pieces_of_an_audit():
    assert list(cv.pieces("KKIDRKII", 2)) == [("KK", -1), ("IDR", 1), ("KII", 3)]
    assert list(cv.pieces("", 2)) == [("", 0)] and list(cv.pieces("DDD", 2)) == [("DD", 0), ("D", 0)]


def test_parse_equals_all_edits():
    rnd = random.Random(3)
    for n in [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5]:
        symbols = "".join(rnd.choice("kkktd") + rnd.choice("suuaa-") for _ in range(n))
        assert cv.best(cv.parse(symbols, 0)) == brute(symbols), symbols


def plain(rows):
    """The query row by row, one conversation at a time; costs by a table over the four kinds of beginnings."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        kept = []
        for turn, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            role = "user" if fault == 4 else role
            kept += [(turn, role, text)] * (2 if fault == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.sub("[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, _, _ in kept if t is not None}
        initials = [r[:1] for _, r, _ in kept]
        tops = {"": (0, "", ())}
        def inserted(tops):
            for _ in range(3):
                for s, (c, a, o) in list(tops.items()):
                    for x in ("user", "assistant"):
                        t = step(s, x[0])
                        if t is not None and (t not in tops or (c + 5, a + "I") < tops[t][:2]):
                            tops[t] = (c + 5, a + "I", (o, f"{x}:"))
            return tops
        def step(s, x):
            return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, x))
        for (_, role, text), fault in zip(kept, faults):
            new = {}
            for s, (c, a, o) in inserted(tops).items():
                options = [(s, c + 2, a + "D", o)]
                if fault not in ("blank", "duplicate"):
                    late = 5 * (fault == "truncated")
                    options += [(step(s, role[:1]), c + late, a + "K", (o, f"{role}:{text}"))]
                    options += [(step(s, x[0]), c + 1 + late, a + "R", (o, f"{x}:{text}")) for x in ("user", "assistant")]
                for t, c2, a2, o2 in options:
                    if t is not None and (t not in new or (c2, a2) < new[t][:2]):
                        new[t] = (c2, a2, o2)
            tops = new
        cost, audit, chain = min((v for s, v in inserted(tops).items() if s in ("", "a")), key=lambda v: v[:2])
        said = []
        while chain:
            chain, one = chain
            said.append(one)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(reversed(said)).encode()).hexdigest())
    return out


def table():
    rnd = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 9)):
            text = rnd.choice(["Yes.", "No!", "And then", "", " \t", None, "Long " * 20 + "end?", "x. \n"])
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 4, None]), rnd.choice([role] * 9 + ["system", None, "", "tool", "admin"]), text, "p", "s"))
    rows += [(70, i, ["user", "assistant"][i % 2] if rnd.random() < 0.9 else "user", f"turn {i}" + rnd.choice([".", ".", ".", ""]), None, None) for i in range(300)]
    rows += rows[5:9]  # repeated rows
    return rows


@pytest.mark.parametrize("chunk", [7, 4096])
def test_query_equals_plain_recomputation(spark, monkeypatch, chunk):
    monkeypatch.setattr(cv, "CHUNK", chunk)
    rows = table()
    got = cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r.conv_id


def test_repaired_turns_are_legal(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again."), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi.")]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.audit for r in cv.repair(source, damage=False).collect()}
    assert got == {1: "RK", 2: "RR"}


def test_empty_table(spark):
    assert cv.repair(spark.createDataFrame([], SCHEMA)).collect() == []
