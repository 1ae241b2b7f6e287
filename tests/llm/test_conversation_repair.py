import hashlib
import random
import re
import zlib

import pytest
from cases import read

from redressa.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """(cost, audit, repaired) by trying all edits: rows of (role, text, fault)."""
    names = {"u": "user", "a": "assistant"}
    best = None

    def go(i, cost, audit, roles, turns):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows) and LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, turns
        for r in "ua":
            if not audit.endswith("II"):
                go(i, cost + 5, audit + "I", roles + r, [*turns, names[r] + ":"])
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 5 if fault == "truncated" else 0
            go(i + 1, cost + 2, audit + "D", roles, turns)
            if fault not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + extra, audit + "K", roles + role[:1], [*turns, f"{role}:{text}"])
                for r in "ua":
                    go(i + 1, cost + 1 + extra, audit + "R", roles + r, [*turns, f"{names[r]}:{text}"])

    go(0, 0, "", "", [])
    return best


def forward(codes):
    """(cost, audit) by keeping the least prefix of every state, from the front."""
    def add(x, cost, letter):
        return None if x is None else (x[0] + cost, x[1] + letter)

    def least(*xs):
        return min((x for x in xs if x is not None), default=None)

    s = [(0, ""), None, None, None]
    for code in codes:
        s[2] = least(s[2], add(s[0], 5, "I"), add(s[1], 5, "I"), add(s[3], 5, "I"))
        s[3] = least(s[3], add(s[2], 5, "I"))
        fault, initial = divmod(code, 4)
        extra, free = (5 if fault == 2 else 0), fault != 1
        user = least(s[0], s[1], s[3])
        s = [
            add(s[0], 2, "D"), least(add(s[1], 2, "D"), add(s[0], extra, "K") if free and initial == 0 else None),
            least(add(s[2], 2, "D"), add(user, extra, "K") if free and initial == 1 else None, add(user, 1 + extra, "R") if free else None),
            least(add(s[3], 2, "D"), add(s[2], extra, "K") if free and initial == 2 else None, add(s[2], 1 + extra, "R") if free else None),
        ]
    return least(s[0], s[3], add(s[2], 5, "I"), add(add(s[1], 5, "I"), 5, "I"))


def brute(rows):
    """All of the contract, row by row: rows of (conv_id, turn, role, text)."""
    part = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        held = convs.setdefault(conv, [])
        role, text = part(role), part(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for turn, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda f: sum(x == f for *_, x in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, repaired = every_repair(faulty)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(6)
    rows = []
    for conv in range(100_000, 100_060):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, rng.choice([turn, turn, None, 3 * turn]), rng.choice(["user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "Half", "", None, " \t", "Yes. ", "a?\n", "x" * 50_000 + "."])))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, "user", "Hi."), (None, 2, "assistant", "Hi.")]


def test_same_as_every_repair(spark):
    rows = read("conversations", "conv_id, turn, role, text")[:60] + odd_rows()
    schema = "conv_id long, turn long, role string, text string, cost string, code int, lost int"
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(5)
    got = cr.repair_conversations(cr.damaged(frame))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_repaired_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?"), (1, 4, "assistant", "So. ")]
    frame = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, lost boolean")
    got = cr.repair_conversations(frame, texts=True).collect()
    # The second greeting is a copy and has to go; of the two user turns one goes.
    assert [tuple(r) for r in got] == [(1, 1, 0, 1, 0, 2, 4, "KDDKK", "system:Be kind.\nuser:So?\nassistant:So. ")]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_blocks_and_long_conversations(block):
    rng = random.Random(block)
    for n in (0, 1, 2, 5, 40, 300):
        for _ in range(20):
            codes = bytes(rng.randrange(12) if rng.random() < 0.3 else 1 + i % 2 for i in range(n))
            assert cr.repair(codes, block) == forward(codes)


def test_a_conversation_of_many_rows():
    rng = random.Random(9)
    codes = bytes(rng.randrange(12) if rng.random() < 0.2 else 1 + i % 2 for i in range(200_000))
    cost, audit = cr.repair(codes)
    assert len(audit) - audit.count("I") == len(codes)
    assert cost == cr.suffix_bounds(codes)[0][cr.START]


def test_search_without_tight_bounds():
    """The search does not rely on its bounds being exact: with none at all it finds the same."""
    rng = random.Random(11)
    for _ in range(60):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(0, 9)))
        rest = [(0, 0, 0, 0)] * len(codes) + [cr.END]
        tight = cr.suffix_bounds(codes)
        assert cr.search(codes, cr.START, rest) == cr.search(codes, cr.START, tight)


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_conversations(cr.damaged(frame)).count() == 0
