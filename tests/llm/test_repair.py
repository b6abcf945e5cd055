"""Conversation repair against enumeration, a plain dynamic program and a plain replay."""

import hashlib
import itertools
import random
import zlib

import pytest

from passagekit.llm import conversation_repair as repair
from passagekit.llm.common import stored
from passagekit.llm.conversation_repair import audit_codes, audit_conversations, damaged, repair_conversations, repaired_turns

ROLES = {"s": "system", "u": "user", "a": "assistant", "o": "other"}
SHAPE = "conv_id long, turn long, role string, text string, code string, at int, block int, kind int, head string, copy_of int"


def after(state: str, letter: str) -> str | None:
    """The automaton of `(s?(ua)+)?`: its state is the last letter."""
    return letter if (state, letter) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None


def plain(codes: str) -> tuple[int, str]:
    """Least (cost, audit) by whole strings."""
    ways = {"": (0, "")}
    for code in [*codes, None]:
        for _ in range(2):
            for state, (cost, text) in list(ways.items()):
                to = "a" if state == "u" else "u"
                ways[to] = min(ways.get(to, (9 ** 9, "")), (cost + 2, text + "I"))
        if code is None:
            break
        new: dict[str, tuple[int, str]] = {}
        kind, cut = code.translate(repair._CLASS), int(code.isupper())
        for state, (cost, text) in ways.items():
            moves = [(state, 3, "D")]
            if code not in repair.GONE:
                moves.append(("a" if state == "u" else "u", 2 + cut, "R"))
                if after(state, kind):
                    moves.append((kind, cut, "K"))
            for to, paid, edit in moves:
                new[to] = min(new.get(to, (9 ** 9, "")), (cost + paid, text + edit))
        ways = new
    return min(ways[s] for s in ("", "a") if s in ways)


def cost_of(codes: str, audit: str) -> int | None:
    """What an audit costs, None if it does not give a well-formed conversation."""
    state, total, at = "", 0, 0
    for edit in audit:
        if edit == "I":
            state, total = "a" if state == "u" else "u", total + 2
            continue
        if at == len(codes):
            return None
        code, at = codes[at], at + 1
        if edit == "D":
            total += 3
        elif code in repair.GONE:
            return None
        elif edit == "R":
            state, total = "a" if state == "u" else "u", total + 2 + code.isupper()
        else:
            state, total = after(state, code.translate(repair._CLASS)), total + code.isupper()
            if state is None:
                return None
    return total if at == len(codes) and state in ("", "a") else None


def test_audit_is_the_least_of_all():
    for n in range(4):
        for codes in itertools.product("suaoUAw", repeat=n):
            codes = "".join(codes)
            audits = ("".join(a) for m in range(n + 3) for a in itertools.product("DIKR", repeat=m)) if n < 3 else None
            if audits is not None:
                assert audit_codes(codes) == min((c, a) for a in audits if (c := cost_of(codes, a)) is not None)
            assert audit_codes(codes) == plain(codes)


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 7, 1])
@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_audit_in_blocks_and_with_colliding_hashes(monkeypatch, prime, block):
    monkeypatch.setattr(repair, "_PRIME", prime)
    rng = random.Random(block)
    for _ in range(150):
        codes = "".join(rng.choice("suaoSUAOwxyzuaua") for _ in range(rng.randrange(24)))
        cost, audit = audit_codes(codes, block)
        assert (cost, audit) == plain(codes) and cost_of(codes, audit) == cost


def test_audit_of_long_conversations():
    rng = random.Random(3)
    for codes in ("u" * 3000, "ua" * 1500 + "a", "a" * 2999, "".join(rng.choice("uuaaoUAw") for _ in range(3000))):
        assert audit_codes(codes, 512) == plain(codes) == audit_codes(codes)
    assert audit_codes("u" * 60_000)[0] == 60_000


def expected(rows: list[tuple]) -> dict:
    """Findings, audit and digest of each conversation by plain loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            show = lambda x: " " if x is None else x
            fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            role, text = show(role), show(text)
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            turns += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).hexdigest()))
        seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = "suao".index(role[:1]) if role[:1] in ("s", "u", "a") else 3
            codes += {None: "suao", "truncated": "SUAO"}.get(fault, "wxyz")[kind]
        numbers = {t[0] for t in turns if t[0] is not None}
        cost, audit = plain(codes)
        said, state, at = [], "", 0
        for edit in audit:
            due = "assistant" if state == "u" else "user"
            if edit == "I":
                said.append((due, ""))
            else:
                _, role, text = turns[at]
                at += 1
                if edit == "D":
                    continue
                said.append((role if edit == "K" else due, text))
            state = said[-1][0][:1]
        out[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **counts, "cost": cost, "audit": audit,
            "illegal": sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(), "said": said}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "h", 4) for r in rows], SHAPE)


def check(spark, rows):
    turns = table(spark, rows)
    found = {r["conv_id"]: r.asDict() for r in repair_conversations(damaged(turns)).collect()}
    want = expected(rows)
    assert found.keys() == want.keys()
    for conv, row in found.items():
        assert row == {"conv_id": conv, **{k: v for k, v in want[conv].items() if k != "said"}}
    return turns, want


def test_awkward_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", "", None, " \t\n", "What?!", "é…", "Done. ", "x" * 200_000 + ".", "same."]
    roles = ["user", "assistant", "system", None, "", "uncle", "bot", "User"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    turns, want = check(spark, rows + rows[:20])
    made = damaged(turns)
    parts: dict = {}
    for r in sorted(repaired_turns(made, stored(audit_conversations(made), "a")).collect(), key=lambda r: r["place"]):
        parts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert parts == {c: w["said"] for c, w in want.items() if w["said"]}


def test_conversation_over_many_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    rng = random.Random(8)
    hot = [(7, t // 2 if t % 50 == 0 else t, rng.choice(["user", "assistant", "user"]), f"Line {rng.randrange(400)}{rng.choice(['.', ''])}") for t in range(900)]
    check(spark, hot + [(c, t, ["user", "assistant"][t % 2], f"Say {t}.") for c in range(40) for t in range(4)])


def test_no_turns_and_only_dropped_turns(spark):
    empty = repair_conversations(damaged(table(spark, [])))
    assert empty.count() == 0 and empty.columns[0] == "conv_id" and empty.columns[-1] == "repaired_sha256"
    dropped = next((c, t) for c in range(500) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = repair_conversations(damaged(table(spark, [(*dropped, "user", "Hi.")]))).collect()[0]
    assert row["audit"] == "" and row["cost"] == row["gaps"] == 0 and row["repaired_sha256"] == hashlib.sha256().hexdigest()


def test_turns_without_damage(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "There."), ("a", 5, "assistant", "Yes.")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    row = repair_conversations(turns).collect()[0]
    assert (row["conv_id"], row["gaps"], row["illegal"], row["audit"], row["cost"]) == ("a", 3, 1, "KIKK", 2)
