"""Conversation structure repair: find faulty turns, and audit the cheapest edits that give a well-formed conversation.

A conversation is well-formed if the initials of its roles match `(s?(ua)+)?`. The edits are Delete, Insert, Keep and Rerole;
an audit is their initials in order, and of equally cheap audits the ASCII-least one is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passagekit.llm.common import stored

#: White space of the contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Sentence ends whose absence marks a truncated turn.
ENDS = ".!?"
#: Turns (as a power of two) of a block: the codes of a block are gathered on the JVM, and its paths are settled at its end.
BLOCK_BITS = 12

# Costs of the edits; an undeleted truncated turn costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# One letter per turn: its role's initial (s, u, a or another one) if it is sound, truncated, or has to be deleted.
CLASSES = "suao"
SOUND, CUT, GONE = "suao", "SUAO", "wxyz"
_CLASS = str.maketrans(SOUND + CUT + GONE, CLASSES * 3)

# States: nothing yet, after a system turn, after a user turn, after an assistant turn. KEPT: what keeping a turn leads to.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("u", _ASSISTANT): _USER, ("a", _USER): _ASSISTANT}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # where a turn with the due role leads to
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Paths:
    """Edit strings as linked nodes that share their prefixes.

    Node 0 is the empty string. A node knows its ancestors 1, 2, 4, … steps up and the rolling hash of its string.
    """

    def __init__(self) -> None:
        self.up: list[list[int]] = [[0]]
        self.depth, self.hash, self.edit = [0], [0], [""]

    def add(self, parent: int, edit: str) -> int:
        node, depth = len(self.depth), self.depth[parent] + 1
        if depth >> len(self.up):
            self.up.append([0] * node)
        self.up[0].append(parent)
        for lower, level in zip(self.up, self.up[1:]):
            level.append(lower[lower[node]])
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * _BASE + ord(edit) + 1) % _PRIME)
        self.edit.append(edit)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of that length."""
        steps, k = self.depth[node] - depth, 0
        while steps:
            if steps & 1:
                node = self.up[k][node]
            steps >>= 1
            k += 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two prefixes of one length are equal. Equal hashes are verified down to the node that both share."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[0][a], self.up[0][b]
        return True

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix of two strings, by steps down in powers of two."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(a, b):
            return depth
        for level in reversed(self.up):
            if self.depth[a] and not self.same(level[a], level[b]):
                a, b = level[a], level[b]
        return self.depth[a] - 1

    def before(self, a: int, edit_a: str, b: int, edit_b: str) -> bool:
        """Whether string a + edit_a comes before string b + edit_b."""
        shared = self.common(a, b)
        next_a = self.edit[self.ancestor(a, shared + 1)] if self.depth[a] > shared else edit_a
        next_b = self.edit[self.ancestor(b, shared + 1)] if self.depth[b] > shared else edit_b
        if next_a != next_b:
            return next_a < next_b
        return self.depth[a] + 1 < self.depth[b] + 1  # only for equal strings or prefixes, which no two ways of equal cost give

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[0][node]
        return "".join(reversed(out))


Ways = list[tuple[int, int] | None]  # of each state: the least cost, and the node of the least audit of that cost


def _step(paths: Paths, ways: Ways, moves: list[tuple[int, int, int, str]], kept: bool) -> Ways:
    """The best way to each state by one of the moves (from, to, cost, edit); with `kept`, or by staying."""
    best: list[tuple[int, int, str] | None] = [(w[0], w[1], "") if w and kept else None for w in ways]
    for source, target, cost, edit in moves:
        if ways[source] is None:
            continue
        total, node = ways[source][0] + cost, ways[source][1]
        now = best[target]
        if now is None or total < now[0]:
            best[target] = (total, node, edit)
        elif total == now[0]:
            # a way that stays is compared by its own last edit
            other, last = (now[1], now[2]) if now[2] else (paths.up[0][now[1]], paths.edit[now[1]])
            if paths.before(node, edit, other, last):
                best[target] = (total, node, edit)
    return [None if b is None else (b[0], paths.add(b[1], b[2]) if b[2] else b[1]) for b in best]


_INSERTS = [(state, _NEXT[state], INSERT, "I") for state in range(4)]


@lru_cache(maxsize=64)
def _moves(code: str) -> list[tuple[int, int, int, str]]:
    kind, cut = code.translate(_CLASS), TRUNCATED if code in CUT else 0
    moves = [(state, state, DELETE, "D") for state in range(4)]
    if code not in GONE:
        moves += [(state, _NEXT[state], REROLE + cut, "R") for state in range(4)]
        moves += [(state, _KEPT[kind, state], cut, "K") for state in range(4) if (kind, state) in _KEPT]
    return moves


def _inserted(paths: Paths, ways: Ways) -> Ways:
    """With up to two inserts; three would come back to a state at a higher cost."""
    return _step(paths, _step(paths, ways, _INSERTS, True), _INSERTS, True)


def audit_codes(codes: str, block: int = 1 << BLOCK_BITS) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a conversation given by one letter per turn.

    Ways that have consumed the same turns are never prefixes of each other (they would differ by inserts alone, so in cost).
    Hence after each block of turns the ways can be settled: their order is kept as the first letter of the next block's
    strings, and of the linked nodes only one string per state and block stays.
    """
    paths = Paths()
    ways: Ways = [(0, paths.add(0, "0")), None, None, None]
    origins, settled = [_START], []
    for at in range(0, max(len(codes), 1), block):
        if at:
            live = [s for s in range(4) if ways[s] is not None]
            texts = {s: paths.string(ways[s][1]) for s in live}
            settled.append({s: (origins[int(texts[s][0])], texts[s][1:]) for s in live})
            origins = sorted(live, key=texts.get)
            paths, costs = Paths(), {s: ways[s][0] for s in live}
            ways = [None] * 4
            for rank, state in enumerate(origins):
                ways[state] = (costs[state], paths.add(0, str(rank)))
        for code in codes[at:at + block]:
            ways = _step(paths, _inserted(paths, ways), _moves(code), False)
    ways = _inserted(paths, ways)
    ends = [ways[s] for s in (_START, _ASSISTANT) if ways[s] is not None]
    cost = min(e[0] for e in ends)
    text = min(paths.string(e[1]) for e in ends if e[0] == cost)
    parts, state = [text[1:]], origins[int(text[0])]
    for table in reversed(settled):
        state, part = table[state]
        parts.append(part)
    return cost, "".join(reversed(parts))


@lru_cache(maxsize=20_000)
def _audit_short(codes: str) -> tuple[int, str]:
    return audit_codes(codes)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that the crc32 of `conv_id:turn` (NULL as one space) sets, for trying out the repair.

    Remainders by 20: 0 drops the turn, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 sets role user.
    A dropped turn stays as a row with NULL in `role` and `text` and false in `there`, so that its conversation stays known.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").when(fault != 0, space("role")).alias("role"),
        F.when(fault != 0, text).alias("text"), (fault != 0).alias("there"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _marked(turns: DataFrame) -> DataFrame:
    """Turns with all that audits need of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACES))
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    return turns.select(
        "conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"),
        copy.alias("copy"), there.alias("there"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut"), text.alias("text"))


_ORDER = ["turn", "role", "digest", "copy"]
_FINDINGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _code(duplicate: Column) -> Column:
    kind = F.coalesce(F.nullif(F.instr(F.lit(CLASSES[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4))
    kind = F.when(F.col("role") == "", 4).otherwise(kind)
    fault = F.when(F.col("blank") | duplicate, 8).when(F.col("cut"), 4).otherwise(0)
    return F.when(F.col("there"), F.substring(F.lit(SOUND + CUT + GONE), kind + fault, F.lit(1))).otherwise("")


def audit_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    turns: conv_id, turn, role, text (other columns are not read, but for `there`, false for a row that is no turn, and `copy`,
    which orders repeats). NULL role or text counts as one space. Turns are ordered by turn (NULLs first), then role, then the
    sha256 of the text; equal rows are duplicates of each other but for the first. NULL conv_id is a conversation of its own.
    A conversation without turns has zeros and an empty audit; a turn number that is NULL counts for no gap.

    Only one letter per turn leaves the rows. The order within a conversation comes from one sort by ranges, so a conversation
    may lie in many partitions; duplicates are found by a minimum per (conversation, role, text), combined before the shuffle. Letters
    are gathered in blocks of 4,096, and those of a conversation in one row, which is no longer than its audit.
    """
    sorts = [F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in _ORDER]]
    rows = stored(
        _marked(turns).drop("text").repartitionByRange(*sorts).sortWithinPartitions(*sorts)
        .withColumn("at", F.monotonically_increasing_id()), "turns")
    several = (
        rows.where("there AND NOT blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    duplicate = F.col("there") & ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    blocks = rows.join(several, same, "left").select(
        "conv_id", "turn", "at", F.shiftright("at", BLOCK_BITS).alias("block"), _code(duplicate).alias("code"),
        (F.col("there") & F.col("blank")).cast("long").alias("blank"), duplicate.cast("long").alias("duplicate"),
    ).groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"))
    conversations = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "codes", "low", "high", "turns"))).alias("blocks"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return conversations.mapInArrow(_audits, f"conv_id {kind}, {', '.join(f'{c} long' for c in _FINDINGS)}, audit string")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {c: [] for c in [*_FINDINGS, "audit"]}
        for blocks, blank, duplicate in zip(batch["blocks"].to_pylist(), batch["blank"].to_pylist(), batch["duplicate"].to_pylist()):
            codes = "".join(b["codes"] for b in blocks)
            cost, audit = _audit_short(codes) if len(codes) <= 64 else audit_codes(codes)
            kinds = codes.translate(_CLASS)
            legal = kinds.count("su") + kinds.count("ua") + kinds.count("au")
            for name, value in zip(found, (
                    _gaps(blocks), blank, duplicate, sum(codes.count(c) for c in CUT), max(len(kinds) - 1, 0) - legal, cost, audit)):
                found[name].append(value)
        arrays = [pa.array(found[c], pa.int64()) for c in _FINDINGS] + [pa.array(found["audit"], pa.string())]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], *arrays], names=["conv_id", *_FINDINGS, "audit"])


def _gaps(blocks: list[dict]) -> int:
    """Missing numbers between the least and the highest turn. A number may end one block and begin the next one."""
    blocks = [b for b in blocks if b["turns"]]
    if not blocks:
        return 0
    different = sum(b["turns"] for b in blocks) - sum(a["high"] == b["low"] for a, b in zip(blocks, blocks[1:]))
    return blocks[-1]["high"] - blocks[0]["low"] + 1 - different


def _together(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its turns in order, in one partition: the text moves once."""
    rows = _marked(turns).where("there").select("conv_id", "turn", "role", "digest", "copy", "text", F.lit(1).alias("kind"))
    heads = audits.select("conv_id", F.struct(*_FINDINGS, "audit").alias("head"), F.lit(0).alias("kind"))
    sorts = [F.col(c).asc_nulls_first() for c in ["conv_id", "kind", *_ORDER]]
    both = heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*sorts)
    return both.select("conv_id", "head", "role", "text")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict | None, str, str, str]]:
    """(conversation, its head or None, edit, role, text) in order: a head first, then the turns that its audit gives."""
    rest: Iterator[str] = iter("")
    due, left = "user", 0

    def until_turn() -> Iterator[tuple[str, str]]:
        """The inserts before the next edit of a turn, and that edit."""
        for edit in rest:
            yield edit, due
            if edit != "I":
                return

    for batch in batches:
        for conv, head, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "head", "role", "text")]):
            if head is not None:
                rest, due = iter(head["audit"]), "user"
                left = len(head["audit"].rstrip("I"))  # an audit without edits of turns has no inserts either
                yield conv, head, "", "", ""
                continue
            for edit, given in until_turn():
                left -= 1
                if edit == "D":
                    continue
                role_now = role if edit == "K" else given
                yield conv, None, edit, role_now, "" if edit == "I" else text
                due = "assistant" if role_now[:1] == "u" else "user"
            if not left:
                for edit in rest:  # inserts at the end
                    yield conv, None, edit, due, ""
                    due = "assistant" if due == "user" else "user"


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit, role, text. Inserted turns have an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place = size = 0
        for conv, head, edit, role, text in _replay(batches):
            if head is not None:
                place = 0
                continue
            out.append((conv, place, edit, role, text))
            place, size = place + 1, size + len(text)
            if len(out) >= 2000 or size > 1 << 24:
                yield _table(out, kind)
                out, size = [], 0
        yield _table(out, kind)

    field = turns.schema["conv_id"].dataType.simpleString()
    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    return _together(turns, audits).mapInArrow(rows, f"conv_id {field}, place long, edit string, role string, text string")


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "place", "edit", "role", "text"])


def repair_digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The audits with `repaired_sha256`, the sha256 of the repaired `role:text`, joined by newlines.

    A conversation's turns pass one task one by one, as the hash demands their order; no more than an Arrow batch is held.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        now, first = None, True
        for conv, head, _, role, text in _replay(batches):
            if head is not None:
                now, first = hashlib.sha256(), True
                out.append({"conv_id": conv, **head, "repaired_sha256": now})
                if len(out) > 2000:
                    yield finished(out[:-1])
                    out = out[-1:]
                continue
            now.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        yield finished(out)

    def finished(rows: list[dict]) -> pa.RecordBatch:
        columns = {c: [r[c] for r in rows] for c in ["conv_id", *_FINDINGS, "audit"]}
        columns["repaired_sha256"] = [r["repaired_sha256"].hexdigest() for r in rows]
        types = {"conv_id": kind, "audit": pa.string(), "repaired_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in columns.items()], names=list(columns))

    field = turns.schema["conv_id"].dataType.simpleString()
    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    return _together(turns, audits).mapInArrow(
        digests, f"conv_id {field}, {', '.join(f'{c} long' for c in _FINDINGS)}, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation with its findings, audit and the digest of its repaired turns (see `audit_conversations`)."""
    return repair_digests(turns, stored(audit_conversations(turns), "audits"))
