"""Token counts by a tokenizer that is compiled into a finite-state transducer."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.units import OTHER_SPACE, SETTLED, TABLES, Pieces, UnitValues, batches

#: Characters of a chunk; a longer text is cut into chunks.
CHUNK = 1 << 16
#: Compiled states that a task keeps.
STATES = 100_000
_NEVER = 1 << 60
_WIDE = re.compile(f"[{OTHER_SPACE[5:]}]")


class CountTransducer:
    """A byte-pair tokenizer as a deterministic transducer, compiled as far as texts need it.

    The tokens of a word's prefixes are known one from another: the last token of a prefix is the one suffix that is
    a token and that byte-pair merging keeps apart from the last token before it. So a state is what is left to be known:
    the longest suffix that may still grow into a token, and for each place within it the last token and the number of
    tokens there, less the number at the end. A transition reads one byte and carries the change of the number of
    tokens (it may fall, as merges reach back); the transition that ends a word carries that of the last byte.
    """

    def __init__(self, path: str):
        self.path, self.pieces, self.library = path, Pieces(path), None
        model = self.pieces.spec["model"]
        if not self.pieces.known:
            raise ValueError(f"no transducer for the pre-tokenizer or normalizer of {path}")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.known: dict[str, int] = {}
        self.spines: dict[str, tuple | None] = {}
        self.longer = {t[:i] for t in self.vocab for i in range(1, len(t.removesuffix(self.end) if self.end else t))}
        if self.end:
            self.longer |= {t.removesuffix(self.end) for t in self.vocab if t.endswith(self.end)}
        self.special = [x for x in self.pieces.special if x]
        self._reset()

    def _reset(self) -> None:
        self.states, self.names, self.steps, self.ends = {}, [], [], []
        self._state("", ((None, 0),))

    def _state(self, suffix: str, places: tuple) -> int:
        key = (suffix, places)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.names)
            self.names.append(key)
            self.steps.append({})
            self.ends.append({})
        return found

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def _spine(self, token: str) -> tuple | None:
        """The first and the last symbols while merging makes the token, each with the rank that ends it."""
        if token in self.spines:
            return self.spines[token]
        parts, first, last = self._symbols(token), [], []
        while len(parts) > 1:
            ranks = [self.rank.get(p, _NEVER) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == _NEVER:
                break
            at = ranks.index(low)
            if at == 0:
                first.append((parts[0], low))
            if at == len(parts) - 2:
                last.append((parts[-1], low))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        made = parts == [token]
        spine = (tuple(first) + ((token, _NEVER),), tuple(last) + ((token, _NEVER),)) if made else None
        self.spines[token] = spine
        return spine

    def _apart(self, left: str | None, right: str) -> bool:
        """Whether merging keeps the two tokens as they are side by side.

        A merge across the border happens if its rank comes while both its symbols are there; of equal ranks the one
        further left goes first.
        """
        b = self._spine(right)
        if b is None:
            return False
        if left is None:
            return True
        a, rank = self._spine(left), self.rank
        for x, x_ends in a[1]:
            for y, y_ends in b[0]:
                r = rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def _last(self, state: int, byte: str, end: str) -> tuple[str, int, str, tuple]:
        """The last token after a byte and the number of tokens there, less that before it."""
        suffix, places = self.names[state]
        run = suffix + byte
        for size in range(1, len(run) + 1):
            token = run[-size:] + end
            if token in self.vocab:
                before, count = places[len(places) - size]
                if self._apart(before, token):
                    return token, count + 1, run, places
        raise ValueError(f"no token for {byte!r}")

    def _step(self, state: int, byte: str) -> tuple[int, int]:
        token, count, run, places = self._last(state, byte, "")
        keep = next((run[i:] for i in range(len(run)) if run[i:] in self.longer), "")
        kept = places[len(places) - len(keep):] if keep else ()
        following = tuple((t, n - count) for t, n in kept) + ((token, 0),)
        step = self.steps[state][byte] = (self._state(keep, following), count)
        return step

    def piece(self, piece: str) -> int:
        """Tokens of a piece: the sum along its path."""
        state, total, steps = 0, 0, self.steps
        body, final = (piece[:-1], piece[-1]) if self.end else (piece, "")
        for byte in body:
            step = steps[state].get(byte)
            if step is None:
                step = self._step(state, byte)
            state = step[0]
            total += step[1]
        if final:
            count = self.ends[state].get(final)
            if count is None:
                count = self.ends[state][final] = self._last(state, final, self.end)[1]
            total += count
        return total

    def _by_library(self, text: str) -> int:
        """Tokens of a text with characters that are too new for all libraries to cut them alike."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> int:
        if not text.isascii() and SETTLED.search(text):
            return self._by_library(text)
        total, known = 0, self.known
        for piece in self.pieces(text) if text else ():
            n = known.get(piece)
            if n is None:
                n = known[piece] = self.piece(piece)
            total += n
        return total

    def unit(self, text: str) -> int:
        """Tokens of a text without white space before or inside, special tokens in it counting one each."""
        if len(self.names) > STATES:
            self._reset()
        if len(self.known) > STATES:
            self.known.clear()
        found = [(text.find(s), s) for s in self.special if s in text]
        if not found:
            return self._plain(text)
        at, special = min(found)
        return self._plain(text[:at]) + 1 + self.unit(text[at + len(special):])


class ChunkMap:
    """What a chunk does to the count, whatever comes before it.

    White space brings the transducer to its start, so a chunk's map of states is known from its two open ends: the text
    before its first and after its last white space. `head` is the whole chunk if it has none (`tail` is None then).
    """

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: str, count: int = 0, tail: str | None = None):
        self.head, self.count, self.tail = head, count, tail


def compose(a: ChunkMap, b: ChunkMap, count) -> ChunkMap:
    """The map of two chunks in a row; associative."""
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.count, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.count, a.tail + b.head)
    return ChunkMap(a.head, a.count + count(a.tail + b.head) + b.count, b.tail)


def scan(maps: list[ChunkMap], count) -> list[ChunkMap]:
    """The maps of all prefixes, in a logarithmic number of rounds of compositions that do not need one another."""
    if len(maps) < 2:
        return maps
    pairs = scan([compose(maps[i], maps[i + 1], count) for i in range(0, len(maps) - 1, 2)], count)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i], count))
    return out


def counter(path: str) -> tuple[CountTransducer, UnitValues]:
    """The transducer of a tokenizer file; one per Python worker."""
    if ("counts", path) not in TABLES:
        machine = CountTransducer(path)
        TABLES["counts", path] = machine, UnitValues(lambda texts: [sum(map(machine.unit, t.split(" "))) for t in texts])
    return TABLES["counts", path]


def _blanks(text: str) -> str:
    """White space of any kind as blanks."""
    for c in OTHER_SPACE[:5]:
        if c in text:
            text = text.replace(c, " ")
    return text if text.isascii() else _WIDE.sub(" ", text)


def count_text(path: str, texts: list[str | None]) -> list[int]:
    """Tokens of whole texts (none: 0)."""
    machine, values = counter(path)
    maps: list[list[ChunkMap]] = []
    middles: list[str] = []
    for text in texts:
        own = []
        text = _blanks(text or "")
        for at in range(0, len(text), CHUNK):
            part = text[at:at + CHUNK]
            head, space, rest = part.partition(" ")
            if not space:
                own.append(ChunkMap(part))
                continue
            middle, space, tail = rest.rpartition(" ")
            middles.append(middle)
            own.append(ChunkMap(head, 0, tail))
        maps.append(own)
    counts = iter([sum(v) for v in values.rows(middles)])
    for own in maps:
        for one in own:
            if one.tail is not None:
                one.count = next(counts)
    out = []
    for own in maps:
        if not own:
            out.append(0)
            continue
        last = scan(own, machine.unit)[-1]
        out.append(machine.unit(last.head) + last.count + (machine.unit(last.tail) if last.tail else 0))
    return out


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every whole text, beside its key.

    `tokenizer` is a file of the tokenizers library with byte-pair merges and a pre-tokenizer that drops white space; no
    special tokens are added, those in a text count one each. A NULL text counts as empty (0 and false); keys may be NULL or
    repeat, every row is returned. Other columns are not looked at. No shuffle; a task holds a batch, its units and the compiled part
    of the transducer.
    """
    def run(iterator):
        for batch in batches(iterator, table=("counts", tokenizer)):
            texts = batch.column(1).to_pylist()
            n = count_text(tokenizer, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["key", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"),
                         F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
