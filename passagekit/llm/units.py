"""Texts as white-space units whose tokens do not depend on their neighbours, and values of units kept by task."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the blank, as Unicode's property has it (fixed values).
OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0                　"
_SPACE = f"[ {OTHER_SPACE}]"
#: White space and the run of other characters after it: a tokenizer that cuts at white space sees each alike anywhere.
_UNIT = re.compile(f"{_SPACE}*[^ {OTHER_SPACE}]+|{_SPACE}+")
_ASCII_RUNS = tuple(x for c in "\t\n\x0b\x0c\r" for x in (c + " ", " " + c)) + ("  ",)
_WIDE_SPACE = re.compile(f"[{OTHER_SPACE[5:]}]")
#: Texts that do not come apart into units at every blank.
_ODD = f"^ | $|[\t-\r ] | [\t-\r]|[{OTHER_SPACE[5:]}]"
#: Units that a task keeps, and characters of text or units looked at together.
KEPT, AT_ONCE = 450_000, 2 << 20
#: Pieces in a generation of those whose ids are kept, and characters of the longest of them.
GENERATION, LONGEST = 300_000, 128
#: Bytes and rows of texts encoded together, so that a word in many of them is met once.
TOGETHER, ROWS_TOGETHER = 8 << 20, 20_000


def units(text: str) -> tuple[list[str], list[str]]:
    """The units of a text, in order: whole ones, then ones that stand for themselves after one blank."""
    if any(x in text for x in _ASCII_RUNS) or not (text.isascii() or _WIDE_SPACE.search(text) is None):
        return _UNIT.findall(text), []
    first, *rest = text.split(" ")
    if rest and (not first or not rest[-1]):
        return _UNIT.findall(text), []
    return [first] if first else [], rest


class UnitValues:
    """Values of units, worked out once for as long as they are kept."""

    def __init__(self, work: Callable[[list[str]], Iterable]):
        self.work, self.whole, self.spaced = work, {}, {}

    def rows(self, texts: list[str]) -> Iterator[list]:
        """The values of each text's units, in order."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            cut = [units(t) for t in texts[start:end]]
            if len(self.whole) + len(self.spaced) > KEPT:
                self.whole, self.spaced = {}, {}
            self._fill(self.whole, "", (c[0] for c in cut))
            self._fill(self.spaced, " ", (c[1] for c in cut))
            whole, spaced = self.whole.__getitem__, self.spaced.__getitem__
            for first, rest in cut:
                yield [*map(whole, first), *map(spaced, rest)]
            start = end

    def _fill(self, known: dict, before: str, lists: Iterable[list[str]]) -> None:
        asked: set[str] = set()
        for one in lists:
            asked.update(one)
        new = [x for x in asked if x not in known]
        if new:
            known.update(zip(new, self.work([before + x for x in new])))


class PieceIds(dict):
    """Ids of pieces, made when first asked for. Of two generations the older is dropped when the newer is full."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= GENERATION:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class UnitIds:
    """Token ids of texts, put together from those of their units; a unit is looked at once for all texts encoded together."""

    def __init__(self, work: Callable[[pa.Array, str], np.ndarray]):
        self.work = work

    def rows(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + TOGETHER, "right")))
            yield from self._together(texts.slice(start, end - start))
            start = end

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        words = pc.split_pattern(pc.if_else(odd, pa.scalar("", texts.type), texts), " ")
        first = [[x] if x else [] for x in pc.list_element(words, 0).to_pylist()]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            first[i] = _UNIT.findall(texts[i].as_py())
        return map(bytes.__add__, self._joined(pa.array(first, pa.list_(texts.type)), ""), self._joined(pc.list_slice(words, 1), " "))

    def _joined(self, lists: pa.ListArray, before: str) -> Iterator[bytes]:
        """The ids of each list of units, `before` ahead of every unit."""
        coded = pc.list_flatten(lists).dictionary_encode()
        values = self.work(coded.dictionary, before).tolist()
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        ids, starts = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        which, at = coded.indices.to_numpy(), 0
        ends, parts = np.cumsum(sizes[which]), []
        for i in range(0, len(which), AT_ONCE):  # what places take in memory is bounded for one large text too
            some = which[i:i + AT_ONCE]
            n = sizes[some]
            places = np.repeat(starts[some] - (np.cumsum(n) - n), n)
            places += np.arange(len(places))
            parts.append(ids[places])
        joined = memoryview(b"".join(parts))
        for n in np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist():
            end = 4 * int(ends[n - 1]) if n else 0
            yield bytes(joined[at:end])
            at = end


def _each(words: pa.Array, make: Callable[[str], bytes]) -> np.ndarray:
    """What is made of each word, made once for equal ones."""
    coded = words.dictionary_encode()
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(make, different), object, len(different))[coded.indices.to_numpy()]


#: The pattern that the byte-level pre-tokenizer cuts by, and the bytes it leaves as they are (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Patterns that drop white space (fixed values).
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = dict.fromkeys(_SHOWN) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
BYTE_NAMES = {b: chr(b if n is None else n) for b, n in BYTE_NAMES.items()}


class Pieces:
    """Normalises a text and cuts it into the pieces that a tokenizer file's BPE model sees, named by bytes.

    Known are the byte-level pre-tokenizer and a cut by a pattern before it, with NFC, white space and lower case as
    normalizers; `known` is False for other files, and texts with special tokens in them are left to the library.
    """

    def __init__(self, path: str):
        import json

        import regex

        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        before, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        steps = norm.get("normalizers", [norm])
        self.lower = any(x["type"] == "Lowercase" for x in steps)
        self.nfc = any(x["type"] == "NFC" for x in steps)
        self.known = all(x["type"] in ("Lowercase", "NFC") or x.get("pattern") == {"Regex": r"\s+"} for x in steps)
        pattern = None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            pattern = BYTE_LEVEL
        elif before.get("type") == "Sequence" and [x["type"] for x in before["pretokenizers"]] == ["Split", "ByteLevel"]:
            split, level = before["pretokenizers"]
            if split["behavior"] == "Removed" and split["invert"] and not (level["use_regex"] or level["add_prefix_space"]):
                pattern = split["pattern"].get("Regex")
        self.known &= pattern is not None and spec["model"]["type"] == "BPE"
        self.joins = pattern == BYTE_LEVEL  # a blank belongs to the piece after it
        self.known &= self.joins or pattern in WORD_PATTERNS
        self._find = regex.compile(pattern).findall if pattern else None

    def __call__(self, text: str) -> list[str]:
        return list(map(self.named, self.cut(text)))

    def cut(self, text: str) -> list[str]:
        """The pieces before their bytes are named."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("\u03a3", "\u03c3").lower()
        bare = text[1:] if text[:1] == " " else text
        letters = bare.rstrip(_SIGNS)
        if letters.isalpha():  # a run of letters, and one of signs after it: every known pattern leaves both whole
            cut = [text[:len(text) - len(bare) + len(letters)] if self.joins else letters]
            if len(letters) < len(bare):
                cut.append(bare[len(letters):])
            return cut
        return self._find(text)

    @staticmethod
    def named(piece: str) -> str:
        """A piece with its bytes as the model names them."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", "\u0120")
        return piece.encode().decode("latin-1").translate(BYTE_NAMES)


#: Scripts whose characters have been assigned for long; others may be newer in one library than in another.
SETTLED = re.compile("[^\\x00-\u024f\u0391-\u03ff\u0400-\u052f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


#: What a Python worker keeps for the next tasks, by what it was made for.
TABLES: dict[tuple[str, str], object] = {}


def encoder(path: str) -> UnitIds:
    """Token ids of texts as little-endian 32-bit numbers, by the tokenizers library; one table per Python worker.

    Short pieces go to the library's model one by one, without the bookkeeping of offsets that its whole encoder does;
    units with special tokens, and files of another make, go through the whole encoder. Both give the same ids.
    """
    if ("ids", path) not in TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        pieces, model = Pieces(path), tokenizer.model
        special, named = pieces.special, pieces.named

        def whole(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        ids = PieceIds(lambda piece: array("I", [t.id for t in model.tokenize(named(piece))]).tobytes())
        lower = pieces.lower

        def one(text: str, free: bool) -> bytes:
            if not pieces.known or not free and any(x in text for x in special) or not (text.isascii() or SETTLED.search(text) is None):
                return whole(text)
            return b"".join(map(ids.__getitem__, pieces.cut(text)))

        def work(units: pa.Array, before: str) -> np.ndarray:
            mark = before if pieces.joins else ""
            values = np.empty(len(units), object)
            # ASCII letters and signs after them, as most words are: both are pieces by themselves
            letters = pc.ascii_rtrim(units, characters=_SIGNS)
            plain = pc.and_(pc.string_is_ascii(units), pc.ascii_is_alpha(letters)).to_numpy(zero_copy_only=False)
            free = pieces.known and not any(pc.any(pc.match_substring(units, x.lstrip(" "))).as_py() for x in special)
            if not free:
                plain[:] = False
            found = _each(letters.filter(pa.array(plain)), lambda x: ids[mark + (x.lower() if lower else x)])
            signs = _each(pc.ascii_ltrim(units.filter(pa.array(plain)), characters=ascii_letters), lambda x: ids[x] if x else b"")
            values[plain] = found + signs
            rest = units.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()
            values[~plain] = np.fromiter((one(before + x, free) for x in rest), object, len(rest))
            return values

        TABLES["ids", path] = UnitIds(work)
    return TABLES["ids", path]


def kept(name: tuple[str, str], make: Callable[[], object]):
    """What a worker keeps under a name of `TABLES`, made where there is nothing yet."""
    if name not in TABLES:
        TABLES[name] = make()
    return TABLES[name]


def encode(path: str, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
    """Ids of whole texts (none: empty), equal to those of the library for the whole text."""
    return encoder(path).rows(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))


def together(iterator: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join batches that follow each other, up to about `TOGETHER` bytes and `ROWS_TOGETHER` rows; larger ones stay as they are."""
    held, size, rows = [], 0, 0
    for batch in iterator:
        if held and (size + batch.nbytes > TOGETHER or rows + batch.num_rows > ROWS_TOGETHER):
            yield pa.concat_batches(held)
            held, size, rows = [], 0, 0
        held.append(batch)
        size += batch.nbytes
        rows += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def batches(iterator: Iterable[pa.RecordBatch], size: int = 8 << 20, table: tuple[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes at most, or one row.

    `table` is what this step uses of `TABLES`; a worker drops all else, so that its tables of an earlier step take no memory.
    """
    for name in [n for n in TABLES if n != table]:
        del TABLES[name]
    for batch in iterator:
        parts = max(1, -(-batch.nbytes // size))
        step = max(1, batch.num_rows // parts)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
