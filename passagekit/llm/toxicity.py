"""Toxicity of texts as a noisy channel restores them from leetspeak, spacing and repetition."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.common import stored
from passagekit.llm.jaccard_join import shingles
from passagekit.llm.units import batches, kept

#: What stands for which letters (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Put between letters to break a word.
SEPARATORS = "-._'’~·/\\"
#: Stripped from the ends of a token before it is decoded.
EDGES = ".,;:?!\"'’()[]{}<>#%&*|~^/\\`´«»…–—-_=+“”„¿¡"
#: Costs (negative natural logarithms) of what the channel does to a letter or between letters.
COST = {"leet": 1.5, "wild": 3.0, "drop": 9.0, "drop_end": 1.0, "join": 1.0, "break": 3.0, "repeat": 1.0, "space": 2.0, "part": 1.5, "sign": 4.5}
#: Letters at the end of a way that stay open while a longer lattice is decoded; from four times as many on the earlier ones are settled.
LONGEST = 40
#: Labelled rows that the word weights are fitted on at most (those of the smallest hashes); words kept of them.
TRAINING_ROWS, WORDS = 200_000, 4096
#: Least evidence of a word (G squared), least documents, deviations that its share is lowered by, score without any word.
EVIDENCE, LEAST, DEVIATIONS, PRIOR = 25.0, 3, 1.5, 0.01
#: A word stands for itself from this evidence, this many toxic texts and this share of them on.
ALONE, LEAST_ALONE, COMMON = 40.0, 10, 0.02
KEPT = 240_000
_DOUBLE = re.compile(r"(.)\1", re.S)
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S)+(?!\S)")
#: Two single characters side by side, after white space: what every spaced run begins with, and quicker to look for.
_SPACED_PAIR = re.compile(r"\s\S[ \t]\S(?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_NO_LETTERS = {ord(c): None for c in EDGES if c not in LEET}


LETTERS = "abcdefghijklmnopqrstuvwxyz*^"


def symbol(c: str) -> str:
    """A letter as the language model sees it: a to z, or one class of all others."""
    return c if "a" <= c <= "z" else "*"


@dataclass
class CharModel:
    """Letter trigrams of words, smoothed by their bigrams and unigrams. At most 28^3 numbers."""

    counts: dict[str, int]
    cost: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        letters = LETTERS
        tri, bi, uni = Counter(), Counter(), Counter()
        for g, n in self.counts.items():
            tri[g] += n
            bi[g[1:]] += n
            uni[g[2]] += n
        bi_all, tri_all = Counter(), Counter()
        for g, n in bi.items():
            bi_all[g[0]] += n
        for g, n in tri.items():
            tri_all[g[:2]] += n
        total = sum(uni.values())
        for a in letters:
            for b in letters:
                row = self.cost[a + b] = {}
                for c in letters:
                    p1 = (uni[c] + 1) / (total + 28)
                    p2 = (bi[b + c] + 5 * p1) / (bi_all[b] + 5)
                    p3 = (tri[a + b + c] + 5 * p2) / (tri_all[a + b] + 5)
                    row[c] = -math.log(p3)


def word_trigrams(word: str) -> list[str]:
    s = "^^" + "".join(map(symbol, word)) + "^"
    return [s[i:i + 3] for i in range(len(s) - 2)]


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one character what may have been written, and at which cost. A blank ends a word."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]
    arcs = []
    for at, (c, n) in enumerate(runs):
        inside, at_end = 0 < at < len(runs) - 1, at == len(runs) - 1
        if spaced and at:
            arcs.append([("", 0.0), (" ", COST["space"])])
        if c.isalpha():
            arcs.append([(c, 0.0)] if n == 1 else [(c, COST["repeat"]), (c * 2, 0.0 if n == 2 else COST["repeat"])])
        elif c in LEET:
            own = [(x * k, COST["leet"] + (0.5 if n > 1 else 0)) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
            own.append(("", COST["drop_end"] if at_end and n > 1 else COST["drop"]))
            own.append((" ", COST["break"]))
            arcs.append(own)
        elif c == "*" and inside and n == 1:
            arcs.append([(chr(97 + i), COST["wild"]) for i in range(26)] + [("", COST["join"])])
        elif c in SEPARATORS and inside:
            arcs.append([("", COST["join"]), (" ", COST["part"])])
        else:
            arcs.append([("", COST["join"]), (" ", COST["part"])] if inside else [(" ", 0.0)])
    return arcs


def lettered(arcs: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
    """A lattice in which no sign that may be a letter is left out."""
    return [[x for x in options if x[0].strip()] or options for options in arcs]


def edge(signs: str) -> list[list[tuple[str, float]]]:
    """Signs that stood around a token: punctuation, or written for letters."""
    return [[("", COST["sign"]), *options] for options in lettered(lattice(signs))]


def cheapest(arcs: list[list[tuple[str, float]]], model: CharModel) -> tuple[float, str]:
    """The cheapest way through a lattice under the letters' costs, and its price; ties go to the text that sorts first.

    What all ways share is settled as soon as one state is left, and in any case what lies `LONGEST` letters and more back on the
    cheapest way of a long lattice, so that the work is linear in its length.
    """
    cost = model.cost
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    settled: list[str] = []
    for options in arcs:
        after: dict[str, tuple[float, str]] = {}
        if len(options) == 1 and len(best) == 1 and options[0][0].isalpha():  # nothing to choose
            [(s, (total, text))], [(out, price)] = best.items(), options
            total += price
            for c in out:
                x = c if "a" <= c <= "z" else "*"
                total += cost[s][x]
                s = s[1] + x
            settled.append(text + out)
            best = {s: (total, "")}
            continue
        for state, (sofar, text) in best.items():
            for out, price in options:
                s, total = state, sofar + price
                for c in out:
                    if c == " ":
                        if s[1] != "^":
                            total += cost[s]["^"]
                        s = "^^"
                    else:
                        x = c if "a" <= c <= "z" else "*"
                        total += cost[s][x]
                        s = s[1] + x
                held = after.get(s)
                if held is None or total < held[0] or (total == held[0] and text + out < held[1]):
                    after[s] = (total, text + out)
        best = after
        if len(best) == 1:
            [(s, (total, text))] = best.items()
            settled.append(text)
            best = {s: (total, "")}
        elif len(text) > 4 * LONGEST:
            first = min(best.values())[1][:-LONGEST]
            settled.append(first)
            best = {s: (total, text[len(first):]) for s, (total, text) in best.items() if text.startswith(first)}
    total, text = min((total + (cost[s]["^"] if s[1] != "^" else 0.0), text) for s, (total, text) in best.items())
    return total, "".join(settled) + text


def viterbi(arcs: list[list[tuple[str, float]]], model: CharModel) -> str:
    return cheapest(arcs, model)[1]


class Restorer:
    """Restores tokens; what it has decoded is kept up to a bound."""

    def __init__(self, model: CharModel):
        self.model, self.known, self.cores = model, {}, {}

    def token(self, token: str) -> tuple[str, ...]:
        """The words of a lower-case token without white space."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > KEPT:
                self.known.clear()
            found = self.known[token] = self._token(token)
        return found

    def _token(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and _DOUBLE.search(token) is None:
            return (token,)
        core = token.strip(EDGES)
        start = token.find(core) if core else len(token)
        before, after = token[:start].translate(_NO_LETTERS), token[start + len(core):].translate(_NO_LETTERS)
        if core.isalpha() and not before and not after:  # whatever stands around it
            if _DOUBLE.search(core) is None:
                return (core,)
            found = self.cores.get(core)
            if found is None:
                if len(self.cores) > KEPT // 4:
                    self.cores.clear()
                found = self.cores[core] = self._words(core, "", "")
            return found
        if _LETTERS.search(core) is None:  # a number or signs, unless the letters they may stand for are likelier
            signs = [c for c in core or before if c in LEET]
            if len(set(signs)) < 2:
                return ()
            price, text = cheapest(edge(before) + lettered(lattice(core)) + edge(after) if core else lettered(lattice(before)), self.model)
            signs += [*before, *after] if core else []
            return tuple(dict.fromkeys(text.split())) if price < COST["sign"] * len(signs) else ()
        return self._words(core, before, after)

    def _words(self, core: str, before: str, after: str) -> tuple[str, ...]:
        words = viterbi(lattice(core), self.model).split()
        if before or after:
            words += viterbi(edge(before) + lattice(core) + edge(after), self.model).split()
        words += [x for x in _LETTERS.findall(core) if len(x) > 2 or len(core) > LONGEST or x == core]
        return tuple(dict.fromkeys(words))

    def spaced(self, low: str) -> list[str]:
        """The words of runs of single characters."""
        if _SPACED_PAIR.search(" " + low) is None:
            return []
        out: list[str] = []
        for run in _SPACED.finditer(low):
            found = self.known.get(run[0])
            if found is None:
                if len(self.known) > KEPT:
                    self.known.clear()
                found = self.known[run[0]] = tuple(viterbi(lattice("".join(run[0].split()), spaced=True), self.model).split())
            out += found
        return out

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        low = text.lower()
        tokens = set(low.split())
        out = set(self.spaced(low))
        for token in tokens:
            out.update(self.token(token))
        return out


def features(word: str) -> list[str]:
    """A word, and its beginnings as families of words; kept apart by a mark."""
    return [word, *[word[:n] + "~" for n in (4, 5, 6) if len(word) > n]] if len(word) <= 64 else [word[:6] + "~"]


def char_counts(docs: DataFrame, text: str) -> dict[str, int]:
    """Trigram counts of all words of all texts; summed in each task, then over tasks, at most 28^3 rows."""
    def run(iterator) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(28 ** 3, np.int64)
        for batch in batches(iterator, 4 << 20):
            words: Counter[str] = Counter()
            for one in batch.column(0).to_pylist():
                words.update((one or "").lower().split())
            words = {w: n for w, n in words.items() if w.isalpha()}
            if not words:
                continue
            points = np.frombuffer(("\0\0" + "\0\0".join(words)).encode("utf-32-le"), "<u4")
            codes = np.where(points == 0, 27, np.where((points >= 97) & (points <= 122), points - 97, 26)).astype(np.int64)
            codes = np.append(codes, 27)
            ends = codes == 27
            length = np.fromiter(map(len, words), np.int64, len(words))
            times = np.fromiter(words.values(), np.int64, len(words))
            # a word's trigrams end at its letters and at the mark after it
            grams = codes[:-2] * 784 + codes[1:-1] * 28 + codes[2:]
            good = ~(ends[1:-1] & ends[2:])
            counts += np.bincount(grams[good], np.repeat(times, length + 1), 28 ** 3).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["".join(LETTERS[i // d % 28] for d in (784, 28, 1)) for i in at.tolist()], pa.string()), pa.array(counts[at])],
            names=["gram", "n"])

    grams = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "gram string, n long")
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit_words(docs: DataFrame, labels: DataFrame, model: CharModel, key: str = "doc_id", text: str = "text",
              label: str = "toxic", rows: int = TRAINING_ROWS) -> dict[str, float]:
    """For each telling word, or beginning of words, the least share of texts with it that are toxic, lowered further by the
    square of the share seen, so that words of clean texts too tell little alone.

    Fitted on labelled rows that are not held out, at most `rows` of them by the smallest hash of their keys; copies count
    once, and of words that occur together those that explain most (see `_explaining`).
    """
    picked = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(rows)
    )
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    labelled = source.join(F.broadcast(picked), "key")

    def sign(iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4 << 20):
            least = [int(x[0]) if len(x := shingles(t, 4)) else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["key", "label", "sign"])

    # copies have one vote: their least shingle is the same, that of near copies mostly
    kind = labelled.schema["key"].dataType.simpleString()
    signed = labelled.select("key", "label", "text").mapInArrow(sign, f"key {kind}, label int, sign long")
    votes = stored(signed.groupBy("sign", "label").agg(F.min("key").alias("key")).select("key", "label").distinct(), "votes")
    texts = source.join(F.broadcast(votes), "key").select("key", "label", "text")

    def run(iterator) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(model), {}
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        seen = [0, 0]

        def signs(text: str) -> set[str]:
            """The features of a text's restored words; those of a token are kept."""
            low = text.lower()
            tokens = set(low.split())
            for token in tokens.difference(known):
                known[token] = tuple({f for w in restorer._token(token) for f in features(w)})
            return {f for w in restorer.spaced(low) for f in features(w)}.union(*map(known.__getitem__, tokens))

        def out() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()),
                 pa.array([counts[0][k] for k in keys], pa.int64())], names=["word", "ones", "zeros"])

        for batch in batches(iterator, 4 << 20):
            for kind, one in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts[kind].update(signs(one or ""))
                seen[kind] += 1
            if len(known) > KEPT // 4:
                known.clear()
            if len(counts[0]) + len(counts[1]) > 2 * KEPT:
                yield out()
                counts[0].clear()
                counts[1].clear()
        counts[1][""] += seen[1]
        counts[0][""] += seen[0]
        yield out()

    sums = texts.mapInArrow(run, "word string, ones long, zeros long").groupBy("word").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    sums = stored(sums, "toxic-words")
    total = sums.where("word = ''").first()  # the row of the empty word counts all texts
    n1, n0 = (total["ones"], total["zeros"]) if total else (0, 0)
    if not n1:
        return {}
    share = n1 / (n1 + n0)
    seen = F.col("ones") + F.col("zeros")

    def part(x, y):
        return F.when(x > 0, x * F.log(x / y)).otherwise(0.0)

    strength = 2 * (part(F.col("ones"), seen * share) + part(F.col("zeros"), seen * (1 - share) if n0 else F.lit(1.0)))
    z = DEVIATIONS
    p = F.col("ones") / seen
    low = (p + z * z / (2 * seen) - z * F.sqrt(p * (1 - p) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)
    found = (
        sums.where((F.col("word") != "") & (F.col("ones") >= LEAST))
        .select("word", "ones", "zeros", strength.alias("strength"), (low * p * p).alias("weight"))
        .where((F.col("strength") >= EVIDENCE) & (low > share))
        .orderBy(F.desc("strength"), "word").limit(WORDS).collect()
    )
    return _explaining(found, texts.where("label = 1").select("text"), Restorer(model), n1, n0)


def _explaining(found: list, toxic: DataFrame, restorer: Restorer, n1: int, n0: int) -> dict[str, float]:
    """Of the candidates those that explain toxic texts which stronger ones don't.

    The strongest is taken first, and its texts speak for no other word; so words that stand beside it by chance, as in
    copies, are left out. Words of many different toxic texts and of hardly any other are taken in any case. At most `TRAINING_ROWS` texts with at most `WORDS` candidates each are gathered.
    """
    place = {r["word"]: i for i, r in enumerate(found)}

    def held(iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4 << 20):
            lists = [sorted({place[f] for w in restorer.words(t or "") for f in features(w) if f in place}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["held"])

    if not found:
        return {}
    lists = toxic.mapInArrow(held, "held array<int>").toArrow()["held"].to_pylist()
    texts_of: list[list[int]] = [[] for _ in found]
    for i, own in enumerate(lists):
        for c in own:
            texts_of[c].append(i)
    left = np.array([len(x) for x in texts_of], float)
    zeros = np.array([r["zeros"] for r in found], float)
    open_, taken, share = np.ones(len(lists), bool), [], n1 / (n1 + n0)
    while True:
        seen = left + zeros
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = 2 * (np.where(left > 0, left * np.log(left / (seen * share)), 0)
                            + np.where(zeros > 0, zeros * np.log(zeros / (seen * (1 - share))), 0))
        strength[(left < LEAST) | (left <= share * seen)] = 0
        best = int(strength.argmax())
        if strength[best] < EVIDENCE:
            break
        taken.append(best)
        for i in texts_of[best]:
            if open_[i]:
                open_[i] = False
                left[lists[i]] -= 1
    plain = max(LEAST_ALONE, COMMON * n1)  # words of so many different texts stand for themselves
    taken += [i for i, r in enumerate(found) if r["ones"] >= plain and r["strength"] >= ALONE and r["weight"] >= 0.5 and i not in taken]
    return {found[i]["word"]: found[i]["weight"] for i in taken}


class Evidence:
    """What restored tokens and texts tell under word weights.

    Tokens met are kept in two halves of `KEPT`: when the newer half is full it becomes the older one, whose tokens go
    unless they have been met again.
    """

    def __init__(self, model: CharModel, weights: dict[str, float]):
        self.restorer, self.weights = Restorer(model), weights
        self.newer: set[str] = set()
        self.older: set[str] = set()
        self.told: dict[str, tuple[tuple[float, str], ...]] = {}  # of both halves the tokens that tell anything
        self.telling_tokens: set[str] = set()

    def telling(self, words) -> tuple[tuple[float, str], ...]:
        weights = self.weights
        found = ((max([weights.get(f, 0.0) for f in features(w)]), w) for w in words)
        return tuple(x for x in found if x[0])

    def _meet(self, tokens: set[str]) -> None:
        if len(self.newer) > KEPT:
            self.newer, self.older = set(), self.newer
            self.told = {t: x for t, x in self.told.items() if t in self.older}
            self.telling_tokens = set(self.told)
        for token in (tokens - self.newer) - self.older:
            found = self.telling(self.restorer._token(token))
            if found:
                self.told[token] = found
                self.telling_tokens.add(token)
        self.newer |= tokens

    def score(self, text: str | None) -> float:
        """The chance that any of the words tells true."""
        low, met = (text or "").lower(), set()
        tokens = set(low.split())
        self._meet(tokens)
        for token in tokens & self.telling_tokens:
            met.update(self.told[token])
        met.update(self.telling(self.restorer.spaced(low)))
        rest = 1.0 - PRIOR
        for weight, _ in sorted(met):
            rest *= 1.0 - weight
        return 1.0 - rest


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """A score between 0 and 1 for every whole text, and whether it reaches `threshold`.

    Tokens with signs among or for their letters, repetitions, and runs of single characters become lattices of what may
    have been meant, however long they are; signs around a token may stand for letters too. The cheapest way under a letter trigram model of the whole corpus is taken as the text, and its words
    are scored: each word has the lowered share of toxic labels among training texts with it or with a word that begins
    alike, and the score is the chance that any of them is toxic. Only texts are looked at for a score.

    Returns key, held_out, score, predicted; with `keep` the whole rows as `row` instead of the key. A NULL or empty text has the score of no evidence. Keys may be NULL (never
    held out, never trained on) or repeat; labels that are NULL or repeat for a key count as the largest one. Without toxic labels every
    text has that score. Other columns are not looked at. No step shuffles texts: the letter model is at most 28^3 counts, the
    labelled rows are at most `TRAINING_ROWS`, the words at most `WORDS`; all three are broadcast within these bounds.
    """
    model = CharModel(char_counts(docs, text))
    weights = fit_words(docs, labels, model, key, text, label)
    made = hashlib.sha256(repr((sorted(model.counts.items()), sorted(weights.items()))).encode()).hexdigest()
    name = ("toxicity", made)  # tasks of one worker go on with the tokens of the tasks before

    def run(iterator) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 4 << 20, name):
            score = kept(name, lambda: Evidence(model, weights)).score
            scores = [score(one) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct(F.col(f"`{key}`"))
    source = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    scored = source.mapInArrow(run, f"row {kind}, score double")
    mine = F.col("row").getField(key)
    return scored.select("row" if keep else mine.alias(key), held_out(mine).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
