"""Token files, token counts and packing against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from passagekit.llm import token_count, units
from passagekit.llm.packing import _Exchange, best_fit, least_bins, pack_documents, pack_sizes
from passagekit.llm.token_count import ChunkMap, compose, count_text, count_tokens, scan
from passagekit.llm.token_files import IdFile, IdFileWriter, pack, read_documents, session_folder, unpack, width, write_token_files
from tests.llm.data import DOCS, awkward

BYTES, WORDS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"
ODD = [
    None, "", " ", "a", " a  b", "a\n b", "\n\n \n", "x \n y", "a  b  c", "<|endoftext|> hi<|endoftext|>x<|startoftext|>",
    "it's We'LL 's 'r 'x !'s", "a\x1cb \x1dc", "   lead", "trail  ", "É ́x İΣ ΑΣ", "²½Ⅷ ٣٤ 日本語 🤣🤣",
    "a" * 300, "!?&$" * 40, "x " * 3000, "word word line　end",
]


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_units_give_the_ids_of_whole_texts(libraries, path):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdeéßñ '!.19日🤣 \n$") for _ in range(80)) for _ in range(400)]
    for text, found in zip(texts, units.encode(path, texts)):
        assert np.frombuffer(found, "<u4").tolist() == ids_of(libraries[path], text), repr(text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_the_model_sees_a_word_once_whatever_signs_follow_it(libraries, monkeypatch, path):
    """Frequent words stay while rare ones come and go, and are not encoded anew for each run of signs after them."""
    asked = []

    class Counting:
        def __init__(self, library):
            self.library, self.model = library, self

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def no_truncation(self):
            self.inner = self.library.model

        def no_padding(self):
            pass

        def tokenize(self, piece):
            asked.append(piece)
            return self.inner.tokenize(piece)

        def encode(self, text, **settings):
            return self.library.encode(text, **settings)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(units, "KEPT", 1500)
    monkeypatch.setattr(units, "GENERATION", 750, raising=False)
    monkeypatch.setattr(units, "AT_ONCE", 2000)
    monkeypatch.setattr(units, "TOGETHER", 2000, raising=False)
    units.TABLES.pop(("ids", path), None)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = [word(5) for _ in range(60)]
    texts = []
    for _ in range(80):
        words = [w + rng.choice(".,;:") * rng.randrange(9) for w in common] + [word(9) for _ in range(100)]
        rng.shuffle(words)
        texts.append("x " + " ".join(words))
    try:
        found = list(units.encode(path, texts))
    finally:
        units.TABLES.pop(("ids", path), None)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(libraries[path], text)
    assert len(asked) < 1.02 * len(set(asked))


def test_ids_of_one_large_text_and_of_long_pieces(libraries, monkeypatch):
    monkeypatch.setattr(units, "AT_ONCE", 3)
    monkeypatch.setattr(units, "TOGETHER", 5)
    texts = ["a bb ccc. d " * 40 + "e", "", None, "z" * 1000 + " q", " odd  one", "last"]
    for make in (list, pa.array, lambda t: pa.array(t, pa.large_string()), lambda t: pa.array(["no", *t])[1:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in units.encode(BYTES, make(texts))] == [ids_of(libraries[BYTES], t) for t in texts]
    assert list(units.encode(BYTES, [])) == []


def test_batches_join_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(units, "TOGETHER", 1 << 20)
    monkeypatch.setattr(units, "ROWS_TOGETHER", 50)
    batches = [pa.record_batch({"x": list(range(at, at + n))}) for at, n in ((0, 20), (20, 25), (45, 30), (75, 80), (155, 1))]
    joined = list(units.together(iter(batches)))
    assert [b.num_rows for b in joined] == [45, 30, 80, 1] and pa.Table.from_batches(joined)["x"].to_pylist() == list(range(156))
    monkeypatch.setattr(units, "TOGETHER", 100)
    assert [b.num_rows for b in units.together(iter(batches))] == [20, 25, 30, 80, 1]
    assert list(units.together(iter([]))) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abct 're<|>endoftx\n\t éΣ1٣.!$", max_size=80))
def test_any_text(text):
    library = Tokenizer.from_file(WORDS)
    assert count_text(WORDS, [text]) == [len(ids_of(library, text))]


def test_counts_of_letters_newer_than_the_tables(libraries):
    texts = [f"a{chr(c)}b {chr(c)} x{chr(c)}y'll" for c in (0xA7CB, 0xA7DC, 0x1C89, 0x10D4A, 0x1F600, 0x378, 0x300)]
    assert count_text(WORDS, texts) == [len(ids_of(libraries[WORDS], t)) for t in texts]


def test_counts_over_chunks_and_forgotten_states(libraries, monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 7)
    monkeypatch.setattr(token_count, "STATES", 50)
    assert count_text(WORDS, ODD) == [len(ids_of(libraries[WORDS], t)) for t in ODD]


def test_chunk_maps_compose_in_any_grouping():
    count = len
    maps = [ChunkMap("ab", 1, "c"), ChunkMap("d"), ChunkMap("", 2, ""), ChunkMap("e", 0, "f"), ChunkMap("gh")]
    one = maps[0]
    for i, found in enumerate(scan(maps, count)):
        one = maps[0] if i == 0 else compose(one, maps[i], count)
        assert (found.head, found.count, found.tail) == (one.head, one.count, one.tail)


def test_count_query_columns(spark, libraries):
    docs = awkward(spark, ODD, ids=[None, 1, 1, *range(3, len(ODD))])
    out = count_tokens(docs, WORDS, limit=100)
    expected = sorted((len((t or "").encode()), len(ids_of(libraries[WORDS], t))) for t in ODD)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out.collect()) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in out.collect())
    assert count_tokens(spark.createDataFrame([], DOCS), WORDS).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packed_numbers_come_back(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2 ** bits, 1001, dtype=np.uint64).astype("<u4")
    data = pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (unpack(data, bits, 0, 1001) == ids).all() and (unpack(data, bits, 77, 300) == ids[77:377]).all()


def test_width():
    assert [width(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_file_gives_any_range(tmp_path):
    path = str(tmp_path / "x" / "one.ids")
    out, ids = IdFileWriter(path, 13, 100), np.arange(1234, dtype="<u4") * 5 % 8192
    for key, part in zip((None, 5, 6), np.split(ids, [0, 700])):
        out.add(key, part)
    out.close()
    source = IdFile(path)
    assert source.ends.tolist() == [0, 700, 1234] and source.unknown.tolist() == [True, False, False]
    for a, b in ((0, 1234), (0, 0), (99, 101), (103, 357), (1233, 1234)):
        assert (source.read(a, b) == ids[a:b]).all()


def test_token_files(spark, libraries, monkeypatch):
    monkeypatch.setattr("passagekit.llm.token_files.AT_ONCE", 50)
    ids = [None, 7, 3, 3, *range(10, 6 + len(ODD))]
    docs = awkward(spark, ODD, ids=ids)
    files = write_token_files(docs, BYTES, session_folder(spark), 50257, block=32)
    out = sorted(read_documents(files).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in out]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    expected = sorted((-1 if i is None else i, len(x := [*ids_of(libraries[BYTES], t), 2]), zlib.crc32(np.array(x, "<u4").tobytes()))
                      for i, t in zip(ids, ODD))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == expected
    assert [r["start"] for r in out] == np.cumsum([0, *[r["n_tokens"] for r in out][:-1]]).tolist()
    empty = write_token_files(spark.createDataFrame([], DOCS), BYTES, session_folder(spark), 50257)
    assert read_documents(empty).count() == 0


def test_packing_places_every_piece(spark, libraries):
    texts = ODD + ["long words here " * 400, None, "b"]
    ids = [None, *range(1, len(texts) - 1), 1]
    out = pack_documents(awkward(spark, texts, ids=ids), WORDS, capacity=64, group_pieces=20).collect()
    expected = []
    for i, t in zip(ids, texts):
        x = np.array([*ids_of(libraries[WORDS], t), 0], "<u4")
        expected += [(-1 if i is None else i, p, a, len(x[a:a + 64]), zlib.crc32(x[a:a + 64].tobytes())) for p, a in enumerate(range(0, len(x), 64))]
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in out) == sorted(expected)
    homes = {}
    for r in out:
        homes.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in homes.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places][:-1]]).tolist() and sum(n for _, n in places) <= 64
    assert pack_documents(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_exchanges_save_a_bin_that_best_fit_needs():
    sizes = [4, 4, 4, 3, 3, 3, 3, 3, 3, 2, 2, 2]  # 36 in bins of 12: best fit may need four
    assert len(pack_sizes(sizes, 12)) == 3
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(40)]
        bins = pack_sizes(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(40)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(best_fit(sizes, 100))
    assert pack_sizes([], 10) == [] and pack_sizes([10, 10], 10) == [[0], [1]]


def test_exchanges_go_on_until_no_bin_has_one():
    rng = random.Random(2)
    sizes = [rng.randint(500, 800) for _ in range(800)]  # some hundred bins that are not full, and more than 300 exchanges
    bins = pack_sizes(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(800)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 264 < len(best_fit(sizes, 2048))
    state = _Exchange(bins, sizes, 2048)
    assert not any(state.better(b) for b in range(len(bins)) if state.fill[b] < 2048)


def test_exchanges_save_sequences_and_the_bound_holds():
    rng = random.Random(1)
    sizes = [rng.randrange(500, 900) for _ in range(600)]
    packed = pack_sizes(sizes, 2048)
    assert sorted(i for b in packed for i in b) == list(range(600)) and all(sum(sizes[i] for i in b) <= 2048 for b in packed)
    assert least_bins(sizes, 2048) <= len(packed) < len(best_fit(sizes, 2048))

    def optimum(left, capacity, bins=()):
        if not left:
            return len(bins)
        options = [optimum(left[1:], capacity, (*bins[:i], b + left[0], *bins[i + 1:])) for i, b in enumerate(bins) if b + left[0] <= capacity]
        return min([*options, optimum(left[1:], capacity, (*bins, left[0]))])

    for _ in range(60):
        sizes = [rng.randrange(1, 13) for _ in range(6)]
        assert -(-sum(sizes) // 12) <= least_bins(sizes, 12) <= optimum(sizes, 12)
