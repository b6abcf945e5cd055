import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from passagekit.plans.index_build import IndexConfig, build_index, chunk_documents
from passagekit.operators.chunking import SEPARATORS, assign_ids, chunk_text, split_text

GOLDEN = [
    ("one two three four five", 10, 4, ["one two", "two three", "four five"]),
    ("alpha beta\n\ngamma delta epsilon", 12, 0, ["alpha beta", "gamma delta", "epsilon"]),
    ("abcdefghijkl", 5, 2, ["abcde", "defgh", "ghijk", "jkl"]),
    ("aa bb cc dd ee", 5, 3, ["aa bb", "cc", "dd", "ee"]),
    ("x\ny\n\nzzzzzzzz yy", 6, 2, ["x\ny", "zzzzz", "zzzzz", "yy"]),
    ("  hello  ", 20, 5, ["hello"]),
    (" \n ", 20, 5, []),
    ("", 20, 5, []),
]


@pytest.mark.parametrize("text,size,overlap,expected", GOLDEN)
def test_golden(text, size, overlap, expected):
    assert split_text(text, size, overlap) == expected


def merge_pieces(pieces, size, overlap):
    """The contract's merge step, piece by piece."""
    chunks, held, total = [], [], 0
    for piece in pieces:
        if total + len(piece) > size and held:
            chunks.append("".join(held).strip())
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def split_by_contract(text, size, overlap, separators):
    separator, finer = next((s, separators[i + 1:]) for i, s in enumerate(separators) if s in text)
    if separator:
        parts = text.split(separator)
        pieces = [p for p in [parts[0]] + [separator + p for p in parts[1:]] if p]
    else:
        pieces = list(text)
    chunks, small = [], []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            chunks += merge_pieces(small, size, overlap)
            small = []
        chunks += split_by_contract(piece, size, overlap, finer) if finer else [piece]
    return chunks + (merge_pieces(small, size, overlap) if small else [])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 12), st.integers(0, 12))
def test_equals_the_contract(text, size, overlap):
    overlap = min(overlap, size)
    expected = split_by_contract(text, size, overlap, list(SEPARATORS)) if text else []
    assert split_text(text, size, overlap) == expected


def test_null_and_empty_texts_vanish(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ab cd")], "page_id long, text string")
    assert [tuple(r) for r in chunk_text(rows, 3, 0).collect()] == [(3, 0, "ab"), (3, 1, "cd")]


def test_overlap_beyond_size_is_refused(spark):
    with pytest.raises(ValueError):
        chunk_text(spark.createDataFrame([("a",)], "text string"), 3, 4)


def test_ids_are_packed_and_guarded(spark):
    rows = spark.createDataFrame([(5, 7)], "page_id long, chunk_pos int")
    assert assign_ids(rows).first()["id"] == (5 << 28) + 7
    late = spark.createDataFrame([(5, 1 << 28)], "page_id long, chunk_pos int")
    with pytest.raises(PySparkException, match="chunk_pos"):
        assign_ids(late).collect()


def test_ids_run_over_all_sections_of_a_page(spark):
    html = "".join(f"<section id='s{i}'>{'w ' * 400}</section>" for i in range(3))
    pages = spark.createDataFrame([(5, "http://h/x", html)], "page_id long, url string, html string")
    rows = build_index(pages, IndexConfig(domain=None)).orderBy("id").collect()
    assert [r["id"] for r in rows] == [(5 << 28) + i for i in range(len(rows))]
    assert list(dict.fromkeys(r["source"] for r in rows)) == ["http://h/x#s0", "http://h/x#s1", "http://h/x#s2"]


def test_a_very_long_document_has_an_id_for_each_chunk(spark):
    text = ("x" * 249 + " ") * 16_600
    rows = chunk_documents(spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string"))
    assert (rows.count(), rows.select("id").distinct().count()) == (16_600, 16_600)
