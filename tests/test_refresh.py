"""Refreshing a stored index, by batch and by stream, against a build from scratch; numbers of files."""

import os

import pytest

from passagekit.plans.index_build import IndexConfig, build_index
from passagekit.schemas import INDEX
from passagekit.sources.corpus import grown_numbers, pages_from_files
from passagekit.sources.index_store import RANGE
from passagekit.sources.refresh import page_changes, refresh_index, stored_index, stored_pages, upsert_pages
from passagekit.streaming.jobs import read_arrivals, refresh_stream

CONFIG = IndexConfig(model="hash-16", chunk_size=12, chunk_overlap=3, domain=None)


def pages(spark, rows):
    html = lambda t: None if t is None else f'<section id="a">{t}</section>'
    return spark.createDataFrame([(i, u, html(t)) for i, u, t in rows], "page_id long, url string, html string")


def same_as_built(spark, path, rows):
    held = sorted(map(tuple, stored_index(spark, path, *INDEX.names).select(*INDEX.names).collect()))
    assert held == sorted(map(tuple, build_index(pages(spark, rows), CONFIG).collect()))
    assert {r["page_id"] for r in stored_pages(spark, path).collect()} == {r[0] for r in rows}


def test_refresh_equals_a_build(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(i, f"u{i}", f"some words of page {i}") for i in range(40)] + [(50, "n", None)]
    changes = refresh_index(pages(spark, first), path, CONFIG, 2)
    assert {r["status"] for r in changes.collect()} == {"new"}
    same_as_built(spark, path, first)
    files = {f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    # 8 to 11 go, a folder of its own; 3 changes; 17 moves to another URL; 41 is new; 50 gets a text
    second = [(i, f"v{i}" if i == 17 else u, "other text" if i == 3 else t) for i, u, t in first if i not in (8, 9, 10, 11, 50)]
    second += [(41, "u41", "new words"), (50, "n", "")]
    changes = refresh_index(pages(spark, second), path, CONFIG, 2)
    found = {}
    for r in changes.collect():
        found.setdefault(r["status"], set()).add(r["page_id"])
    assert found["new"] == {41} and found["changed"] == {3, 17, 50} and found["gone"] == {8, 9, 10, 11} and len(found["same"]) == 34
    same_as_built(spark, path, second)
    left = {f for f in files if os.path.exists(f)}
    assert {int(f.split(f"{RANGE}=")[1].split("/")[0]) for f in files - left} == {0, 2, 4, 12}  # folders without a change are as they were
    assert not [d for d, _, _ in os.walk(path) if d.endswith(f"{RANGE}=2")]
    # again: nothing to do
    assert {r["status"] for r in refresh_index(pages(spark, second), path, CONFIG, 2).collect()} == {"same"}
    assert {f for f in left if os.path.exists(f)} == left


def test_a_broken_run_is_made_good(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, f"u{i}", f"words {i}") for i in range(6)]
    refresh_index(pages(spark, rows), path, CONFIG, 1)
    later = [(i, u, t + " more") for i, u, t in rows]
    # chunks were replaced but the table of pages was not
    before = [tuple(r)[:3] for r in stored_pages(spark, path).collect()]
    upsert_pages(pages(spark, later), path, CONFIG, 1)
    spark.createDataFrame([(*r, r[0] >> 1) for r in before], f"page_id long, url string, digest string, {RANGE} long").write.mode(
        "overwrite").partitionBy(RANGE).parquet(f"{path}/pages")
    assert {r["status"] for r in page_changes(pages(spark, later), stored_pages(spark, path)).collect()} == {"changed"}
    refresh_index(pages(spark, later), path, CONFIG, 1)
    same_as_built(spark, path, later)


def test_refresh_of_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert refresh_index(pages(spark, []), path, CONFIG).count() == 0
    refresh_index(pages(spark, [(1, "u", "t")]), path, CONFIG)
    assert [r["status"] for r in refresh_index(pages(spark, []), path, CONFIG).collect()] == ["gone"]
    assert stored_pages(spark, path).count() == 0


def test_stream_of_repeated_and_changed_pages(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    first = [(i, f"u{i}", f"words of page {i}") for i in range(10)]
    batches = [first, first[:4], [(2, "u2", "changed"), (20, "u20", "late")], [(2, "u2", "changed")], [(2, "u2", "words of page 2")]]
    for batch in batches:
        pages(spark, batch).coalesce(1).write.mode("append").parquet(source)
        refresh_stream(read_arrivals(spark, source), path, str(tmp_path / "state"), CONFIG, page_bits=2).awaitTermination()
    same_as_built(spark, path, [*first, (20, "u20", "late")])


def test_repeats_within_one_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    rows = [(i, f"u{i}", f"words of page {i}") for i in range(5)]
    for _ in range(3):
        pages(spark, rows).write.mode("append").parquet(source)
    refresh_stream(read_arrivals(spark, source), path, str(tmp_path / "state"), CONFIG).awaitTermination()
    same_as_built(spark, path, rows)


def test_numbers_only_grow(spark, tmp_path):
    path = str(tmp_path / "numbers")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    held = lambda df: {r["name"]: r["page_id"] for r in df.collect()}
    assert held(grown_numbers(names("m", "c", "c", None), path)) == {"c": 0, "m": 1}
    assert held(grown_numbers(names("a", "m", "z"), path)) == {"c": 0, "m": 1, "a": 2, "z": 3}
    assert held(grown_numbers(names(), path)) == {"c": 0, "m": 1, "a": 2, "z": 3}


@pytest.mark.parametrize("most", [1000, 2])
def test_files_keep_their_numbers(spark, tmp_path, most):
    folder, numbers = tmp_path / "html", str(tmp_path / "numbers")
    folder.mkdir()

    def add(*names):
        for n in names:
            (folder / f"{n}.html").write_text(f"<p>{n}</p>")
        rows = pages_from_files(spark, str(folder), numbers=numbers, max_names=most)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan  # the HTML is not moved
        return {r["url"].rsplit("/", 1)[-1][:-5]: (r["page_id"], r["html"]) for r in rows.collect()}

    assert add("d", "h") == {"d": (0, "<p>d</p>"), "h": (1, "<p>h</p>")}
    assert add("a", "f", "x") == {n: (i, f"<p>{n}</p>") for i, n in enumerate(["d", "h", "a", "f", "x"])}
    (folder / "d.html").unlink()
    assert add("b") == {n: (i, f"<p>{n}</p>") for i, n in enumerate(["d", "h", "a", "f", "x", "b"]) if n != "d"}
