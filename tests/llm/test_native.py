"""Line dedup and source mixing: edge cases, and no Python in their plans."""

import pytest

from passagekit.llm.line_dedup import drop_site_lines
from passagekit.llm.mixing import mix_sources, source_rates
from tests.llm.data import DOCS, awkward, rows_of


def test_lines_of_a_site(spark):
    texts = ["menu\na1\n", " menu \na2\nmenu", "menu\n\na3", None, "", "menu", "x\nmenu", "menu\nmenu", "once", "once"]
    sources = ["a", "a", "a", "a", "a", "b", "b", None, "a", "a"]
    out = {r["doc_id"]: r for r in drop_site_lines(awkward(spark, texts, sources), ratio=0.3).collect()}
    assert [out[i]["text"] for i in range(10)] == ["a1\n", "a2", "\na3", None, "", "menu", "x\nmenu", "menu\nmenu", "once", "once"]
    assert [out[i]["n_dropped"] for i in range(10)] == [1, 2, 1, 0, 0, 0, 0, 0, 0, 0]
    assert [out[i]["n_lines"] for i in range(5)] == [3, 3, 3, 0, 1]
    assert out[0]["row"] == 7 and out[0]["n"] == 9


def test_line_dedup_without_rows_and_with_long_text(spark):
    assert drop_site_lines(spark.createDataFrame([], DOCS)).count() == 0
    long = "\n".join(f"line {i}" for i in range(50_000))
    out = drop_site_lines(awkward(spark, [long] * 3), ratio=0.5).collect()
    assert [r["text"] for r in out] == [""] * 3 and out[0]["n_dropped"] == 50_000


def test_many_shared_lines_are_looked_up_as_brute_force_does(spark):
    texts = ["\n".join(f" line {(i * 37 + k * (i + 1)) % 900} " for k in range(700)) for i in range(6)]
    pages = [{line.strip(" ") for line in t.split("\n")} for t in texts]
    often = {line for page in pages for line in page if sum(line in p for p in pages) >= 4}
    out = {r["doc_id"]: r for r in drop_site_lines(awkward(spark, texts), ratio=0.6).collect()}
    for i, t in enumerate(texts):
        kept = [line for line in t.split("\n") if line.strip(" ") not in often]
        assert out[i]["text"] == "\n".join(kept) and out[i]["n_dropped"] == 700 - len(kept)


@pytest.mark.parametrize("broadcast", [0, 10 ** 6])
def test_lines_by_shuffle_or_broadcast(spark, monkeypatch, broadcast):
    monkeypatch.setattr("passagekit.llm.line_dedup.BROADCAST_LINES", broadcast)
    out = drop_site_lines(awkward(spark, [f"same\n{i}" for i in range(40)]))
    assert sorted(r["text"] for r in out.collect()) == sorted(str(i) for i in range(40))


def test_mixing_rates_and_copies(spark):
    docs = awkward(spark, ["x" * 10] * 300 + ["y" * 10] * 100, ["big"] * 300 + ["small"] * 100)
    rates = {r["site"]: r for r in source_rates(docs, weights={"big": 1.0, "small": 1.0}, epochs=3.0).collect()}
    assert rates["big"]["rate"] == pytest.approx(2.0) and rates["small"]["rate"] == pytest.approx(6.0)
    out = mix_sources(docs, weights={"big": 1.0, "small": 1.0}, epochs=3.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 600) < 100 and abs(n["small"] - 600) < 100
    assert sorted(rows_of(out)) == sorted(rows_of(mix_sources(docs, weights={"big": 1.0, "small": 1.0}, epochs=3.0)))
    assert out.select("doc_id", "copy").distinct().count() == out.count()


def test_mixing_large_rate_in_parts(spark):
    docs = awkward(spark, ["z"] * 5 + ["q" * 5000], ["rare"] * 5 + ["rest"])
    out = mix_sources(docs, weights={"rare": 1.0, "rest": 1.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["rare"] - 2502) < 250  # a rate of about 500 for each of five
    assert out.where("source = 'rare'").select("doc_id", "copy").distinct().count() == n["rare"]


def test_mixing_awkward_rows(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    docs = awkward(spark, [None, "", "abc", "abc", "abc"], [None, "e", None, "s", "s"], [None, 1, 2, 3, 3])
    out = mix_sources(docs, epochs=30.0)
    assert {r["source"] for r in out.select("source").distinct().collect()} == {None, "s"}
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [r["count"] for r in out.where("doc_id = 3").groupBy("copy").count().collect()] == [2] * out.where("doc_id = 3").select("copy").distinct().count()


def test_no_python_in_native_plans(spark):
    docs = awkward(spark, ["a\nb"] * 20)
    for out in (drop_site_lines(docs), mix_sources(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_copies_of_a_page_have_one_vote(spark):
    texts = ["menu\nline one\nline two"] * 5 + [f"menu\nown {i}" for i in range(8)] + [None, ""]
    out = {r["doc_id"]: r["text"] for r in drop_site_lines(awkward(spark, texts), copies_vote=False).collect()}
    assert [out[i] for i in range(15)] == ["line one\nline two"] * 5 + [f"own {i}" for i in range(8)] + [None, ""]
    plan = drop_site_lines(awkward(spark, texts), copies_vote=False)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
