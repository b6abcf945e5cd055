"""Batched models and their repeats, message prefixes, classifiers as tables, whole experiments."""

import json
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from passagekit.catalog.stubs import fingerprint_model
from passagekit.operators.classify import classifier_weights, classify_with_threshold, fit_tag_classifier, route, score_with_weights
from passagekit.operators.embedding import hash_embed
from passagekit.operators.generation import ask_all, generate, generate_by_name
from passagekit.operators.markup import parse_reported
from passagekit.operators.sections import damaged_pages, extract_sections
from passagekit.plans.answering import AnswerConfig, answer_timed, conversation_messages, experiment_from_pages, route_conversations
from passagekit.plans.index_build import IndexConfig
from passagekit.sources.corpus import read_responses


def test_rounds_of_calls(monkeypatch):
    waits, calls, seen = [], [], set()
    monkeypatch.setattr("passagekit.operators.generation.time.sleep", waits.append)

    def model(inputs):
        calls.append(list(inputs))
        out = [x.upper() if x in seen else RuntimeError("first time") for x in inputs]
        seen.update(inputs)
        return out

    rows = ask_all(model, ["a", "b", None, "c", "d", "e"], 2, 5.0, "-", 2)
    assert [r["answer"] for r in rows] == ["A", "B", None, "C", "D", "E"] and rows[2]["error"] == "no prompt"
    assert calls == [["a", "b"], ["c", "d"], ["e"]] * 2 and waits == [5.0]  # failed rows together, one wait for all


def test_a_bad_row_is_asked_alone_at_last():
    sizes = []

    def model(inputs):
        sizes.append(len(inputs))
        if "bad" in inputs:
            raise ValueError("no")
        return [x + "!" for x in inputs]

    rows = ask_all(model, ["a", "bad", "b", "c"], 1, 0.0, "", 3)
    assert [(r["answer"], r["error"]) for r in rows] == [("a!", None), ("", "ValueError: no"), ("b!", None), ("c!", None)]
    assert sizes == [3, 1, 1, 1, 1]
    assert ask_all(lambda x: [], ["a"], 0, 0.0, "-", 5) == [{"answer": "-", "error": "ValueError: 0 outputs for 1 inputs"}]
    assert ask_all(model, [], 3, 0.0, "", 4) == []


def list_model(suffix):
    return lambda prompts: [p + suffix for p in prompts]


def budget_model(llm):
    return lambda prompts, max_tokens: [f"{llm}{m}{p}" for p, m in zip(prompts, max_tokens)]


def test_batched_models_over_tables(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"p{i}", "x" if i % 2 else "y", i) for i in range(9)],
                                 "qid long, prompt string, llm string, output_budget int")
    found = {r["qid"]: r["answer"] for r in generate(rows, list_model, batch_size=4, suffix="?").collect()}
    assert found == {i: None if i == 3 else f"p{i}?" for i in range(9)}
    named = {r["qid"]: (r["answer"], r["error"]) for r in generate_by_name(rows, {"x": budget_model}, batch_size=2, fallback="-").collect()}
    assert named == {i: (None, "no prompt") if i == 3 else (f"x{i}p{i}", None) if i % 2 else ("-", "no model is named y") for i in range(9)}


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_prefixes(spark, segment):
    rng = random.Random(segment)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{c}-{t}") for c in (1, 2, None) for t in range(8)]
    rows += [(4, None, "user", "n"), (4, 0, "assistant", None), (4, 0, "user", "z"), (5, 0, "assistant", "only")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"]): [tuple(m) for m in r["messages"]] for r in conversation_messages(turns, segment=segment).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        for i, (_, turn, role, _) in enumerate(own):
            if role == "user":
                want[conv, turn] = [(r[2], r[3] or "") for r in own[:i + 1]]
    assert found == want


def roles_model():
    return lambda messages: "|".join(m["role"] for m in messages)


def test_follow_ups_keep_their_roles(spark):
    index = hash_embed(spark.createDataFrame([(1, "red fox", "s")], "id long, text string, source string"), "text", 64)
    turns = spark.createDataFrame([(7, 0, "user", "red"), (7, 1, "assistant", "yes"), (7, 2, "user", "why")],
                                  "conv_id long, turn long, role string, text string")
    rows = route_conversations(conversation_messages(turns), index, fingerprint_model, config=AnswerConfig(num_chunks=1), chat_factory=roles_model)
    found = {r["turn"]: (r["document_ids"], r["answer"], r["question"]) for r in rows.collect()}
    assert found[0][0] == [1] and found[2] == ([], "user|assistant|user", "red")


def test_classifier_saved_loaded_and_as_a_table(spark, tmp_path):
    rng = random.Random(1)
    words = {"a": ["red", "fox", "runs"], "b": ["blue", "cat", "sits"], "c": ["old", "owl", "runs"]}
    rows = [(i, " ".join(rng.choice(words[t]) for _ in range(6)), t) for i, t in enumerate(rng.choice("abc") for _ in range(90))]
    training = spark.createDataFrame(rows + [(900, None, "a"), (901, "red", None)], "id long, text string, label string")
    fit_tag_classifier(training, algorithm="bayes").write().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    asked = spark.createDataFrame([(1, "red fox."), (2, "catBlue"), (3, "nothing known"), (4, ""), (5, None)], "id long, query string")
    by_model = {r["id"]: (r["predicted"], r["p"]) for r in classify_with_threshold(asked, model, probabilities="p").collect()}
    assert by_model[1][0] == "a" and by_model[2][0] == "b"
    by_join = {r["id"]: r["probabilities"] for r in score_with_weights(asked, classifier_weights(model), "id").collect()}
    assert by_join.keys() == by_model.keys()
    for key, chances in by_join.items():
        assert chances == pytest.approx(by_model[key][1], abs=1e-9) and sum(chances) == pytest.approx(1.0)


def test_subwords_reach_the_classifier(spark):
    rows = spark.createDataFrame([("redfox", "1"), ("bluecat", "0")] * 10, "text string, label string")
    pieces = lambda text: F.regexp_replace(text, "(red|blue)", "$1 ")
    model = fit_tag_classifier(rows, algorithm="bayes", subwords=pieces)
    assert set(model.stages[1].vocabulary) == {"red", "fox", "blue", "cat"}
    asked = spark.createDataFrame([("redcat redfox",)], "query string")
    assert classify_with_threshold(asked, model, subwords=pieces).first()["predicted"] == "1"
    assert route(asked, fit_tag_classifier(rows, algorithm="logistic"), "cheap", "strong").count() == 1


def warm_model(temperature):
    return lambda prompt: f"{temperature}:{len(prompt)}"


def test_a_whole_experiment_builds_once(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", f'<section id="a">fox number {i}</section>') for i in range(5)], "page_id long, url string, html string")
    (tmp_path / "r.json").write_text(json.dumps([{"question": f"fox {i}", "answer": "", "source": ""} for i in range(4)]))
    config = IndexConfig(model="hash-16", chunk_size=20, chunk_overlap=0, domain=None)
    built = []
    monkeypatch.setattr("passagekit.plans.answering.build_index", lambda *a: built.append(1) or __import__(
        "passagekit.plans.index_build", fromlist=["build_index"]).build_index(*a))
    for name in ("one", "two"):
        target = experiment_from_pages(name, pages, str(tmp_path / "r.json"), str(tmp_path / "out"), warm_model, config,
                                       AnswerConfig(num_chunks=2), num_samples=3, temperature=0.5)
    assert built == [1]
    record = spark.read.json(f"{target}/config").first()["config"]
    assert (record["chunk_size"], record["num_samples"], record["temperature"], record["embedding_model"]) == (20, 3, 0.5, "hash-16")
    rows = read_responses(spark, f"{target}/results").collect()
    assert len(rows) == 3 and all(r["answer"].startswith("0.5:") and len(r["document_ids"]) == 3 for r in rows)


def test_timed_answers(spark):
    index = hash_embed(spark.createDataFrame([(1, "red fox", "s")], "id long, text string, source string"), "text", 64)
    answers, times = answer_timed(spark.createDataFrame([(7, "red")], "qid long, query string"), index, fingerprint_model)
    assert answers.first()["chunks"][0]["text"] == "red fox" and set(times) == {
        "semantic_search_time_seconds", "response_generation_time_seconds", "execution_time_seconds"}
    assert times["execution_time_seconds"] >= times["semantic_search_time_seconds"] >= 0


def test_damage_is_reported(spark):
    pages = spark.createDataFrame([(1, "u", "<section id='a'>x <![foo]> y</section>"), (2, "u", "<section id='a'>x</section>"), (3, "u", None)],
                                  "page_id long, url string, html string")
    assert {r["page_id"]: r["damaged"] for r in damaged_pages(pages).collect()} == {1: True, 2: False, 3: False}
    assert {r["page_id"]: r["hurt"] for r in extract_sections(pages, domain=None, damaged="hurt").collect()} == {1: True, 2: False}


def test_only_the_unread_rest_becomes_a_comment(monkeypatch):
    from passagekit.operators import markup

    def stop(self, i, *rest):
        raise AssertionError("gives up")

    monkeypatch.setattr(markup._TreeBuilder, "parse_marked_section", stop)
    root, damaged = parse_reported("<p>one</p>\n<p>two <![foo]> three")
    texts = [c[1] for e in root.elements() for c in e.children if not isinstance(c, markup.Element)]
    assert damaged and root.text().count("one") == 1 and any("three" in t for t in texts) and not any("<p>one" in t for t in texts)
