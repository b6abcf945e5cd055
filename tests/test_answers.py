import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagekit.catalog.stubs import fingerprint_model, length_judge
from passagekit.functions.text import GENERATION_ERROR, UNKNOWN_OUTPUT
from passagekit.operators.embedding import hash_embed
from passagekit.operators.evaluation import align, alignment_problems, judge, judge_prompt, quality_score, retrieval_score
from passagekit.operators.generation import generate, send_request, token_cost
from passagekit.operators.lexical import bm25_index
from passagekit.operators.prompts import build_prompt, context_budget
from passagekit.plans.answering import AnswerConfig, answer_questions, conversation_requests, route_conversations, run_experiment
from passagekit.plans.evaluating import evaluate
from passagekit.sources.corpus import read_references, read_responses


def test_budgets(spark):
    rows = spark.createDataFrame([("gpt-4",), ("unknown",), ("meta-llama/Llama-3.2-3B-Instruct",)], "llm string")
    text = " ".join(["w"] * 600)
    found = {r["llm"]: tuple(r)[1:] for r in context_budget(rows, system=text).collect()}
    assert found["gpt-4"] == (4096 - 600, 4096, False)
    assert found["unknown"] == (2048 - 600, 2048, False)
    assert found["meta-llama/Llama-3.2-3B-Instruct"] == (0, 512, True)
    short = context_budget(rows.filter("llm = 'unknown'"), system=" ".join(["w"] * 20)).first()
    assert (short["input_budget"], short["output_budget"]) == (2028, 2048)


def test_prompts_are_written_as_python_writes_them(spark):
    texts = ["it's\n", 'say "x"', "back\\slash", "\x07\xa0é"]
    rows = spark.createDataFrame([("q", texts)], "query string, texts array<string>")
    prompt = build_prompt(rows, system="S", assistant="", budget_col=None).first()["prompt"]
    assert prompt == f"S query: q, context: {texts}"
    chunk = rows.select("query", F.array(F.struct(F.lit(1).alias("id"), F.lit("t").alias("text"), F.lit("s").alias("source"))).alias("chunks"))
    assert build_prompt(chunk, context_col="chunks", budget_col=None).first()["prompt"] == (
        "query: q, context: " + str([{"id": 1, "text": "t", "source": "s"}]))


def moody_model():
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return {"other": 1} if prompt == "odd" else [{"generated_text": prompt.upper()}]
    return model


def test_generation_survives_failures(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "odd"), (4, None)], "qid long, prompt string")
    found = {r["qid"]: (r["answer"], r["error"]) for r in generate(rows, moody_model).collect()}
    assert found == {1: ("OK", None), 2: (GENERATION_ERROR, "RuntimeError: no"), 3: (UNKNOWN_OUTPUT, None), 4: (None, "no prompt")}
    assert send_request(rows.filter("qid = 2"), moody_model, retry_interval=0.0).first()["answer"] == ""


def test_cost(spark):
    usage = spark.createDataFrame([("meta-llama/Llama-2-70b-chat-hf", 1_000_000, 500_000), ("mine", 5, 5)],
                                  "llm string, prompt_tokens long, sampled_tokens long")
    assert {r["llm"]: r["cost"] for r in token_cost(usage).collect()} == {"meta-llama/Llama-2-70b-chat-hf": 1.5, "mine": None}


REFERENCES = [(0, "q0", "a", "u#a"), (1, "q1", "b", ""), (2, "q2", "", "w#x")]
RESPONSES = [(0, "q0", ["u#z"], "x"), (1, "q1", [], "y"), (2, "q2", ["v"], "z")]


def pair(spark, references=REFERENCES, responses=RESPONSES):
    return (spark.createDataFrame(references, "qid long, question string, answer string, source string"),
            spark.createDataFrame(responses, "qid long, question string, sources array<string>, answer string"))


def test_scores(spark):
    assert retrieval_score(align(*pair(spark))).first()[0] == pytest.approx(2 / 3)
    results = spark.createDataFrame([(4.0, "a"), (0.0, "b"), (3.0, "")], "score double, reference_answer string")
    assert quality_score(results).first()[0] == 4.0
    assert quality_score(results.filter("score = 0")).first()[0] is None


def test_misaligned_sets_stop(spark):
    for responses in (RESPONSES[:2], RESPONSES + [(9, "q9", [], "")], [(0, "other", [], "")] + RESPONSES[1:]):
        with pytest.raises(PySparkException):
            align(*pair(spark, responses=responses)).collect()
        with pytest.raises(PySparkException):
            retrieval_score(align(*pair(spark, responses=responses))).collect()
    assert tuple(alignment_problems(*pair(spark, responses=[(0, "other", [], ""), (7, "q7", [], "")])).first()) == (1, 2, 1, 1)


def test_judging(spark, tmp_path):
    pairs = align(*pair(spark))
    first = judge_prompt(pairs, "S").filter("qid = 0").first()["prompt"]
    assert first == "S " + str({"question": "q0", "generated_answer": "x", "reference_answer": "a"})
    assert judge(pairs, length_judge).filter("score_error is not null").count() == 0
    results, scores = evaluate(*pair(spark), length_judge, "exp", "owner/Judge", str(tmp_path))
    assert (tmp_path / "exp_judge" / "results").is_dir()
    summary = spark.read.json(str(tmp_path / "exp_judge" / "summary")).first()
    assert summary["config"]["evaluator"] == "owner/Judge"
    assert summary["retrieval_score"] == pytest.approx(scores.first()["retrieval_score"]) and results.count() == 3


def test_reading_records(spark, tmp_path):
    references = tmp_path / "references.json"
    references.write_text(json.dumps([{"question": f"q{i}", "answer": "a", "source": "s", "extra": 1} for i in range(3)]))
    assert [tuple(r) for r in read_references(spark, str(references), 2).orderBy("qid").collect()] == [(0, "q0", "a", "s"), (1, "q1", "a", "s")]
    responses = tmp_path / "responses.json"
    responses.write_text(json.dumps({"config": {"x": 1}, "results": [
        {"question": "q", "sources": ["s"], "document_ids": [1, 2], "answer": "a", "llm": "m"}]}, indent=4))
    assert [tuple(r) for r in read_responses(spark, str(responses)).collect()] == [(0, "q", ["s"], [1, 2], "a", "m")]
    read_references(spark, str(references)).write.json(str(tmp_path / "lines"))
    read_references(spark, str(references)).write.parquet(str(tmp_path / "rows.parquet"))
    assert read_references(spark, str(tmp_path / "lines")).count() == read_references(spark, str(tmp_path / "rows.parquet")).count() == 3


CHUNKS = [(1, "red fox", "s1"), (2, "blue cat", "s2"), (3, "red dog", "s1"), (4, "grey owl", "s3")]


def test_answering(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "id long, text string, source string")
    index, lexical = hash_embed(chunks, "text", 64), bm25_index(chunks)
    asked = spark.createDataFrame([(7, "red fox"), (8, "owl")], "qid long, query string")
    config = AnswerConfig(num_chunks=2, lexical_search_k=1)
    found = {r["qid"]: r for r in answer_questions(asked, index, fingerprint_model, lexical, config=config).collect()}
    assert found[7]["document_ids"] == [1, 1, 3] and found[7]["sources"] == ["s1"]
    assert found[8]["document_ids"][:2] == [4, 4] and found[8]["llm"] == config.llm
    grid = AnswerConfig(num_chunks=2, lexical_search_k=1, max_questions=1)
    again = {r["qid"]: r["document_ids"] for r in answer_questions(asked, index, fingerprint_model, lexical, config=grid).collect()}
    assert again == {q: r["document_ids"] for q, r in found.items()}
    target = run_experiment("e", asked, index, fingerprint_model, str(tmp_path), lexical, config=config)
    assert spark.read.json(f"{target}/config").first()["config"]["num_chunks"] == 2
    assert read_responses(spark, f"{target}/results").count() == 2


def test_question_without_hits(spark):
    index = hash_embed(spark.createDataFrame([], "id long, text string, source string"), "text", 64)
    asked = spark.createDataFrame([(7, "red fox")], "qid long, query string")
    row = answer_questions(asked, index, moody_model).first()
    assert (row["answer"], row["sources"], row["document_ids"], row["error"]) == ("QUERY: RED FOX, CONTEXT: []", [], [], None)


def test_conversations(spark):
    chunks = spark.createDataFrame(CHUNKS, "id long, text string, source string")
    index = hash_embed(chunks, "text", 64)
    requests = spark.createDataFrame(
        [(1, [("user", "red fox")]), (2, [("user", "a"), ("assistant", "b"), ("user", "c")])],
        "conv_id long, messages array<struct<role string, content string>>")
    found = {r["conv_id"]: r for r in route_conversations(requests, index, moody_model, config=AnswerConfig(num_chunks=1)).collect()}
    assert found[1]["document_ids"] == [1] and found[2]["document_ids"] == [] and found[2]["answer"] == "A B C"
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (2, 0, "user", "v"), (2, 2, "user", "w")],
                                  "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, conversation_requests(turns).collect())) == [(1, 1, "u", False), (2, 0, "v", True), (2, 2, "w", False)]
