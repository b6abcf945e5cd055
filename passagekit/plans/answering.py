"""Answer tables of questions: retrieve, merge, re-rank, prompt and generate."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace
from time import perf_counter

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.functions.uris import TAG_PATTERN
from passagekit.operators.classify import classify_with_threshold
from passagekit.operators.embedding import dimension_of, embed_with
from passagekit.operators.fusion import attach_chunks, collect_context, rerank_by_tag, splice, truncate_hits
from passagekit.operators.generation import generate, generate_by_name, send_request
from passagekit.operators.knn import knn
from passagekit.operators.lexical import LexicalIndex, bm25_index, bm25_topk
from passagekit.operators.prompts import build_prompt, context_budget
from passagekit.operators.topk import MAX_QUESTIONS
from passagekit.plans.index_build import IndexConfig, build_index
from passagekit.schemas import LEXICAL_K, NUM_CHUNKS, RERANK_K, RERANK_THRESHOLD
from passagekit.session import materialize
from passagekit.sources.corpus import read_references
from passagekit.sources.index_store import is_complete, load_or_build_index, snapshot_path
from passagekit.sources.records import write_responses


@dataclass(frozen=True)
class AnswerConfig:
    embedding_model: str = "hash-64"
    models: dict[str, Callable] = field(default_factory=dict)
    num_chunks: int = NUM_CHUNKS
    use_lexical_search: bool = True
    lexical_search_k: int = LEXICAL_K
    use_reranking: bool = False
    rerank_threshold: float = RERANK_THRESHOLD
    rerank_k: int = RERANK_K
    tag_pattern: str = TAG_PATTERN
    llm: str = "meta-llama/Llama-2-70b-chat-hf"
    max_context_length: int | None = None  # None: that of the model
    tokenizer: Callable[[], object] | None = None
    system_content: str = ""
    assistant_content: str = ""
    context_format: str = "texts"
    max_questions: int = MAX_QUESTIONS


# The settings of the deployed service.
SERVING = dict(num_chunks=30, lexical_search_k=1, use_reranking=True, rerank_threshold=0.9, rerank_k=13)
SERVING_CHUNK_SIZE = 700
SERVING_CHUNK_OVERLAP = 50


# Turn numbers of a segment of a conversation, whose messages are gathered in one group.
SEGMENT = 1000

# What a question without any hit has.
_NO_CONTEXT = {
    "document_ids": "array<bigint>", "texts": "array<string>", "sources": "array<string>",
    "chunks": "array<struct<id:bigint,text:string,source:string>>",
}


def retrieve(questions: DataFrame, index: DataFrame, lexical: LexicalIndex | None = None,
             config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """Hits before re-ranking: qid, pos, id, score. Only ids move; texts stay in the index."""
    asked = embed_with(questions.select("qid", "query"), "query", config.embedding_model, config.models)
    hits = knn(asked, index, config.num_chunks, max_questions=config.max_questions)
    if lexical is None or not config.use_lexical_search:
        return hits.select("qid", "pos", "id", F.lit(None).cast("double").alias("score"))
    found = bm25_topk(questions, lexical, config.lexical_search_k, max_questions=config.max_questions)
    return splice(hits, found, config.lexical_search_k)


def rerank(hits: DataFrame, tagged_questions: DataFrame, config: AnswerConfig) -> DataFrame:
    """Put the predicted tag first where there is one, then cut to rerank_k in any case."""
    tags = tagged_questions.select("qid", "predicted")
    return truncate_hits(rerank_by_tag(hits.join(tags, "qid", "left"), pattern=config.tag_pattern), config.rerank_k)


def question_contexts(questions: DataFrame, index: DataFrame, lexical: LexicalIndex | None = None,
                      reranker: PipelineModel | None = None, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """One row per question: its columns, document_ids, texts, sources, chunks.

    The number of questions bounds the hits; few enough let the text lookup scan the index in place. Questions are written
    once, since every step reads them.
    """
    questions = materialize(questions)
    found = retrieve(questions, index, lexical, config)
    hits = attach_chunks(found, index, questions.count() * (config.num_chunks + config.lexical_search_k))
    if reranker is not None and config.use_reranking:
        tagged = classify_with_threshold(questions, reranker, "query", config.rerank_threshold)
        hits = rerank(hits, tagged, config)
    joined = questions.join(collect_context(hits), "qid", "left")
    for name, kind in _NO_CONTEXT.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return joined


def prompts_for(contexts: DataFrame, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """Add llm, budgets and prompt."""
    named = contexts if "llm" in contexts.columns else contexts.withColumn("llm", F.lit(config.llm))
    budgeted = context_budget(named, "llm", config.system_content, config.assistant_content,
                              tokenizer=config.tokenizer, max_context=config.max_context_length)
    column = "chunks" if config.context_format == "dicts" else "texts"
    return build_prompt(budgeted, "query", column, config.system_content, config.assistant_content, tokenizer=config.tokenizer)


def answer_questions(questions: DataFrame, index: DataFrame, factory: Callable[..., object] | Mapping[str, Callable[..., object]],
                     lexical: LexicalIndex | None = None, reranker: PipelineModel | None = None,
                     config: AnswerConfig = AnswerConfig(), **options: object) -> DataFrame:
    """qid, question, sources, document_ids, answer, llm, error.

    With factories by name, each question is answered by the model in its `llm` column (else that of the configuration),
    which is told its share of tokens.
    """
    contexts = question_contexts(questions, index, lexical, reranker, config)
    call = generate_by_name if isinstance(factory, Mapping) else generate
    answered = call(prompts_for(contexts, config), factory, **options)
    return answered.select("qid", F.col("query").alias("question"), "sources", "document_ids", "answer", "llm", "error")


def run_experiment(name: str, questions: DataFrame, index: DataFrame, factory: Callable[..., object], path: str,
                   lexical: LexicalIndex | None = None, reranker: PipelineModel | None = None,
                   config: AnswerConfig = AnswerConfig(), notes: dict | None = None, **options: object) -> str:
    """Answer all questions and write config and results; returns where they lie.

    `notes` adds what the configuration does not know, such as chunk size or temperature.
    """
    results = answer_questions(questions, index, factory, lexical, reranker, config, **options)
    record = {"experiment_name": name, **(notes or {}), **{k: v for k, v in asdict(config).items() if k not in ("models", "tokenizer")}}
    return write_responses(results, record, path)


def experiment_from_pages(name: str, pages: DataFrame, references: str, root: str, factory: Callable[..., object],
                          index_config: IndexConfig = IndexConfig(), config: AnswerConfig = AnswerConfig(),
                          reranker: PipelineModel | None = None, num_samples: int | None = None, **options: object) -> str:
    """The whole experiment: index, lexical index, questions, answers and their record below `root`; returns where the record lies.

    The index of pages (page_id, url, html) is loaded from `root/snapshots` if one of the same model, chunk size and overlap was
    finished there, else built and written; so is the lexical index beside it. Questions come from a file of references. Options,
    such as the temperature, go to the factory and into the record.
    """
    spark = pages.sparkSession
    settings = (index_config.model, index_config.chunk_size, index_config.chunk_overlap)
    index = load_or_build_index(spark, f"{root}/snapshots", index_config.model, dimension_of(index_config.model),
                                *settings[1:], lambda: build_index(pages, index_config))
    lexical = None
    if config.use_lexical_search:
        beside = snapshot_path(f"{root}/lexical", *settings)
        if not is_complete(spark, f"{beside}/stats"):  # written last
            bm25_index(index.select("id", "text")).save(beside)
        lexical = LexicalIndex.load(spark, beside)
    questions = materialize(read_references(spark, references, num_samples).select("qid", F.col("question").alias("query")))
    notes = {
        "chunk_size": index_config.chunk_size, "chunk_overlap": index_config.chunk_overlap, "references": references,
        "num_samples": questions.count(), **options,
    }
    answering = replace(config, embedding_model=index_config.model, models=index_config.models)
    return run_experiment(name, questions, index, factory, f"{root}/responses", lexical, reranker, answering, notes, **options)


def answer_timed(questions: DataFrame, index: DataFrame, factory: Callable[..., object], lexical: LexicalIndex | None = None,
                 reranker: PipelineModel | None = None, config: AnswerConfig = AnswerConfig(),
                 **options: object) -> tuple[DataFrame, dict[str, float]]:
    """The contexts with their responses, and the seconds of the search, of the generation and of both, rounded to hundredths.

    Both steps are written, so the times hold for all questions together and nothing runs twice.
    """
    start = perf_counter()
    contexts = materialize(question_contexts(questions, index, lexical, reranker, config))
    found = perf_counter()
    answers = materialize(generate(prompts_for(contexts, config), factory, into="response", **options))
    done = perf_counter()
    return answers.select("qid", "query", "chunks", "response", "error"), {
        "semantic_search_time_seconds": round(found - start, 2),
        "response_generation_time_seconds": round(done - found, 2),
        "execution_time_seconds": round(done - start, 2),
    }


def conversation_requests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """Each user turn is a request: conv_id, turn, query, retrieves.

    A request is answered from the index only if its message is the conversation's first. Where a
    conversation starts is a combined minimum, so no conversation is ever gathered in one place.
    """
    starts = turns.groupBy(F.col(conv_col).alias("_conv")).agg(F.min(turn_col).alias("_start"))
    asked = turns.filter(F.col(role_col) == "user")
    return asked.join(starts, asked[conv_col] == starts["_conv"]).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(text_col).alias("query"),
        (F.col(turn_col) == F.col("_start")).alias("retrieves"))


def conversation_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The request of each user turn: conv_id, turn, messages. The messages are all turns up to it, as (role, content) in order.

    Turns that share a number are ordered by role and text, and a request ends with its own message. NULL turns come first.
    Conversations are cut by turn numbers into segments first. A segment's requests meet the segments before it, each a
    list made once, so a long conversation is spread over many groups; no group holds more than the messages of its longest request.
    """
    message = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    segments = materialize(
        turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.floor(F.col(turn_col) / segment), F.lit(-(1 << 62))).alias("part"), message.alias("m"))
        .groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("own")))
    earlier = segments.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("own").alias("_own"))
    asking = segments.where(F.exists("own", lambda m: m["role"] == "user"))
    before = (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("_part") < F.col("part"))
    met = asking.select("conv_id", "part").join(earlier, before).groupBy("conv_id", "part").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_own"))), lambda x: x["_own"])).alias("before"))
    met = met.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "before")
    joined = asking.join(met, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    each = joined.select("conv_id", "own", "before", F.posexplode("own").alias("at", "last")).where("last.role = 'user'")
    whole = F.concat(F.coalesce("before", F.array().cast(each.schema["own"].dataType)), F.slice("own", F.lit(1), F.col("at") + 1))
    return each.select(
        "conv_id", F.col("last.turn").alias("turn"),
        F.transform(whole, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def route_conversations(requests: DataFrame, index: DataFrame, factory: Callable[..., object],
                        lexical: LexicalIndex | None = None, reranker: PipelineModel | None = None,
                        config: AnswerConfig = AnswerConfig(), max_retries: int = 1, retry_interval: float = 60.0,
                        chat_factory: Callable[..., object] | None = None, **options: object) -> DataFrame:
    """Answer single-message requests from the index and follow-ups straight from the model.

    `requests` holds conv_id, messages (role, content), and turn where a conversation has several requests (of which one at
    most has a single message). Result: conv_id, turn if given, question, sources, document_ids, answer, llm, error. Follow-ups, and
    requests without messages, have no sources or ids. The model of `chat_factory` gets their messages with the roles; without it
    that of `factory` gets their contents joined by blanks.
    """
    key = [c for c in ("conv_id", "turn") if c in requests.columns]
    first_content = F.get("messages", F.lit(0))["content"]
    single = F.coalesce(F.size("messages") == 1, F.lit(False))
    first = requests.filter(single).select(F.col("conv_id").alias("qid"), *key[1:], first_content.alias("query"))
    fresh = answer_questions(first.select("qid", "query"), index, factory, lexical, reranker, config, **options)
    if key[1:]:
        fresh = fresh.join(first.select("qid", "turn"), "qid")
    contents = F.col("messages") if chat_factory else F.array_join(F.transform("messages", lambda m: m["content"]), " ")
    later = requests.filter(~single).select(*key, first_content.alias("question"), contents.alias("prompt"))
    direct = send_request(later, chat_factory or factory, max_retries=max_retries, retry_interval=retry_interval, **options).select(
        *key, "question", F.array().cast("array<string>").alias("sources"),
        F.array().cast("array<bigint>").alias("document_ids"), "answer", F.lit(config.llm).alias("llm"), "error")
    return fresh.withColumnRenamed("qid", "conv_id").select(*direct.columns).unionByName(direct)
