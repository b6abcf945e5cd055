"""Every operator as a named query over the test tables. Each takes the session and the table folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.catalog.stubs import busy_model, chat_model, fingerprint_model, flaky_batch_model, length_judge, named_model, vowel_logits, vowel_model
from passagekit.functions.text import (
    count_tokens, extract_generated, format_chat_reply, format_reply, normalize_for_classifier, parse_judge_json,
    parse_judge_lines, split_camel_case, strip_mention, thread_of, trim_tokens,
)
from passagekit.functions.uris import DOMAIN, path_to_uri, tag_of, uri_anchor, uri_page
from passagekit.operators.chunking import chunk_text
from passagekit.operators.classify import (
    classifier_weights, classify_with_threshold, fit_router, fit_tag_classifier, label_with_threshold, route, score_with_weights,
    softmax_classify,
)
from passagekit.operators.embedding import check_dim, embed, hash_embed
from passagekit.operators.evaluation import align, alignment_problems, is_retrieved, judge_prompt, quality_score, retrieval_score
from passagekit.operators.fusion import attach_chunks, collect_context, rerank_by_tag, splice, truncate_hits
from passagekit.operators.generation import generate, send_request, token_cost
from passagekit.operators.cells import CellStore, knn_cells, write_cells
from passagekit.operators.knn import knn, knn_one
from passagekit.operators.lexical import LexicalIndex, bm25_index, bm25_scores, bm25_topk
from passagekit.operators.metrics import corpus_statistics, preview
from passagekit.operators.postings import PostingsIndex, postings_topk, write_postings
from passagekit.operators.prompts import build_prompt, context_budget
from passagekit.operators.sections import extract_sections, page_text, resolve_uris
from passagekit.plans.answering import (
    AnswerConfig, answer_questions, conversation_messages, conversation_requests, experiment_from_pages, question_contexts,
    route_conversations, run_experiment,
)
from passagekit.plans.evaluating import evaluate
from passagekit.plans.index_build import IndexConfig, build_and_write, build_index, chunk_documents
from passagekit.session import materialize, new_path, spread
from passagekit.sources.corpus import (
    grown_numbers, list_corpus, number_pages, only_new, read_html_corpus, read_references, read_responses, write_html_corpus,
)
from passagekit.sources.index_store import (
    create_index_table, insert_index, load_or_build_index, read_index, read_ranges, reset_index, snapshot_index, write_ranges,
)
from passagekit.sources.records import append_answer_log, evaluation_name
from passagekit.sources.refresh import refresh_index, stored_index
from passagekit.streaming.jobs import (
    answer_stream, index_stream, read_arrivals, read_page_stream, read_question_stream, refresh_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

DIM = 64
PAGE_CONFIG = IndexConfig(container="article", require_id=False, domain=None)
URL_TAG = r"^https?://[^/]+/([^/?#]+)"
SOURCE_TAG = "^(.+)$"
SYSTEM = "Answer the query using the context provided. Be succinct."
LLM = "meta-llama/Llama-2-70b-chat-hf"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def questions_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def chunks_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents taken as chunks: id, text, source."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def rounded(name: str, digits: int = 6) -> Column:
    """Rounded in binary as DuckDB does it; Spark's own `round` decides halves by the decimal text."""
    value, scale = F.col(name).cast("double"), float(10 ** digits)
    return (F.signum(value) * F.floor(F.abs(value) * scale + 0.5).cast("double") / scale + 0.0).alias(name)


# Nearest neighbours and embeddings

def knn_topk(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return knn(vectors, vectors, 5, "vec_id", "vec_id").select("qid", "pos", "id", rounded("distance"))


def knn_cells_query(spark, folder):
    """The same lists from vectors that are stored by cells."""
    vectors, path = spark.read.parquet(f"{folder}/embeddings.parquet"), new_path(spark, "cells")
    write_cells(vectors, path, id_col="vec_id")
    return knn_cells(vectors, CellStore.load(spark, path), 5, "vec_id").select("qid", "pos", "id", rounded("distance"))


def knn_centroid(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    parts = vectors.select(F.posexplode("embedding").alias("at", "v"))
    means = parts.groupBy("at").agg(F.avg(F.col("v").cast("double")).alias("mean")).orderBy("at")
    return knn_one([r["mean"] for r in means.collect()], vectors, 10, "vec_id").select("id", rounded("distance"))


def hash_embed_weights(spark, folder):
    rows = hash_embed(table(spark, folder, "documents").select("doc_id", "text"), "text", DIM)
    cells = rows.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter("w <> 0")
    return cells.select("doc_id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"))


def embed_user_model(spark, folder):
    rows = embed(table(spark, folder, "documents").select("doc_id", "text"), "text", vowel_model, 5)
    return rows.select("doc_id", *(F.get("embedding", F.lit(i)).cast("double").alias(v) for i, v in enumerate("aeiou")))


def embedding_sizes(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    checked = vectors.select("label", check_dim(F.col("embedding"), DIM).alias("embedding"))
    return checked.groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("vectors"))


def hash_knn(spark, folder):
    index = hash_embed(chunks_of_documents(spark, folder), "text", DIM)
    asked = hash_embed(questions_of(spark, folder), "query", DIM)
    return knn(asked, index, 5).select("qid", "pos", "id", rounded("distance", 5))


# Lexical retrieval

def _lexical(spark, folder) -> LexicalIndex:
    return bm25_index(chunks_of_documents(spark, folder))


def bm25_terms(spark, folder):
    return _lexical(spark, folder).terms.select("term", "df", rounded("idf"))


def bm25_stats(spark, folder):
    return _lexical(spark, folder).stats.select("n", rounded("avgdl"), rounded("mean_idf"))


def bm25_postings(spark, folder):
    return _lexical(spark, folder).postings().groupBy("term").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


def bm25_all_scores(spark, folder):
    return bm25_scores(questions_of(spark, folder), _lexical(spark, folder)).select("qid", "id", rounded("score"))


def bm25_top3(spark, folder):
    hits = bm25_topk(questions_of(spark, folder), _lexical(spark, folder), 3)
    return hits.select("qid", "pos", "id", rounded("score"))


def bm25_fill(spark, folder):
    """One-word questions: the longest word of each item, which few or no documents hold."""
    word = F.expr("array_max(transform(split(lower(query), '[^a-z0-9]+'), w -> struct(length(w) AS n, w AS w))).w")
    asked = questions_of(spark, folder).select("qid", word.alias("query"))
    return bm25_topk(asked, _lexical(spark, folder), 5).select("qid", "pos", "id", rounded("score"))


def bm25_saved_index(spark, folder):
    """The same top 3 from an index that was written and read back."""
    path = new_path(spark, "lexical")
    _lexical(spark, folder).save(path)
    hits = bm25_topk(questions_of(spark, folder), LexicalIndex.load(spark, path), 3)
    return hits.select("qid", "pos", "id", rounded("score"))


def bm25_blocks(spark, folder):
    """The same top 3 from postings by term, read by folders and parts."""
    path = new_path(spark, "postings")
    write_postings(_lexical(spark, folder), path)
    hits = postings_topk(questions_of(spark, folder), PostingsIndex.load(spark, path), 3)
    return hits.select("qid", "pos", "id", rounded("score"))


# Merging and re-ranking

def _both_lists(spark, folder, k_semantic=5, k_lexical=2):
    documents, asked = chunks_of_documents(spark, folder), questions_of(spark, folder)
    semantic = knn(hash_embed(asked, "query", DIM), hash_embed(documents, "text", DIM), k_semantic)
    return semantic, bm25_topk(asked, bm25_index(documents), k_lexical)


def hybrid_splice(spark, folder):
    return splice(*_both_lists(spark, folder), 2).select("qid", "pos", "id", rounded("score"))


def hybrid_splice_dedup(spark, folder):
    return splice(*_both_lists(spark, folder), 2, dedup=True).select("qid", "pos", "id")


def _reranked(spark, folder, documents=None):
    """The tag of the best lexical hit plays the predicted tag."""
    semantic, lexical = _both_lists(spark, folder)
    lexical = materialize(lexical)  # used twice; k rows per question
    documents = chunks_of_documents(spark, folder) if documents is None else documents
    n = questions_of(spark, folder).count()
    hits = attach_chunks(splice(semantic, lexical, 2), documents, n * 7)
    best = lexical.filter("pos = 0").select("qid", "id")
    tags = attach_chunks(best, documents, n).select("qid", F.col("source").alias("predicted"))
    return truncate_hits(rerank_by_tag(hits.join(tags, "qid", "left"), pattern=SOURCE_TAG), 4)


def rerank_by_source(spark, folder):
    return _reranked(spark, folder).select("qid", "pos", "id", "source")


def context_lists(spark, folder):
    return _context_columns(_reranked(spark, folder))


def context_ranges(spark, folder):
    """The same contexts with their texts looked up in an index that lies by ranges of ids."""
    path = new_path(spark, "ranges")
    write_ranges(chunks_of_documents(spark, folder), path, 6)
    return _context_columns(_reranked(spark, folder, read_ranges(spark, path)))


def _context_columns(hits: DataFrame) -> DataFrame:
    rows = collect_context(hits)
    return rows.select(
        "qid", F.array_join(F.transform("document_ids", lambda i: i.cast("string")), ",").alias("ids"),
        F.array_join("sources", ",").alias("sources"), F.length(F.array_join("texts", "")).alias("chars"))


# Sections, chunks, URIs

def sections_article(spark, folder):
    return extract_sections(table(spark, folder, "pages"), "article", False, domain=None)


def sections_default_empty(spark, folder):
    return extract_sections(table(spark, folder, "pages"))


def chunk_documents_query(spark, folder):
    return chunk_text(table(spark, folder, "documents").select("doc_id", "text"))


def chunk_serving(spark, folder):
    return chunk_text(table(spark, folder, "documents").select("doc_id", "text"), 700, 50).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def chunk_invariants(spark, folder):
    """Violations of what chunks promise; every count but `documents` must be 0."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    chunks = chunk_text(documents.withColumn("whole", F.col("text")))
    text = F.col("text")
    bad = chunks.agg(
        F.count_if(F.length(text) > 300).alias("too_long"),
        F.count_if(F.length(text) == 0).alias("empty"),
        F.count_if(text != F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).alias("unstripped"),
        F.count_if(~F.contains("whole", text)).alias("foreign"),
        F.count_distinct("doc_id").alias("documents"),
    )
    return bad


def uri_rewrite(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return pages.select(
        "page_id", path_to_uri(F.col("url"), "https://", "example.com").alias("uri"), uri_page(F.col("url")).alias("page"),
        uri_anchor(F.col("url")).alias("anchor"), tag_of(F.col("url"), URL_TAG).alias("tag"))


def page_texts(spark, folder):
    return page_text(table(spark, folder, "pages").select("page_id", "html")).select("page_id", "text")


def resolve_uris_query(spark, folder):
    """Every page asked for twice: as it is listed, and at an anchor it does not have."""
    pages = table(spark, folder, "pages").withColumn("url", uri_page(F.col("url"))).select("url", "html")
    pages = pages.groupBy("url").agg(F.min("html").alias("html"))
    listed = table(spark, folder, "pages").select("page_id", "url")
    asked = listed.select("page_id", "url").union(listed.select("page_id", F.concat(uri_page(F.col("url")), F.lit("#no-such-id"))))
    return resolve_uris(asked.toDF("page_id", "uri"), pages).select("page_id", "uri", "text")


def incremental_new(spark, folder):
    """English pages count as indexed; the rest is new."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    indexed = pages.filter(tag_of(F.col("url"), URL_TAG) == "en").select(F.concat("url", F.lit("#s")).alias("source"))
    return only_new(pages, indexed, "url", F.substring_index("source", "#s", 1)).select("page_id", "url")


def numbered_pages(spark, folder):
    return number_pages(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"), "url", "number")


def source_statistics(spark, folder):
    return corpus_statistics(table(spark, folder, "documents").select("source", "text"))


# Index build

def _index_columns(index: DataFrame) -> DataFrame:
    used = F.size(F.filter("embedding", lambda v: v != 0)).alias("buckets")
    return index.select("id", "text", "source", used, F.round(F.array_max("embedding").cast("double"), 5).alias("peak"))


def index_build(spark, folder):
    return _index_columns(build_index(table(spark, folder, "pages"), PAGE_CONFIG))


def index_written(spark, folder):
    """Written in one job, copied to a snapshot and read back."""
    path, snapshot = new_path(spark, "index"), new_path(spark, "snapshot")
    build_and_write(table(spark, folder, "pages"), path, PAGE_CONFIG)
    snapshot_index(spark, path, snapshot)
    return _index_columns(read_index(spark, snapshot, "id", "text", "source", "embedding"))


def index_loaded(spark, folder):
    """Built at the first call, loaded at the second."""
    root = new_path(spark, "snapshots")

    def build():
        return build_index(table(spark, folder, "pages"), PAGE_CONFIG)

    load_or_build_index(spark, root, "hash-64", DIM, 300, 50, build)
    return _index_columns(load_or_build_index(spark, root, "hash-64", DIM, 300, 50, build))


def index_stream_query(spark, folder):
    path = new_path(spark, "streamed")
    query = index_stream(read_page_stream(spark, f"{folder}/pages*.parquet"), f"{path}/index", f"{path}/state", PAGE_CONFIG)
    query.awaitTermination()
    return _index_columns(read_index(spark, f"{path}/index", "id", "text", "source", "embedding"))


REFRESH_CONFIG = replace(PAGE_CONFIG, model="hash-16")


def _earlier_pages(spark, folder):
    """The pages before a refresh: French ones are missing, German ones read otherwise, Spanish ones have copies that will go."""
    pages = table(spark, folder, "pages").withColumn("tag", F.coalesce(tag_of(F.col("url"), URL_TAG), F.lit("")))
    old = F.when(F.col("tag") == "de", F.concat(F.lit("<article><p>old</p></article>"), "html")).otherwise(F.col("html"))
    copies = pages.where("tag = 'es'").withColumn("page_id", F.col("page_id") + 10_000_000)
    return pages.where("tag <> 'fr'").withColumn("html", old).unionByName(copies).select("page_id", "url", "html")


def _index_with_status(index: DataFrame, changes: DataFrame) -> DataFrame:
    rows = index.select(F.shiftright("id", 28).alias("page_id"), "id", "text", "source")
    return changes.join(rows, "page_id", "left").select("page_id", "status", "id", "text", "source")


def incremental_refresh(spark, folder):
    """An index brought up to date: each page's status, and the chunks that the index has of it afterwards."""
    path = new_path(spark, "store")
    refresh_index(_earlier_pages(spark, folder), path, REFRESH_CONFIG, 6)
    changes = refresh_index(table(spark, folder, "pages"), path, REFRESH_CONFIG, 6)
    return _index_with_status(stored_index(spark, path), changes)


def index_stream_repeats(spark, folder):
    """Pages that arrive three times, the last time as they are now: the store holds every page once."""
    path = new_path(spark, "arrivals")
    for pages in (_earlier_pages(spark, folder), _earlier_pages(spark, folder), table(spark, folder, "pages")):
        pages.select("page_id", "url", "html").write.mode("append").parquet(f"{path}/pages")
        arrivals = read_arrivals(spark, f"{path}/pages")
        refresh_stream(arrivals, f"{path}/store", f"{path}/state", REFRESH_CONFIG, page_bits=6).awaitTermination()
    return stored_index(spark, f"{path}/store").select("id", "text", "source")


def numbered_files(spark, folder):
    """Pages written as files in two steps; the first ones keep their numbers when the others come."""
    path = new_path(spark, "files")
    pages = table(spark, folder, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    early = F.col("url").contains("/en/")
    named = pages.select("page_id", F.format_string("%08d", "page_id").alias("name"), early.alias("early"))
    first = grown_numbers(named.where("early").select("name"), f"{path}/numbers")
    first.write.parquet(f"{path}/first")
    last = grown_numbers(named.select("name"), f"{path}/numbers")
    before = spark.read.parquet(f"{path}/first").withColumnRenamed("page_id", "first_number")
    return last.join(before, "name", "left").select("name", F.col("page_id").alias("number"), "first_number")


def html_files(spark, folder):
    """Pages written as files, listed without opening them, and read back."""
    path = new_path(spark, "html")
    write_html_corpus(table(spark, folder, "pages"), path)
    number = lambda c: F.regexp_extract(c, "page_id=([0-9]+)", 1).cast("long")
    listed = list_corpus(spark, path, "*.txt").select(number(F.col("path")).alias("page_id"))
    read = read_html_corpus(spark, path, "*.txt").select(number(F.col("source")).alias("page_id"), F.md5("text").alias("content"))
    return listed.join(read, "page_id")


def index_table(spark, folder):
    """A catalog table, created once, filled by two inserts."""
    name, path = f"document_{uuid4().hex}", new_path(spark, "table")
    for _ in range(2):
        create_index_table(spark, name, path)
    index = build_index(table(spark, folder, "pages"), PAGE_CONFIG)
    english = F.col("source").contains("/en/")
    insert_index(index.where(english), name, DIM)
    insert_index(index.where(~english), name, DIM)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return _index_columns(read_index(spark, path, "id", "text", "source", "embedding"))


def index_reset(spark, folder):
    """An index that was emptied and filled anew holds nothing of before."""
    path = new_path(spark, "index")
    build_and_write(_earlier_pages(spark, folder), path, PAGE_CONFIG)
    reset_index(spark, path)
    build_and_write(table(spark, folder, "pages"), path, PAGE_CONFIG)
    return _index_columns(read_index(spark, path, "id", "text", "source", "embedding"))


def stage_counts(spark, folder):
    """The rows of every stage of an index build, counted while it is written."""
    report = build_and_write(table(spark, folder, "pages"), new_path(spark, "index"), PAGE_CONFIG)
    return spark.range(1).select(*(F.lit(int(report[stage])).cast("long").alias(stage) for stage in ("pages", "sections", "chunks")))


def first_chunks(spark, folder):
    """A preview of the documents with the highest numbers."""
    return preview(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.md5("text").alias("content")).orderBy(F.desc("doc_id")), 20)


def references_read(spark, folder):
    """References from one JSON array and from JSON lines: the same rows."""
    path = new_path(spark, "references")
    rows = questions_of(spark, folder).select("qid", F.col("query").alias("question"), F.md5("query").alias("answer"), F.concat(F.lit("s#"), "qid").alias("source"))
    rows.write.json(f"{path}/lines")
    whole = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("qid", "question", "answer", "source"))), lambda r: F.struct(r["question"], r["answer"], r["source"])))
    rows.agg(whole.alias("value")).coalesce(1).write.text(f"{path}/array.json")
    both = read_references(spark, f"{path}/lines").select("*", F.lit("lines").alias("form")).unionByName(
        read_references(spark, f"{path}/array.json").select("*", F.lit("array").alias("form")))
    return both.select("form", "qid", F.md5("question").alias("question"), "answer", "source")


def sent_requests(spark, folder):
    """A service that is busy for some texts: one repeat, then an empty answer and its error."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    return send_request(rows, busy_model, retry_interval=0.0).select("doc_id", "answer", "error")


def document_index(spark, folder):
    """Chunks of the documents with their ids."""
    return chunk_documents(table(spark, folder, "documents"))


# Texts and prompts

def token_counts(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select(
        "doc_id", count_tokens(F.col("text")).alias("tokens"), F.md5(trim_tokens(F.col("text"), 100)).alias("first_hundred"))


def token_budget(spark, folder):
    """The budget of every turn of a conversation, its first turn being the system text and the speaker choosing the model."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    first = turns.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("system"))
    rows = turns.select("conv_id", "turn", F.when(F.col("role") == "user", LLM).otherwise("gpt-4").alias("llm"))
    budgets = context_budget(rows.join(first, "conv_id"), "llm", F.col("system"), share=0.125)
    return budgets.select("conv_id", "turn", "llm", "input_budget", "output_budget", "over_budget")


def prompt_rows(spark, folder):
    """A prompt from every document as the only context of its language's name as question."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("query"), F.array("text").alias("texts"))
    prompts = build_prompt(rows.withColumn("input_budget", F.lit(150)), system=SYSTEM)
    return prompts.select("doc_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5"))


def normalize_text(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(normalize_for_classifier(text)).alias("normal"), F.md5(split_camel_case(text)).alias("camel"))


def reply_texts(spark, folder):
    documents = table(spark, folder, "documents")
    sources = F.when(F.col("lang") == "en", F.array()).otherwise(F.array("source", "lang"))
    return documents.select(
        "doc_id", F.md5(format_reply(F.col("text"), sources)).alias("reply"),
        F.md5(format_chat_reply(F.col("text"), sources)).alias("chat"),
        F.md5(strip_mention(F.col("text"))).alias("mention"),
        thread_of(F.when(F.col("lang") == "en", "").otherwise(F.col("source")), F.col("lang")).alias("thread"))


def generator_outputs(spark, folder):
    rows = spark.read.parquet(f"{folder}/labels.parquet")
    known = F.to_json(F.struct(F.concat(F.lit("answer "), F.col("quality")).alias("generated_text")))
    raw = F.when(F.col("toxic") == 0, known).otherwise(F.to_json(F.struct("quality")))
    return rows.select("doc_id", extract_generated(raw).alias("answer"))


# Classifiers and routing

def _labelled(spark, folder):
    documents, labels = table(spark, folder, "documents"), spark.read.parquet(f"{folder}/labels.parquet")
    return documents.select("doc_id", "text").join(labels, "doc_id")


def tag_classifier(spark, folder):
    model = fit_tag_classifier(_labelled(spark, folder), "text", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return classify_with_threshold(documents, model, "text", 0.7).select("doc_id", "predicted")


def route_model_query(spark, folder):
    router = fit_router(_labelled(spark, folder), "text", "quality")
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    return route(turns.select("conv_id", "turn", "text"), router, LLM, "gpt-4", "text").select("conv_id", "turn", "llm")


def _saved_classifier(spark, training: DataFrame, label: str) -> PipelineModel:
    """Trained, written by the model writer and loaded again."""
    path = new_path(spark, "classifier")
    fit_tag_classifier(training, "text", label, algorithm="bayes").write().save(path)
    return PipelineModel.load(path)


def tag_probabilities(spark, folder):
    """The label and the probability of label 1 of every document, by a loaded model."""
    model = _saved_classifier(spark, _labelled(spark, folder), "quality")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = classify_with_threshold(documents, model, "text", 0.7, probabilities="chances")
    return rows.select("doc_id", "predicted", F.round(F.get("chances", F.lit(1)), 5).alias("probability"))


def tag_weights(spark, folder):
    """The same by joins with the weights of the loaded model."""
    model = _saved_classifier(spark, _labelled(spark, folder), "quality")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = score_with_weights(documents, classifier_weights(model), "doc_id", "text")
    label = label_with_threshold(F.col("probabilities"), ["0", "1"], 0.7)
    return rows.select("doc_id", label.alias("predicted"), F.round(F.get("probabilities", F.lit(1)), 5).alias("probability"))


def routed_by_model(spark, folder):
    """Every user turn and the model that a trained and loaded router sends it to."""
    router = _saved_classifier(spark, _labelled(spark, folder), "quality")
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    return route(turns.select("conv_id", "turn", "text"), router, LLM, "gpt-4", "text").select("conv_id", "turn", "llm")


def reranked_answers(spark, folder):
    """Answers whose hits are re-ranked by a classifier of sources, trained on the documents and loaded."""
    documents = table(spark, folder, "documents")
    reranker = _saved_classifier(spark, documents.select("text", "source"), "source")
    index, lexical = _index_and_lexical(spark, folder)
    config = replace(ANSWER_CONFIG, use_reranking=True, rerank_threshold=0.5, rerank_k=4)
    return _answer_columns(answer_questions(questions_of(spark, folder), index, fingerprint_model, lexical, reranker, config))


def softmax_labels(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    rows = softmax_classify(documents, "text", vowel_logits, ["a", "e"], threshold=0.6)
    return rows.select("doc_id", "predicted", F.round(F.array_max("probabilities"), 6).alias("probability"))


def conversation_routes(spark, folder):
    requests = conversation_requests(table(spark, folder, "conversations"))
    return requests.select("conv_id", "turn", "query", "retrieves")


def conversation_prefixes(spark, folder):
    """The messages of every request of a conversation."""
    requests = conversation_messages(table(spark, folder, "conversations"))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return requests.select("conv_id", "turn", F.size("messages").alias("messages"), F.md5(lines).alias("whole"))


def routed_conversations(spark, folder):
    """First questions answered from the documents, follow-ups by a chat model that sees all messages and roles."""
    index = hash_embed(chunks_of_documents(spark, folder), "text", DIM)
    config = replace(ANSWER_CONFIG, num_chunks=2, use_lexical_search=False)
    requests = conversation_messages(table(spark, folder, "conversations"))
    rows = route_conversations(requests, index, fingerprint_model, config=config, chat_factory=chat_model)
    ids = F.array_join(F.transform("document_ids", lambda i: i.cast("string")), ",").alias("ids")
    return rows.select("conv_id", "turn", ids, F.array_join("sources", ",").alias("sources"), "answer")


def conversation_cost(spark, folder):
    """Long conversations on the strong model; user and system texts are prompts, answers are sampled."""
    turns = table(spark, folder, "conversations")
    used = turns.withColumn("tokens", count_tokens(F.col("text")))
    sampled = F.col("role") == "assistant"
    usage = used.select(
        F.when(F.col("turn") >= 4, "gpt-4").otherwise(LLM).alias("llm"),
        F.when(~sampled, F.col("tokens")).otherwise(0).alias("prompt_tokens"),
        F.when(sampled, F.col("tokens")).otherwise(0).alias("sampled_tokens"))
    return token_cost(usage).select("llm", "prompt_tokens", "sampled_tokens", rounded("cost"))


# Answering and evaluation

ANSWER_CONFIG = AnswerConfig(lexical_search_k=2, tag_pattern=SOURCE_TAG, system_content=SYSTEM, llm=LLM)


def _index_and_lexical(spark, folder):
    documents = chunks_of_documents(spark, folder)
    return hash_embed(documents, "text", DIM), bm25_index(documents)


def _answer_columns(answers: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("document_ids", lambda i: i.cast("string")), ",").alias("ids")
    return answers.select("qid", ids, F.array_join("sources", ",").alias("sources"), "answer", "llm")


def hybrid_contexts(spark, folder):
    index, lexical = _index_and_lexical(spark, folder)
    rows = question_contexts(questions_of(spark, folder), index, lexical, config=ANSWER_CONFIG)
    return rows.select(
        "qid", F.array_join(F.transform("document_ids", lambda i: i.cast("string")), ",").alias("ids"),
        F.array_join("sources", ",").alias("sources"))


def answer_questions_query(spark, folder):
    index, lexical = _index_and_lexical(spark, folder)
    return _answer_columns(answer_questions(questions_of(spark, folder), index, fingerprint_model, lexical, config=ANSWER_CONFIG))


def routed_answers(spark, folder):
    """Every other question goes to another model, which is called by its name and with its own share of tokens."""
    index, lexical = _index_and_lexical(spark, folder)
    llm = F.when(F.col("qid") % 2 == 0, LLM).otherwise("gpt-4")
    asked = questions_of(spark, folder).withColumn("llm", llm)
    models = {LLM: named_model, "gpt-4": named_model}
    return _answer_columns(answer_questions(asked, index, models, lexical, config=ANSWER_CONFIG))


def answers_short_context(spark, folder):
    """A context length that the configuration gives goes before that of the model."""
    index, lexical = _index_and_lexical(spark, folder)
    config = replace(ANSWER_CONFIG, max_context_length=400)
    return _answer_columns(answer_questions(questions_of(spark, folder), index, fingerprint_model, lexical, config=config))


def bad_markup(spark, folder):
    """Pages with markup that parsers give up on in front of them: the whole page is still read, and the damage is reported."""
    bad = F.element_at(F.array(*map(F.lit, ("<![foo]>", "<![ >", "&#" + "5" * 5000 + ";", "&#xD800;"))), (F.col("page_id") % 4 + 1).cast("int"))
    pages = table(spark, folder, "pages").select("page_id", "url", F.concat(
        F.lit("<section id='a'>x "), bad, F.lit("<div>"), "html", F.lit("</div></section><section id='b'>"), F.col("url"), F.lit("</section>")).alias("html"))
    return extract_sections(pages, domain=None, damaged="damaged").select("page_id", "section_pos", "source", "text", "damaged")


def _nested_pages(spark, folder):
    """Each page as an inner section, within an outer one and beside one without an id."""
    page = F.col("page_id").cast("string")
    html = F.concat(F.lit("<section id='o"), page, F.lit("'><p>one "), page, F.lit("</p> mid <section id='i'><div>"), F.col("html"),
                    F.lit("</div></section><p>tail</p></section><section><p>none</p></section>"))
    path = F.concat(F.lit(f"data/{DOMAIN}/p/"), page, F.lit(".html"))
    return table(spark, folder, "pages").select("page_id", path.alias("url"), html.alias("html"))


def sections_nested(spark, folder):
    """Sections by default: own text only, without those that have no id."""
    return extract_sections(_nested_pages(spark, folder))


def resolve_anchors(spark, folder):
    """What anchors point to: an outer and an inner element, one that is missing, and none."""
    pages = _nested_pages(spark, folder)
    ends = F.array(F.concat(F.lit("#o"), F.col("page_id").cast("string")), F.lit("#i"), F.lit("#missing"), F.lit(""))
    uris = pages.select("page_id", F.explode(F.transform(ends, lambda e: F.concat("url", e))).alias("uri"))
    return resolve_uris(uris, pages.select("url", "html"))


def experiment_from_pages_query(spark, folder):
    """The whole experiment over the pages, run twice: the second run loads what the first one built."""
    root = new_path(spark, "experiment")
    references = f"{root}/references.json"
    rows = questions_of(spark, folder).select(F.struct("qid", F.col("query").alias("question"), F.lit("").alias("answer"), F.lit("").alias("source")).alias("r"))
    rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(r["question"], r["answer"], r["source"]))).alias("value")).coalesce(
        1).write.text(references)
    for name in ("first", "second"):
        target = experiment_from_pages(name, table(spark, folder, "pages"), references, root, fingerprint_model, PAGE_CONFIG, ANSWER_CONFIG)
    return _answer_columns(read_responses(spark, f"{target}/results"))


def experiment_record(spark, folder):
    """Answers written with their configuration and read back as responses."""
    index, lexical = _index_and_lexical(spark, folder)
    target = run_experiment("hybrid", questions_of(spark, folder), index, fingerprint_model, new_path(spark, "responses"),
                            lexical, config=ANSWER_CONFIG)
    return _answer_columns(read_responses(spark, f"{target}/results"))


def answer_stream_query(spark, folder):
    index, lexical = _index_and_lexical(spark, folder)
    path = new_path(spark, "asked")
    questions_of(spark, folder).write.parquet(f"{path}/questions")
    stream = read_question_stream(spark, f"{path}/questions")
    answer_stream(stream, index, fingerprint_model, f"{path}/answers", f"{path}/state", lexical, config=ANSWER_CONFIG).awaitTermination()
    logged = spark.read.schema(
        "qid long, sources array<string>, document_ids array<long>, answer string, llm string").json(f"{path}/answers")
    return _answer_columns(logged)


def answer_log(spark, folder):
    """Every answered question appended to the log, then counted by model."""
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("question"), F.array("doc_id").alias("document_ids"), F.col("source").alias("llm"), F.md5("text").alias("answer"))
    path = new_path(spark, "log")
    append_answer_log(rows, path)
    append_answer_log(rows, path)
    logged = spark.read.schema("ts timestamp, event string, query string, document_ids array<long>, llm string, answer string").json(path)
    return logged.groupBy("event", "llm").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(F.get("document_ids", F.lit(0))).alias("documents"),
        F.count_if(F.col("ts").isNull()).alias("unstamped"))


def _references(spark, folder):
    """The nearest document's source is the reference page of each question."""
    documents, asked = chunks_of_documents(spark, folder), questions_of(spark, folder)
    nearest = knn(hash_embed(asked, "query", DIM), hash_embed(documents, "text", DIM), 1).select("qid", "id")
    found = attach_chunks(nearest, documents, asked.count())
    return asked.join(found, "qid").select("qid", F.col("query").alias("question"), F.col("text").alias("answer"), "source")


def _responses(spark, folder):
    """The lexical top 3 as the sources of each answer."""
    documents, asked = chunks_of_documents(spark, folder), questions_of(spark, folder)
    hits = attach_chunks(bm25_topk(asked, bm25_index(documents), 3), documents, asked.count() * 3)
    return asked.join(collect_context(hits), "qid").select(
        "qid", F.col("query").alias("question"), "sources", "document_ids", F.element_at("sources", 1).alias("answer"))


def retrieval_score_query(spark, folder):
    return retrieval_score(align(_references(spark, folder), _responses(spark, folder))).select(rounded("retrieval_score"))


def retrieval_hits(spark, folder):
    pairs = align(_references(spark, folder), _responses(spark, folder))
    return pairs.select("qid", is_retrieved(F.col("reference_source"), F.col("sources")).cast("int").alias("found"))


def alignment_check(spark, folder):
    """Items against labels that share their number: how many pair up and agree."""
    left = questions_of(spark, folder).select("qid", F.col("query").alias("question"))
    right = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    return alignment_problems(left, right)


def judged_answers(spark, folder):
    results, _ = evaluate(_references(spark, folder), _responses(spark, folder), length_judge, "hybrid", "owner/Length-Judge",
                          new_path(spark, "evaluations"))
    return results.select("qid", "score", "reasoning", "score_error")


def judged_scores(spark, folder):
    _, scores = evaluate(_references(spark, folder), _responses(spark, folder), length_judge, "hybrid", "owner/Length-Judge")
    return scores.select(rounded("retrieval_score"), rounded("quality_score"))


def evaluation_written(spark, folder):
    """An evaluation as its files hold it: every judged answer beside both scores."""
    path = new_path(spark, "evaluations")
    evaluate(_references(spark, folder), _responses(spark, folder), length_judge, "hybrid", "owner/Length-Judge", path)
    target = f"{path}/{evaluation_name('hybrid', 'owner/Length-Judge')}"
    results = spark.read.schema("qid long, score double, reasoning string").json(f"{target}/results")
    scores = spark.read.schema("config struct<evaluator:string>, retrieval_score double, quality_score double").json(f"{target}/summary")
    return results.join(F.broadcast(scores)).select(
        "qid", "score", "reasoning", F.col("config.evaluator").alias("evaluator"), rounded("retrieval_score"), rounded("quality_score"))


def judge_lines(spark, folder):
    rows = spark.read.parquet(f"{folder}/labels.parquet")
    reply = F.when(F.col("toxic") == 1, F.lit("no score")).otherwise(
        F.concat(F.when(F.col("quality") == 1, F.lit("4.5")).otherwise("n/a"), F.lit("\n\nbecause of "), F.col("doc_id")))
    return rows.select("doc_id", parse_judge_lines(reply).alias("p")).select("doc_id", "p.score", "p.reasoning", "p.error")


def judge_json(spark, folder):
    rows = spark.read.parquet(f"{folder}/labels.parquet")
    full = F.concat(F.lit('{"answer": "a'), F.col("doc_id"), F.lit('", "score": '), F.col("quality"), F.lit('.7, "reasoning": "r"}'))
    part = F.concat(F.lit('{"answer": "a", "score": '), F.col("quality"), F.lit("}"))
    reply = F.when(F.col("toxic") == 0, full).otherwise(part)
    return rows.select("doc_id", parse_judge_json(reply).alias("p")).select("doc_id", "p.answer", "p.score", "p.reasoning")


def quality_score_query(spark, folder):
    rows = _labelled(spark, folder)
    results = rows.select(
        (F.col("quality") * (1 + F.length("text") % 5)).cast("double").alias("score"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("text")).alias("reference_answer"))
    return quality_score(results).select(rounded("quality_score"))


def judge_prompts(spark, folder):
    rows = judge_prompt(align(_references(spark, folder), _responses(spark, folder)), max_context=60)
    return rows.select("qid", F.md5("prompt").alias("prompt"))


def generated_answers(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generate(rows, fingerprint_model).select("doc_id", "answer", "error")


def generated_batches(spark, folder):
    """The same answers from a model of lists whose rows all fail once."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generate(rows, flaky_batch_model, max_retries=2, retry_interval=0.0, batch_size=64).select("doc_id", "answer", "error")


QUERIES: dict[str, Query] = {
    "knn_topk": knn_topk,
    "knn_cells": knn_cells_query,
    "knn_centroid": knn_centroid,
    "hash_embed_weights": hash_embed_weights,
    "embed_user_model": embed_user_model,
    "embedding_sizes": embedding_sizes,
    "hash_knn": hash_knn,
    "bm25_terms": bm25_terms,
    "bm25_stats": bm25_stats,
    "bm25_postings": bm25_postings,
    "bm25_scores": bm25_all_scores,
    "bm25_topk": bm25_top3,
    "bm25_fill": bm25_fill,
    "bm25_saved_index": bm25_saved_index,
    "bm25_blocks": bm25_blocks,
    "hybrid_splice": hybrid_splice,
    "hybrid_splice_dedup": hybrid_splice_dedup,
    "rerank_by_source": rerank_by_source,
    "context_lists": context_lists,
    "context_ranges": context_ranges,
    "sections_article": sections_article,
    "sections_default_empty": sections_default_empty,
    "chunk_documents": chunk_documents_query,
    "chunk_serving": chunk_serving,
    "chunk_invariants": chunk_invariants,
    "uri_rewrite": uri_rewrite,
    "page_texts": page_texts,
    "resolve_uris": resolve_uris_query,
    "incremental_new": incremental_new,
    "numbered_pages": numbered_pages,
    "source_statistics": source_statistics,
    "index_build": index_build,
    "index_written": index_written,
    "index_loaded": index_loaded,
    "index_stream": index_stream_query,
    "incremental_refresh": incremental_refresh,
    "index_stream_repeats": index_stream_repeats,
    "numbered_files": numbered_files,
    "html_files": html_files,
    "index_table": index_table,
    "index_reset": index_reset,
    "stage_counts": stage_counts,
    "first_chunks": first_chunks,
    "references_read": references_read,
    "sent_requests": sent_requests,
    "evaluation_written": evaluation_written,
    "experiment_from_pages": experiment_from_pages_query,
    "document_index": document_index,
    "token_counts": token_counts,
    "token_budget": token_budget,
    "prompt_rows": prompt_rows,
    "normalize_text": normalize_text,
    "reply_texts": reply_texts,
    "generator_outputs": generator_outputs,
    "tag_classifier": tag_classifier,
    "route_model": route_model_query,
    "tag_probabilities": tag_probabilities,
    "tag_weights": tag_weights,
    "routed_by_model": routed_by_model,
    "reranked_answers": reranked_answers,
    "softmax_labels": softmax_labels,
    "conversation_routes": conversation_routes,
    "conversation_prefixes": conversation_prefixes,
    "routed_conversations": routed_conversations,
    "conversation_cost": conversation_cost,
    "hybrid_contexts": hybrid_contexts,
    "answer_questions": answer_questions_query,
    "routed_answers": routed_answers,
    "answers_short_context": answers_short_context,
    "bad_markup": bad_markup,
    "sections_nested": sections_nested,
    "resolve_anchors": resolve_anchors,
    "experiment_record": experiment_record,
    "answer_stream": answer_stream_query,
    "answer_log": answer_log,
    "retrieval_score": retrieval_score_query,
    "retrieval_hits": retrieval_hits,
    "alignment_check": alignment_check,
    "judged_answers": judged_answers,
    "judged_scores": judged_scores,
    "judge_lines": judge_lines,
    "judge_json": judge_json,
    "quality_score": quality_score_query,
    "judge_prompts": judge_prompts,
    "generated_answers": generated_answers,
    "generated_batches": generated_batches,
}
