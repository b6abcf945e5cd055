"""Declared schemas and fixed lookup values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HTML_DOCUMENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
])

INDEX = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

QUESTIONS = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("query", T.StringType()),
])

REFERENCES = T.ArrayType(T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("source", T.StringType()),
]))

ANSWER = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("document_ids", T.ArrayType(T.LongType())),
    T.StructField("answer", T.StringType()),
    T.StructField("llm", T.StringType()),
])

# Embedding dimension per model.
EMBEDDING_DIMS = [
    ("thenlper/gte-base", 768),
    ("thenlper/gte-large", 1024),
    ("BAAI/bge-large-en", 1024),
    ("text-embedding-ada-002", 1536),
    ("gte-large-fine-tuned", 1024),
]

# Context length in tokens per model.
CONTEXT_LENGTHS = [
    ("gpt-4", 8192),
    ("gpt-3.5-turbo", 4096),
    ("gpt-3.5-turbo-16k", 16384),
    ("gpt-4-1106-preview", 128000),
    ("meta-llama/Llama-2-7b-chat-hf", 4096),
    ("meta-llama/Llama-2-13b-chat-hf", 4096),
    ("meta-llama/Llama-2-70b-chat-hf", 4096),
    ("meta-llama/Llama-3-8b-chat-hf", 8192),
    ("meta-llama/Llama-3-70b-chat-hf", 8192),
    ("codellama/CodeLlama-34b-Instruct-hf", 16384),
    ("mistralai/Mistral-7B-Instruct-v0.1", 65536),
    ("mistralai/Mixtral-8x7B-Instruct-v0.1", 32768),
    ("mistralai/Mixtral-8x22B-Instruct-v0.1", 65536),
    ("meta-llama/Llama-3.2-3B-Instruct", 1024),
]

# Price in dollars per million tokens (model, prompt, sampled).
PRICES = [
    ("gpt-3.5-turbo", 1.5, 2.0),
    ("gpt-4", 30.0, 60.0),
    ("gpt-4-1106-preview", 10.0, 30.0),
    ("llama-2-7b-chat-hf", 0.15, 0.15),
    ("llama-2-13b-chat-hf", 0.25, 0.25),
    ("llama-2-70b-chat-hf", 1.0, 1.0),
    ("llama-3-8b-chat-hf", 0.15, 0.15),
    ("llama-3-70b-chat-hf", 1.0, 1.0),
    ("codellama-34b-instruct-hf", 1.0, 1.0),
    ("mistral-7b-instruct-v0.1", 0.15, 0.15),
    ("mixtral-8x7b-instruct-v0.1", 0.5, 0.5),
    ("mixtral-8x22b-instruct-v0.1", 0.9, 0.9),
]

# Defaults of the indexing and answering jobs.
CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
NUM_CHUNKS = 5
LEXICAL_K = 1
RERANK_THRESHOLD = 0.2
RERANK_K = 7
EMBED_BATCH = 100
MAX_CONTEXT = 4096


def _fixed_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A constant table inside the plan: no Python rows, no job, and a known small size."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS fixed({columns})")


def embedding_dims(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, EMBEDDING_DIMS, "model, dim")


def context_lengths(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, CONTEXT_LENGTHS, "model, max_context")


def prices(spark: SparkSession) -> DataFrame:
    return _fixed_table(spark, PRICES, "model, prompt, sampled")
