"""Text to vectors: a user's model in batches, or the built-in hashed bag of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.functions.text import document_tokens
from passagekit.schemas import EMBED_BATCH, EMBEDDING_DIMS

VECTOR = T.ArrayType(T.FloatType())


def check_dim(embedding: Column, dim: int) -> Column:
    """The vector; any other size stops the job."""
    message = F.concat(F.lit(f"expected a vector of {dim}, got "), F.size(embedding).cast("string"))
    return F.when(F.size(embedding) != dim, F.raise_error(message).cast(VECTOR)).otherwise(embedding)


def token_bucket(token: str, dim: int) -> int:
    """The first eight hex digits of the token's md5, modulo dim."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dim


def hash_vector(text: Column, dim: int) -> Column:
    """Document tokens counted per bucket, scaled to length 1; all zero for a text without tokens.

    A stand-in for a neural model: it needs no download and can be checked with SQL, but it only
    knows which words occur. Tokens are cut in the JVM; a batch then hashes each distinct token
    once and counts all its texts with one bincount. No shuffle.
    """

    @F.arrow_udf(VECTOR)
    def counted(tokens: pa.Array) -> pa.Array:
        missing = tokens.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(missing, 0, np.diff(tokens.offsets.to_numpy()))
        coded = tokens.flatten().dictionary_encode()
        buckets = np.array([token_bucket(t, dim) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        rows = np.repeat(np.arange(len(tokens)), sizes)
        cells = rows * dim + buckets[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(cells, minlength=len(tokens) * dim).reshape(len(tokens), dim)
        norms = np.sqrt((counts * counts).sum(axis=1))
        unit = counts / np.where(norms == 0, 1.0, norms)[:, None]
        offsets = np.arange(0, unit.size + 1, dim, dtype=np.int32)
        values = pa.array(unit.astype(np.float32).ravel())
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(missing))

    # Not deterministic only in name: this keeps the optimizer from evaluating it again in pushed-down filters.
    return counted.asNondeterministic()(document_tokens(text))


def hash_embed(df: DataFrame, text_col: str = "text", dim: int = 64, into: str = "embedding") -> DataFrame:
    return df.withColumn(into, hash_vector(F.col(text_col), dim))


def embed(df: DataFrame, text_col: str, factory: Callable[..., object], dim: int | None = None,
          batch_size: int = EMBED_BATCH, into: str = "embedding", **options: object) -> DataFrame:
    """Add vectors from a user's model.

    `factory(**options)` is an importable callable; it runs once per partition and returns a
    function from a list of texts to a list of vectors. It never sees more than `batch_size` texts
    and no NULL. Only the text column goes to Python.
    """

    @F.arrow_udf(VECTOR)
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory(**options)
        for texts in batches:
            values = texts.to_pylist()
            held = [i for i, v in enumerate(values) if v is not None]
            vectors: list = [None] * len(values)
            for start in range(0, len(held), batch_size):
                block = held[start:start + batch_size]
                for i, vector in zip(block, model([values[j] for j in block])):
                    vectors[i] = np.asarray(vector, dtype=np.float32)
            yield pa.array(vectors, pa.list_(pa.float32()))

    vector = embedded.asNondeterministic()(F.col(text_col))
    out = df.withColumn(into, vector)
    return out.withColumn(into, check_dim(F.col(into), dim)) if dim else out


def dimension_of(model: str) -> int | None:
    """The size of a model's vectors, None if it is not known beforehand."""
    return int(model.removeprefix("hash-")) if model.startswith("hash-") else dict(EMBEDDING_DIMS).get(model)


def embed_with(df: DataFrame, text_col: str, model: str, models: dict[str, Callable] | None = None,
               into: str = "embedding", **options: object) -> DataFrame:
    """Choose by name: `hash-<dim>` is built in, other names are looked up in `models`.

    The vectors of models with a known dimension are checked.
    """
    if model.startswith("hash-"):
        return hash_embed(df, text_col, int(model.removeprefix("hash-")), into)
    if not models or model not in models:
        raise KeyError(f"no factory for embedding model {model}")
    return embed(df, text_col, models[model], dict(EMBEDDING_DIMS).get(model), into=into, **options)
