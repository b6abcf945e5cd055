"""The operators of this subpackage as named queries over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagekit.llm.common import table
from passagekit.llm.conversation_repair import damaged, repair_conversations
from passagekit.llm.extraction import main_texts
from passagekit.llm.jaccard_join import jaccard_components
from passagekit.llm.line_dedup import drop_site_lines
from passagekit.llm.merkle import document_manifest
from passagekit.llm.mixing import mix_sources
from passagekit.llm.oracles import CONVERSATION_REPAIR, MERKLE_MANIFEST, SHARDING
from passagekit.llm.packing import pack_documents
from passagekit.llm.quality import quality_rules
from passagekit.llm.sharding import document_shards
from passagekit.llm.token_count import count_tokens
from passagekit.llm.token_files import session_folder, token_files
from passagekit.llm.toxicity import score_toxicity
from passagekit.llm.voronoi_knn import exact_top_k

#: Where the files of the public tokenizers lie; the same on every machine of a cluster.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

Query = Callable[[SparkSession, str], DataFrame]


def op1_voronoi_knn(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return exact_top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", session_folder(spark), 50257)


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality_rules(table(spark, folder, "documents"), trusted)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_site_lines(table(spark, folder, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, folder, "conversations")))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(table(spark, folder, "documents"))


def op13_hash_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return document_shards(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_token_files": op2_token_files,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_mix_sources": op8_mix_sources,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hash_ring_shards": op13_hash_ring_shards,
}

ORACLES: dict[str, str] = {
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_hash_ring_shards": SHARDING,
    "op1_voronoi_knn": """
WITH parts AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
ints AS (SELECT vec_id, pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts),
scores AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.v * d.v) AS BIGINT) AS score
           FROM ints q JOIN ints d ON q.pos = d.pos AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op8_mix_sources": """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, CASE WHEN size > 0 THEN sqrt(CAST(size AS DOUBLE)) ELSE 0.0 END AS raw FROM sizes),
whole AS (SELECT sum(raw) AS raws, sum(size) AS total FROM weighed),
rates AS (SELECT source, CASE WHEN size > 0 THEN raw / raws * 1.0 * CAST(total AS DOUBLE) / size ELSE 0.0 END AS rate
          FROM weighed, whole),
parts AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 64.0) AS BIGINT)) AS parts FROM rates WHERE rate > 0),
means AS (SELECT source, parts, rate / parts AS mean FROM parts),
steps AS (SELECT source, parts, mean, unnest(range(0, CAST(ceil(mean + 10 * sqrt(mean) + 20) AS BIGINT) + 1)) AS k FROM means),
masses AS (SELECT source, parts, k, exp(k * ln(mean) - mean - sum(ln(greatest(k, 1)))
             OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)) AS mass FROM steps),
cuts AS (SELECT source, parts, k, least(CAST(floor(sum(mass) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)
           * 4294967296.0) AS BIGINT), 4294967296) AS cut FROM masses),
drawn AS (
  SELECT d.doc_id, p.part, CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(p.part AS VARCHAR)), 1, 8) AS BIGINT) AS u,
         d.source, d.text, d.lang, d.n_chars
  FROM documents d JOIN (SELECT source, unnest(range(1, parts + 1)) AS part FROM means) p ON d.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT r.doc_id, r.part, r.source, r.text, r.lang, r.n_chars,
         (SELECT count(*) FROM cuts c WHERE c.source IS NOT DISTINCT FROM r.source AND c.cut <= r.u) AS n
  FROM drawn r),
copies AS (SELECT doc_id, text, lang, source, n_chars, (part - 1) * 1024 + unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS BIGINT) AS copy,
       CAST('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS position_key
FROM copies
""",
    "op9_line_dedup": r"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
lines AS (SELECT page, doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counts AS (SELECT source, trim(line, ' ') AS bare, count(DISTINCT page) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
often AS (SELECT c.source, c.bare FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE c.n >= 3 AND c.n > 0.1 * t.pages),
marked AS (SELECT l.page, l.line, l.pos, o.bare IS NOT NULL AS dropped
           FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND trim(l.line, ' ') = o.bare),
kept AS (SELECT page, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS text, count(*) AS n_lines,
                count(*) FILTER (dropped) AS n_dropped FROM marked GROUP BY page)
SELECT p.doc_id, p.source, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM pages p LEFT JOIN kept k ON p.page = k.page
""",
}
