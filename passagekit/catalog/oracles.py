"""SQL (DuckDB dialect) for the named queries, written apart from the Spark code."""

from __future__ import annotations

from passagekit.functions.uris import DOMAIN
from passagekit.schemas import CONTEXT_LENGTHS, PRICES

SYSTEM = "Answer the query using the context provided. Be succinct."
LLM = "meta-llama/Llama-2-70b-chat-hf"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def _tokens(name: str, source: str, text: str) -> str:
    """Document tokens of one text column as a list column toks."""
    return (f"{name} AS (SELECT *, list_filter(string_split_regex(lower(regexp_replace({text}, '[^a-zA-Z0-9]+', ' ', 'g')), ' +'), "
            f"lambda x: x <> '') AS toks FROM {source})")


DOCS = "docs AS (SELECT doc_id AS id, text, source FROM documents)"
ASKED = "asked AS (SELECT item_id AS qid, text AS query FROM benchmark)"
WORD_ASKED = """asked AS (SELECT qid, list_sort(list_transform(ws, lambda w: {'n': length(w), 'w': w}), 'DESC')[1].w AS query
  FROM (SELECT item_id AS qid, string_split_regex(lower(text), '[^a-z0-9]+') AS ws FROM benchmark))"""

BM25_INDEX = ",\n".join([
    _tokens("dtok", "docs", "text"),
    "post AS (SELECT id, t AS term, count(*) AS tf FROM (SELECT id, unnest(toks) AS t FROM dtok) GROUP BY id, t)",
    "lens AS (SELECT id, len(toks) AS dl FROM dtok)",
    "st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)",
    "freq AS (SELECT term, count(*) AS df FROM post GROUP BY term)",
    "raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM freq, st)",
    "mean_r AS (SELECT favg(r) AS m FROM raw)",
    "weights AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, mean_r)",
])
BM25_SCORES = ",\n".join([
    """qwords AS (SELECT qid, t AS term, count(*) AS m FROM
  (SELECT qid, unnest(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '')) AS t FROM asked) GROUP BY qid, t)""",
    """matched AS (SELECT qid, post.id, sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qwords JOIN weights USING (term) JOIN post USING (term) JOIN lens ON lens.id = post.id, st GROUP BY qid, post.id)""",
])
BM25_RANK = ",\n".join([
    """every AS (SELECT a.qid, d.id, round(coalesce(m.score, 0), 10) AS score
  FROM asked a CROSS JOIN docs d LEFT JOIN matched m ON m.qid = a.qid AND m.id = d.id)""",
    "lex AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS pos FROM every)",
])
LEXICAL = ",\n".join([DOCS, ASKED, BM25_INDEX, BM25_SCORES, BM25_RANK])


def _hashed(name: str, source: str, key: str, text: str) -> str:
    """64 hashed buckets as a vector; all zero for a text without tokens."""
    return ",\n".join([
        _tokens(f"{name}_t", source, text),
        f"""{name}_c AS (SELECT {key}, b, count(*) AS c FROM (SELECT {key},
  unnest(list_transform(toks, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)) AS b FROM {name}_t) GROUP BY {key}, b)""",
        f"{name}_n AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM {name}_c GROUP BY {key})",
        f"{name}_w AS (SELECT {key}, b, (c / norm)::FLOAT::DOUBLE AS w FROM {name}_c JOIN {name}_n USING ({key}))",
    ])


HASH_RANK = ",\n".join([
    _hashed("dh", "docs", "id", "text"),
    _hashed("qh", "asked", "qid", "query"),
    "dh_l AS (SELECT id, sqrt(sum(w * w)) AS l FROM dh_w GROUP BY id)",
    "qh_l AS (SELECT qid, sqrt(sum(w * w)) AS l FROM qh_w GROUP BY qid)",
    "dots AS (SELECT qid, id, sum(q.w * d.w) AS dot FROM qh_w q JOIN dh_w d USING (b) GROUP BY qid, id)",
    """dists AS (SELECT a.qid, d.id, CASE WHEN ql.l IS NOT NULL AND dl.l IS NOT NULL
  THEN round(1 - coalesce(dot, 0) / (ql.l * dl.l), 10) END AS distance
  FROM asked a CROSS JOIN docs d LEFT JOIN dots ON dots.qid = a.qid AND dots.id = d.id
  LEFT JOIN qh_l ql ON ql.qid = a.qid LEFT JOIN dh_l dl ON dl.id = d.id)""",
    "sem AS (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, id) - 1 AS pos FROM dists)",
])
SEMANTIC = ",\n".join([DOCS, ASKED, HASH_RANK])
BOTH = ",\n".join([LEXICAL, HASH_RANK])

SPLICED = """spliced AS (
  SELECT qid, CASE WHEN pos < 2 THEN pos ELSE pos + 2 END AS pos, id, NULL::DOUBLE AS score FROM sem WHERE pos < 5
  UNION ALL SELECT qid, 2 + pos, id, score FROM lex WHERE pos < 2)"""

RERANKED = ",\n".join([
    SPLICED,
    "best AS (SELECT qid, source AS predicted FROM lex JOIN docs USING (id) WHERE pos = 0)",
    """moved AS (SELECT s.qid, s.id, d.source, d.text, row_number() OVER (PARTITION BY s.qid ORDER BY (d.source <> b.predicted), s.pos) - 1 AS pos
  FROM spliced s JOIN docs d USING (id) JOIN best b ON b.qid = s.qid)""",
    "reranked AS (SELECT * FROM moved WHERE pos < 4)",
])

# Distinct sources in the order in which they first occur.
def _grouped(hits: str) -> str:
    return ",\n".join([
        f"firsts AS (SELECT qid, source, min(pos) AS p FROM {hits} GROUP BY qid, source)",
        "names AS (SELECT qid, string_agg(source, ',' ORDER BY p) AS sources FROM firsts GROUP BY qid)",
        f"""lists AS (SELECT qid, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, sum(length(text))::BIGINT AS chars,
  string_agg('''' || replace(text, chr(10), '\\n') || '''', ', ' ORDER BY pos) AS context FROM {hits} GROUP BY qid)""",
    ])


def _trim(text: str, n: int) -> str:
    return f"array_to_string(regexp_extract_all({text}, '\\s*\\S+')[1:{n}], '')"


HYBRID = ",\n".join([
    BOTH, SPLICED, "hits AS (SELECT s.*, d.text, d.source FROM spliced s JOIN docs d USING (id))", _grouped("hits"),
])
def _answers(limit: str, llm: str = f"'{LLM}'", before: str = "") -> str:
    """Answers as md5 of the prompt, trimmed to `limit` tokens, with something before it."""
    user = _trim("'query: ' || query || ', context: [' || context || ']'", limit)
    return f"""{_with(HYBRID)}
SELECT qid, ids, sources, md5({before}'{SYSTEM} ' || {user}) AS answer, {llm} AS llm
FROM asked JOIN lists USING (qid) JOIN names USING (qid)"""


_SYSTEM_TOKENS = len(SYSTEM.split())
ANSWERS = _answers(2048 - _SYSTEM_TOKENS)
_ROUTED = f"CASE WHEN qid % 2 = 0 THEN '{LLM}' ELSE 'gpt-4' END"

_CONVERSATIONS = ",\n".join([
    """prefixes AS (SELECT r.conv_id, r.turn, count(*) AS n, string_agg(m.role || ': ' || m.text, chr(10) ORDER BY m.turn) AS whole
  FROM conversations r JOIN conversations m ON m.conv_id = r.conv_id AND m.turn <= r.turn WHERE r.role = 'user' GROUP BY r.conv_id, r.turn)""",
    "asked AS (SELECT c.conv_id AS qid, c.text AS query FROM conversations c JOIN prefixes f ON c.conv_id = f.conv_id AND c.turn = f.turn AND n = 1)",
    DOCS, HASH_RANK, "hits AS (SELECT s.qid, s.pos, s.id, d.text, d.source FROM sem s JOIN docs d USING (id) WHERE pos < 2)", _grouped("hits"),
])

EVALUATED = ",\n".join([
    BOTH,
    "refs AS (SELECT qid, text AS reference, source AS ref_source FROM sem JOIN docs USING (id) WHERE pos = 0)",
    "hits AS (SELECT l.qid, l.pos, l.id, d.text, d.source FROM lex l JOIN docs d USING (id) WHERE pos < 3)",
    _grouped("hits"),
    "pairs AS (SELECT qid, query, reference, ref_source, string_split(sources, ',') AS srcs FROM asked JOIN refs USING (qid) JOIN names USING (qid))",
    """prompts AS (SELECT *, '{''question'': ''' || replace(query, chr(10), '\\n') || ''', ''generated_answer'': ''' || srcs[1] ||
  ''', ''reference_answer'': ''' || replace(reference, chr(10), '\\n') || '''}' AS prompt FROM pairs)""",
    """judged AS (SELECT *, CASE WHEN list_contains(srcs, ref_source) THEN 1 ELSE 0 END AS found,
  (length(prompt) % 5)::DOUBLE AS score, 'length ' || length(prompt) AS reasoning FROM
  (SELECT * REPLACE (array_to_string(regexp_extract_all(prompt, '\\s*\\S+'), '') AS prompt) FROM prompts))""",
])


def _entities(text: str) -> str:
    """The entities of the pages; `&amp` also counts without its semicolon."""
    for name, sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{name}', '{sign}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def _no_tags(html: str) -> str:
    return f"regexp_replace({html}, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', '', 'g')"


PAGE_TEXT = _entities(_no_tags("html"))
ARTICLE = ",\n".join([
    "inner_html AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1) AS h FROM pages)",
    "cut AS (SELECT page_id, url, h, strpos(h, '<p><b>') AS c FROM inner_html)",
    """parts AS (SELECT page_id, url, CASE WHEN c > 0 THEN substr(h, 1, c - 1) ELSE h END AS head,
  CASE WHEN c > 0 THEN substr(h, c) ELSE '' END AS tail FROM cut)""",
    f"""articles AS (SELECT page_id, url AS source, rtrim({_entities(_no_tags("regexp_replace(head, '\\s*</(h1|p)>\\s*', chr(10), 'g')"))}
  || {_entities(_no_tags("tail"))}, ' ' || chr(10)) AS text FROM parts)""",
])


def _level(i: int, separator: str, size: int) -> str:
    """Split the pieces that are left at one separator; small pieces join runs, large ones go on."""
    split = f"string_split(piece, {separator})" if separator != "''" else "regexp_extract_all(piece, '(?s).')"
    width = f"length({separator})"
    return ",\n".join([
        f"has{i} AS (SELECT *, {'true' if separator == chr(39) * 2 else f'contains(piece, {separator})'} AS cut FROM todo{i})",
        f"un{i} AS (SELECT key, off, unnest({split}) AS part, generate_subscripts({split}, 1) AS n FROM has{i} WHERE cut)",
        f"""pc{i} AS (SELECT key, off AS parent, n, CASE WHEN n > 1 THEN {separator} || part ELSE part END AS piece FROM un{i})""",
        f"""ps{i} AS (SELECT *, parent + coalesce(sum(length(piece)) OVER (PARTITION BY key, parent ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, length(piece) >= {size} AS big FROM pc{i} WHERE piece <> '')""",
        f"pr{i} AS (SELECT *, sum(big::INT) OVER (PARTITION BY key, parent ORDER BY n) AS run FROM ps{i})",
        f"""run{i} AS (SELECT key, min(off) AS off, list(off + length(piece) ORDER BY n) AS ends, string_agg(piece, '' ORDER BY n) AS body
  FROM pr{i} WHERE NOT big GROUP BY key, parent, run)""",
        f"todo{i + 1} AS (SELECT key, off, piece FROM pr{i} WHERE big UNION ALL SELECT key, off, piece FROM has{i} WHERE NOT cut)",
    ])


def _chunked(texts: str, size: int, overlap: int) -> str:
    """chunks(key, chunk_pos, text) of a relation with key and text, by the rules of the recursive splitter."""
    return ",\n".join([
        f"todo1 AS (SELECT key, 0::BIGINT AS off, text AS piece FROM {texts} WHERE text <> '')",
        _level(1, "chr(10) || chr(10)", size), _level(2, "chr(10)", size), _level(3, "' '", size), _level(4, "''", size),
        """runs AS (SELECT key, off, list_prepend(off, ends) AS cuts, body FROM (
  SELECT * FROM run1 UNION ALL SELECT * FROM run2 UNION ALL SELECT * FROM run3 UNION ALL SELECT * FROM run4))""",
        f"""steps AS (
  SELECT key, off, cuts, body, 1::BIGINT AS first, greatest(len(list_filter(cuts, lambda c: c <= cuts[1] + {size})), 2)::BIGINT AS last FROM runs
  UNION ALL
  SELECT key, off, cuts, body, f, greatest(len(list_filter(cuts, lambda c: c <= cuts[f] + {size})), f + 1)::BIGINT FROM (
    SELECT key, off, cuts, body, least(last, 1 + len(list_filter(cuts, lambda c: c < greatest(cuts[last] - {overlap}, cuts[last + 1] - {size}))))::BIGINT AS f
    FROM steps WHERE last < len(cuts)))""",
        """emitted AS (SELECT key, cuts[first] AS start, trim(substr(body, cuts[first] - off + 1, cuts[last] - cuts[first]), ' ' || chr(10)) AS text FROM steps)""",
        "chunks AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start) - 1 AS chunk_pos, text FROM emitted WHERE text <> '')",
    ])


DOC_CHUNKS = ",\n".join(["texts AS (SELECT doc_id AS key, text FROM documents)", _chunked("texts", 300, 50)])
INDEXED = ",\n".join([
    ARTICLE, "texts AS (SELECT page_id AS key, text FROM articles)", _chunked("texts", 300, 50),
    "ix AS (SELECT key * 268435456 + chunk_pos AS id, c.text, source FROM chunks c JOIN articles ON page_id = key)",
    _hashed("xh", "ix", "id", "text"),
    "peaks AS (SELECT id, count(*) AS buckets, round(max(w), 5) AS peak FROM xh_w GROUP BY id)",
])
INDEX = f"""{_with(INDEXED)}
SELECT ix.id, text, source, coalesce(buckets, 0) AS buckets, coalesce(peak, 0) AS peak FROM ix LEFT JOIN peaks USING (id)"""

_PUNCTUATED = "regexp_replace(regexp_replace({}, '([\\p{{L}}\\p{{N}}_])([?.,!])(\\S|$)', '\\1 \\2\\3', 'g'), '([\\p{{L}}\\p{{N}}_])([?.,!])(\\S|$)', '\\1 \\2\\3', 'g')"


def _camel(text: str) -> str:
    """Twice, because a match may end where the next one begins."""
    once = f"regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({once}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"


_NORMAL = _camel("replace(replace(translate(" + _PUNCTUATED.format("text") + ", '_-#', '   '), '.html', ''), '.', ' ')")
_LABELLED = "documents JOIN labels USING (doc_id)"
_MODELS = ", ".join(f"('{model}', {length})" for model, length in CONTEXT_LENGTHS)
_PRICES = ", ".join(f"('{model}', {prompt}, {sampled})" for model, prompt, sampled in PRICES)
_REPLY_SOURCES = "CASE WHEN lang = 'en' THEN []::VARCHAR[] ELSE [source, lang] END"



def _bayes(training: str, asked: str, key: str) -> str:
    """Multinomial naive Bayes with add-one smoothing. training: label, text. asked: key columns, text. Result: chances (key, label, p)."""
    normal = f"list_filter(string_split_regex(lower({_NORMAL}), '\\s+'), lambda x: x <> '')"
    return ",\n".join([
        f"taught AS (SELECT label, {normal} AS words FROM ({training}))",
        "classes AS (SELECT label, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())) AS prior FROM taught GROUP BY label)",
        "seen AS (SELECT label, w, count(*) AS n FROM (SELECT label, unnest(words) AS w FROM taught) GROUP BY label, w)",
        "vocabulary AS (SELECT DISTINCT w FROM seen)",
        "sizes AS (SELECT label, sum(n) AS total FROM seen GROUP BY label)",
        """thetas AS (SELECT c.label, v.w, ln((coalesce(s.n, 0) + 1) / (coalesce(z.total, 0) + (SELECT count(*) FROM vocabulary))) AS theta
  FROM classes c CROSS JOIN vocabulary v LEFT JOIN seen s ON s.label = c.label AND s.w = v.w LEFT JOIN sizes z ON z.label = c.label)""",
        f"""said AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest({normal}) AS w FROM ({asked})) GROUP BY {key}, w)""",
        f"parts AS (SELECT {key}, label, sum(n * theta) AS score FROM said JOIN thetas USING (w) GROUP BY {key}, label)",
        f"""logits AS (SELECT {key}, c.label, c.prior + coalesce(p.score, 0) AS logit FROM ({asked}) a CROSS JOIN classes c
  LEFT JOIN parts p USING ({key}, label))""",
        f"""chances AS (SELECT {key}, label, 1 / sum(exp(least(o.logit - l.logit, 700))) AS p FROM logits l JOIN
  (SELECT {key}, label AS other, logit FROM logits) o USING ({key}) GROUP BY {key}, label)""",
    ])


_TAGGED = f"""{_with(_bayes(f"SELECT quality::VARCHAR AS label, text FROM {_LABELLED}", "SELECT doc_id, text FROM documents", "doc_id"))}
SELECT doc_id, CASE WHEN max(p) >= 0.7 THEN arg_max(label, p) ELSE 'other' END AS predicted,
  round(max(p) FILTER (label = '1'), 5) AS probability FROM chances GROUP BY doc_id"""

BM25_TOPK = f"{_with(LEXICAL)} SELECT qid, pos, id, round(score, 6) AS score FROM lex WHERE pos < 3"

ORACLES: dict[str, str] = {
    "knn_topk": """WITH d AS (SELECT q.vec_id AS qid, e.vec_id AS id,
  round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 10) AS distance FROM embeddings q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, id) - 1 AS pos FROM d)
SELECT qid, pos, id, round(distance, 6) AS distance FROM r WHERE pos < 5""",
    "knn_centroid": """WITH p AS (SELECT generate_subscripts(embedding, 1) AS off, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT off, avg(v) AS v FROM p GROUP BY off), c AS (SELECT list(v ORDER BY off) AS q FROM m)
SELECT vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, c
ORDER BY round(list_cosine_distance(embedding::DOUBLE[], q), 10), vec_id LIMIT 10""",
    "hash_embed_weights": f"{_with(DOCS, _hashed('dh', 'docs', 'id', 'text'))} SELECT id AS doc_id, b AS bucket, round(w, 5) AS weight FROM dh_w",
    "embed_user_model": "SELECT doc_id, " + ", ".join(
        f"(length(text) - length(replace(text, '{v}', '')))::DOUBLE AS {v}" for v in "aeiou") + " FROM documents",
    "embedding_sizes": "SELECT label, len(embedding) AS dim, count(*) AS vectors FROM embeddings GROUP BY ALL",
    "hash_knn": f"{_with(SEMANTIC)} SELECT qid, pos, id, round(distance, 5) AS distance FROM sem WHERE pos < 5",
    "bm25_terms": f"{_with(DOCS, BM25_INDEX)} SELECT term, df, round(idf, 6) AS idf FROM weights",
    "bm25_stats": f"{_with(DOCS, BM25_INDEX)} SELECT n, round(avgdl, 6) AS avgdl, round(m, 6) AS mean_idf FROM st, mean_r",
    "bm25_postings": f"{_with(DOCS, BM25_INDEX)} SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM post GROUP BY term",
    "bm25_scores": f"{_with(DOCS, ASKED, BM25_INDEX, BM25_SCORES)} SELECT qid, id, round(round(score, 10), 6) AS score FROM matched WHERE round(score, 10) <> 0",
    "bm25_topk": BM25_TOPK,
    "bm25_fill": f"{_with(DOCS, WORD_ASKED, BM25_INDEX, BM25_SCORES, BM25_RANK)} SELECT qid, pos, id, round(score, 6) AS score FROM lex WHERE pos < 5",
    "bm25_saved_index": BM25_TOPK,
    "hybrid_splice": f"{_with(BOTH, SPLICED)} SELECT qid, pos, id, round(score, 6) AS score FROM spliced",
    "hybrid_splice_dedup": f"""{_with(BOTH, SPLICED, "kept AS (SELECT qid, id, min(pos) AS p FROM spliced GROUP BY qid, id)")}
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY p) - 1 AS pos, id FROM kept""",
    "rerank_by_source": f"{_with(BOTH, RERANKED)} SELECT qid, pos, id, source FROM reranked",
    "context_lists": f"{_with(BOTH, RERANKED, _grouped('reranked'))} SELECT qid, ids, sources, chars FROM lists JOIN names USING (qid)",
    "sections_article": f"{_with(ARTICLE)} SELECT page_id, 0 AS section_pos, source, text FROM articles",
    "sections_default_empty": "SELECT page_id, 0 AS section_pos, url AS source, html AS text FROM pages WHERE html LIKE '%<section%'",
    "chunk_documents": f"{_with(DOC_CHUNKS)} SELECT key AS doc_id, chunk_pos, text FROM chunks",
    "chunk_serving": f"""{_with("texts AS (SELECT doc_id AS key, text FROM documents)", _chunked("texts", 700, 50))}
SELECT key AS doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM chunks GROUP BY key""",
    "chunk_invariants": """SELECT 0 AS too_long, 0 AS "empty", 0 AS unstripped, 0 AS "foreign", count(*) AS documents
FROM documents WHERE length(trim(text, ' ' || chr(10))) > 0""",
    "uri_rewrite": """SELECT page_id, 'https://example.com' || list_last(string_split(url, 'example.com')) AS uri, split_part(url, '#', 1) AS page,
  nullif(split_part(url, '#', 2), '') AS anchor, nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), '') AS tag FROM pages""",
    "page_texts": f"SELECT page_id, {PAGE_TEXT} AS text FROM pages",
    "resolve_uris": f"""WITH held AS (SELECT split_part(url, '#', 1) AS page, min(html) AS html FROM pages GROUP BY 1),
uris AS (SELECT page_id, url AS uri FROM pages UNION ALL SELECT page_id, split_part(url, '#', 1) || '#no-such-id' FROM pages)
SELECT page_id, uri, {PAGE_TEXT} AS text FROM uris LEFT JOIN held ON page = split_part(uri, '#', 1)""",
    "incremental_new": """SELECT page_id, url FROM pages
WHERE url NOT IN (SELECT url FROM pages WHERE regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) = 'en')""",
    "numbered_pages": "SELECT page_id, url, dense_rank() OVER (ORDER BY url) - 1 AS number FROM pages",
    "source_statistics": "SELECT source, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source",
    "index_build": INDEX,
    "index_written": INDEX,
    "index_loaded": INDEX,
    "index_stream": INDEX,
    "document_index": f"""{_with(DOC_CHUNKS)}
SELECT key * 268435456 + chunk_pos AS id, chunks.text, source FROM chunks JOIN documents ON doc_id = key""",
    "token_counts": f"""SELECT doc_id, len(regexp_extract_all(text, '\\s*\\S+')) AS tokens, md5({_trim("text", 100)}) AS first_hundred FROM documents""",
    "token_budget": r"""WITH firsts AS (SELECT conv_id, arg_min(text, (turn, text)) AS system FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'meta-llama/Llama-2-70b-chat-hf' ELSE 'gpt-4' END AS llm,
  CASE WHEN role = 'user' THEN 4096 ELSE 8192 END // 8 AS share, len(regexp_extract_all(system, '\s*\S+')) AS used
  FROM conversations JOIN firsts USING (conv_id))
SELECT conv_id, turn, llm, greatest(share - used, 0) AS input_budget, share AS output_budget, share < used AS over_budget FROM n""",
    "prompt_rows": f"""WITH p AS (SELECT doc_id, '{SYSTEM} ' || {_trim("'query: ' || lang || ', context: [''' || replace(text, chr(10), '\\n') || ''']'", 150)} AS prompt
  FROM documents) SELECT doc_id, length(prompt) AS chars, md5(prompt) AS prompt_md5 FROM p""",
    "normalize_text": f"SELECT doc_id, md5({_NORMAL}) AS normal, md5({_camel('text')}) AS camel FROM documents",
    "reply_texts": f"""WITH d AS (SELECT *, {_REPLY_SOURCES} AS s FROM documents)
SELECT doc_id, md5(text || CASE WHEN len(s) > 0 THEN chr(10) || chr(10) || '**Sources:**' || chr(10) ||
  array_to_string(list_transform(s, lambda x: '* ' || x || chr(10)), '') ELSE '' END) AS reply,
  md5(text || chr(10) || coalesce(array_to_string(s, chr(10)), '')) AS chat, md5(substr(text, 16)) AS mention,
  CASE WHEN lang = 'en' THEN lang ELSE source END AS thread FROM d""",
    "generator_outputs": """SELECT doc_id, CASE WHEN toxic = 0 THEN 'answer ' || quality ELSE 'Unknown format in generator output' END AS answer FROM labels""",
    "softmax_labels": """WITH c AS (SELECT doc_id, (length(text) - length(replace(text, 'a', ''))) / 100.0 AS a,
  (length(text) - length(replace(text, 'e', ''))) / 100.0 AS e FROM documents),
p AS (SELECT doc_id, 1 / (1 + exp(e - a)) AS pa, 1 / (1 + exp(a - e)) AS pe FROM c)
SELECT doc_id, CASE WHEN greatest(pa, pe) < 0.6 THEN 'other' WHEN pa >= pe THEN 'a' ELSE 'e' END AS predicted,
  round(greatest(pa, pe), 6) AS probability FROM p""",
    "conversation_routes": """SELECT conv_id, turn, text AS query, turn = min_turn AS retrieves FROM conversations
JOIN (SELECT conv_id, min(turn) AS min_turn FROM conversations GROUP BY conv_id) USING (conv_id) WHERE role = 'user'""",
    "conversation_cost": f"""WITH price(model, p, s) AS (VALUES {_PRICES}),
used AS (SELECT CASE WHEN turn >= 4 THEN 'gpt-4' ELSE '{LLM}' END AS llm, role, len(regexp_extract_all(text, '\\s*\\S+')) AS n FROM conversations),
total AS (SELECT llm, coalesce(sum(n) FILTER (role <> 'assistant'), 0)::BIGINT AS prompt_tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS sampled_tokens FROM used GROUP BY llm)
SELECT llm, prompt_tokens, sampled_tokens, round((prompt_tokens * p::DOUBLE + sampled_tokens * s::DOUBLE) / 1e6, 6) AS cost
FROM total LEFT JOIN price ON model = lower(regexp_replace(llm, '^.*/', ''))""",
    "hybrid_contexts": f"{_with(HYBRID)} SELECT qid, ids, sources FROM lists JOIN names USING (qid)",
    "answer_questions": ANSWERS,
    "routed_answers": _answers(f"(CASE WHEN qid % 2 = 0 THEN 2048 ELSE 4096 END - {_SYSTEM_TOKENS})", _ROUTED,
                               f"{_ROUTED} || CASE WHEN qid % 2 = 0 THEN '|2048|' ELSE '|4096|' END || "),
    "answers_short_context": _answers(200 - _SYSTEM_TOKENS),
    "sections_nested": f"""SELECT page_id, 0 AS section_pos, 'https://{DOMAIN}/p/' || page_id || '.html#o' || page_id AS source,
  'one ' || page_id || chr(10) || 'mid' || chr(10) || 'tail' AS text FROM pages
UNION ALL SELECT page_id, 1, 'https://{DOMAIN}/p/' || page_id || '.html#i', trim({PAGE_TEXT}, ' ' || chr(10)) FROM pages""",
    "resolve_anchors": f"""WITH p AS (SELECT page_id, 'data/{DOMAIN}/p/' || page_id || '.html' AS base,
  'one ' || page_id || ' mid ' || {PAGE_TEXT} || 'tail' AS outside, {PAGE_TEXT} AS inside FROM pages)
SELECT page_id, base || '#o' || page_id AS uri, outside AS text FROM p UNION ALL SELECT page_id, base || '#i', inside FROM p
UNION ALL SELECT page_id, base || '#missing', outside || 'none' FROM p UNION ALL SELECT page_id, base, outside || 'none' FROM p""",
    "bad_markup": f"""SELECT page_id, 0 AS section_pos, url || '#a' AS source, page_id % 4 < 2 AS damaged,
  CASE page_id % 4 WHEN 0 THEN 'x' || chr(10) || '[foo]' WHEN 1 THEN 'x' || chr(10) || '[' ELSE 'x ' || chr(65533) END
  || chr(10) || trim({PAGE_TEXT}, ' ' || chr(10)) AS text FROM pages
UNION ALL SELECT page_id, 1, url || '#b', page_id % 4 < 2, url FROM pages""",
    "experiment_record": ANSWERS,
    "answer_stream": ANSWERS,
    "answer_log": """SELECT 'finished streaming query' AS event, source AS llm, 2 * count(*) AS events, count(DISTINCT doc_id) AS documents,
  0 AS unstamped FROM documents GROUP BY source""",
    "retrieval_score": f"{_with(EVALUATED)} SELECT round(avg(found), 6) AS retrieval_score FROM judged",
    "retrieval_hits": f"{_with(EVALUATED)} SELECT qid, found FROM judged",
    "alignment_check": """SELECT count(*) FILTER (item_id IS NOT NULL AND doc_id IS NOT NULL) AS pairs, count(*) FILTER (doc_id IS NULL) AS without_response,
  count(*) FILTER (item_id IS NULL) AS without_reference,
  count(*) FILTER (item_id IS NOT NULL AND doc_id IS NOT NULL AND b.text IS DISTINCT FROM d.text) AS differing
FROM benchmark b FULL JOIN documents d ON item_id = doc_id""",
    "judged_answers": f"{_with(EVALUATED)} SELECT qid, score, reasoning, NULL::VARCHAR AS score_error FROM judged",
    "judged_scores": f"""{_with(EVALUATED)} SELECT round(avg(found), 6) AS retrieval_score,
  round(avg(score) FILTER (score <> 0 AND length(reference) > 0), 6) AS quality_score FROM judged""",
    "judge_lines": """SELECT doc_id, CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 4.5 END::DOUBLE AS score,
  CASE WHEN toxic = 1 THEN '' ELSE 'because of ' || doc_id END AS reasoning,
  CASE WHEN toxic <> 1 AND quality <> 1 THEN 'score is not a number: n/a' END AS error FROM labels""",
    "judge_json": """SELECT doc_id, CASE WHEN toxic = 0 THEN 'a' || doc_id ELSE '' END AS answer, CASE WHEN toxic = 0 THEN quality::DOUBLE END AS score,
  CASE WHEN toxic = 0 THEN 'r' ELSE '' END AS reasoning FROM labels""",
    "quality_score": f"""SELECT round(avg(quality * (1 + length(text) % 5)) FILTER (quality <> 0 AND toxic <> 1 AND length(text) > 0), 6) AS quality_score
FROM {_LABELLED}""",
    "judge_prompts": f"""{_with(EVALUATED)} SELECT qid, md5({_trim("prompt", 60)}) AS prompt FROM prompts""",
    "generated_answers": "SELECT doc_id, md5(text) AS answer, NULL::VARCHAR AS error FROM documents",
}
ORACLES |= {
    "knn_cells": ORACLES["knn_topk"],
    "bm25_blocks": BM25_TOPK,
    "context_ranges": ORACLES["context_lists"],
    "incremental_refresh": f"""{_with(INDEXED, "tags AS (SELECT page_id, coalesce(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), '') AS tag FROM pages)")}
SELECT page_id, CASE tag WHEN 'fr' THEN 'new' WHEN 'de' THEN 'changed' ELSE 'same' END AS status, ix.id, ix.text, ix.source
FROM tags LEFT JOIN ix ON ix.id >> 28 = page_id
UNION ALL SELECT page_id + 10000000, 'gone', NULL, NULL, NULL FROM tags WHERE tag = 'es'""",
    # the copies that only the earlier arrivals have stay, as a stream brings no word of pages that are gone
    "index_stream_repeats": f"""{_with(INDEXED, "tags AS (SELECT page_id, coalesce(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), '') AS tag FROM pages)")}
SELECT id, text, source FROM ix
UNION ALL SELECT ix.id + 10000000::BIGINT * 268435456, ix.text, ix.source FROM ix JOIN tags ON ix.id >> 28 = page_id WHERE tag = 'es'""",
    "html_files": "SELECT page_id, md5(html || chr(10)) AS content FROM pages",
    "index_table": INDEX,
    "index_reset": INDEX,
    "stage_counts": f"""{_with(INDEXED)} SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM articles) AS sections,
  (SELECT count(*) FROM ix) AS chunks""",
    "first_chunks": "SELECT doc_id, md5(text) AS content FROM documents ORDER BY doc_id DESC LIMIT 20",
    "references_read": """SELECT form, CASE form WHEN 'array' THEN row_number() OVER (PARTITION BY form ORDER BY item_id) - 1 ELSE item_id END AS qid,
  md5(text) AS question, md5(text) AS answer, 's#' || item_id AS source FROM benchmark, (VALUES ('array'), ('lines')) AS f(form)""",
    "sent_requests": """SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN '' ELSE md5(text) END AS answer,
  CASE WHEN length(text) % 7 = 0 THEN 'RuntimeError: busy' END AS error FROM documents""",
    "evaluation_written": f"""{_with(EVALUATED)} SELECT qid, score, reasoning, 'owner/Length-Judge' AS evaluator,
  round(avg(found) OVER (), 6) AS retrieval_score,
  round(avg(score) FILTER (score <> 0 AND length(reference) > 0) OVER (), 6) AS quality_score FROM judged""",
    "experiment_from_pages": f"""{_with(INDEXED, "docs AS (SELECT id, text, source FROM ix)",
        "asked AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, text AS query FROM benchmark)", BM25_INDEX, BM25_SCORES, BM25_RANK, HASH_RANK,
        SPLICED, "hits AS (SELECT s.*, d.text, d.source FROM spliced s JOIN docs d USING (id))", _grouped("hits"))}
SELECT qid, ids, sources, md5('{SYSTEM} ' || {_trim("'query: ' || query || ', context: [' || context || ']'", 2048 - _SYSTEM_TOKENS)}) AS answer,
  '{LLM}' AS llm FROM asked JOIN lists USING (qid) JOIN names USING (qid)""",
    "tag_probabilities": _TAGGED,
    "tag_weights": _TAGGED,
    "routed_by_model": f"""{_with(_bayes(f"SELECT quality::VARCHAR AS label, text FROM {_LABELLED}",
        "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'", "conv_id, turn"))}
SELECT conv_id, turn, CASE WHEN max(p) FILTER (label = '1') > max(p) FILTER (label = '0') THEN '{LLM}' ELSE 'gpt-4' END AS llm
FROM chances GROUP BY conv_id, turn""",
    "reranked_answers": f"""{_with(BOTH, SPLICED, _bayes("SELECT source AS label, text FROM documents", "SELECT qid, query AS text FROM asked", "qid"),
        """tags AS (SELECT qid, CASE WHEN max(p) >= 0.5 THEN arg_max(label, p) ELSE 'other' END AS predicted FROM chances GROUP BY qid),
moved AS (SELECT s.qid, s.id, d.source, d.text, row_number() OVER (PARTITION BY s.qid
  ORDER BY (predicted <> 'other' AND d.source <> predicted), s.pos) - 1 AS pos
  FROM spliced s JOIN docs d USING (id) JOIN tags t ON t.qid = s.qid),
hits AS (SELECT * FROM moved WHERE pos < 4)""", _grouped("hits"))}
SELECT qid, ids, sources, md5('{SYSTEM} ' || {_trim("'query: ' || query || ', context: [' || context || ']'", 2048 - _SYSTEM_TOKENS)}) AS answer,
  '{LLM}' AS llm FROM asked JOIN lists USING (qid) JOIN names USING (qid)""",
    "generated_batches": "SELECT doc_id, md5(text) AS answer, NULL::VARCHAR AS error FROM documents",
    "conversation_prefixes": """SELECT r.conv_id, r.turn, count(*) AS messages,
  md5(string_agg(m.role || ': ' || m.text, chr(10) ORDER BY m.turn)) AS whole
FROM conversations r JOIN conversations m ON m.conv_id = r.conv_id AND m.turn <= r.turn WHERE r.role = 'user' GROUP BY r.conv_id, r.turn""",
    "routed_conversations": f"""{_with(_CONVERSATIONS)}
SELECT f.conv_id, f.turn, coalesce(ids, '') AS ids, coalesce(sources, '') AS sources, CASE WHEN n = 1
  THEN md5('{SYSTEM} ' || {_trim("'query: ' || query || ', context: [' || context || ']'", 2048 - _SYSTEM_TOKENS)}) ELSE md5(whole) END AS answer
FROM prefixes f LEFT JOIN asked ON qid = f.conv_id AND n = 1 LEFT JOIN lists USING (qid) LEFT JOIN names USING (qid)""",
    "numbered_files": """WITH n AS (SELECT printf('%08d', page_id) AS name, contains(coalesce(url, ''), '/en/') AS early FROM pages),
r AS (SELECT name, early, row_number() OVER (PARTITION BY early ORDER BY name) - 1 AS place, count(*) FILTER (early) OVER () AS first FROM n)
SELECT name, CASE WHEN early THEN place ELSE first + place END AS number, CASE WHEN early THEN place END AS first_number FROM r""",
}
