"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from ..config import DEFAULT, EMPTY_QUESTION_REPLY
from .oracle_sql import (
    all_corpus_ctes, chunk_ctes, main_corpus_ctes, pre, norm, retrieval_ctes, with_,
)

ORACLE: dict = {}


def sql(name: str, text: str):
    ORACLE[name] = text.strip()


sql("preprocess_text", f"SELECT doc_id, {pre('text')} AS text FROM documents")

sql("normalize_question", f"SELECT item_id, {norm('text')} AS question FROM benchmark")

sql("chunk_text", with_(chunk_ctes("documents", "doc_id", "text", "c")) +
    " SELECT doc_id, chunk_idx, chunk_text FROM c_chunks")

sql("fit_index", with_(all_corpus_ctes("m")) +
    " SELECT doc_id, chunk_idx, term, round(weight, 9) AS weight FROM m_post")

sql("top_vocabulary", with_(all_corpus_ctes("m")) +
    " SELECT term, df, round(idf, 9) AS idf, n_docs FROM m_vocab")

sql("retrieve_chunks", with_(all_corpus_ctes("m"), retrieval_ctes("m", DEFAULT.top_k, DEFAULT.similarity_threshold)) +
    """ SELECT t.query_id, t.rank, t.score, t.doc_id, t.chunk_idx, c.chunk_text
        FROM m_top t JOIN m_chunks c ON c.doc_id = t.doc_id AND c.chunk_idx = t.chunk_idx""")

from .oracle_sql import (  # noqa: E402
    cascade_ctes, clean_context, clean_generated, dedup_ctes, format_ctes, gate_cte,
    relevance_ctes, route_ctes, strip_prompt_prefix, strip_ws, q,
)

sql("gather_context", with_(cascade_ctes()) +
    " SELECT query_id, pos, source_order, rank, score FROM ctx")

sql("gate_generated", with_(gate_cte("g")) + " SELECT query_id, answer, gate_reason FROM g_gate")

sql("check_answer_relevance", with_(cascade_ctes(), gate_cte("g")) + """
, ans AS (SELECT query_id, answer FROM g_gate WHERE query_id IN (SELECT query_id FROM ctx)),
""".rstrip() .rstrip(",") + "," + relevance_ctes("ans", "r") +
    " SELECT query_id, relevance, is_relevant FROM r_rel")

sql("route_answers", with_(route_ctes()) +
    " SELECT query_id, response, source, similarity_score, dataset_source, is_grounded FROM routed")

sql("answer_questions", with_(route_ctes(), f"""
fsrc AS (
  SELECT r.query_id AS id, r.response AS raw, {strip_ws('b.text')} AS question
  FROM routed r JOIN benchmark b ON b.item_id = r.query_id WHERE {strip_ws('b.text')} <> ''
)""", format_ctes("fsrc", "f")) + f"""
SELECT r.query_id, {strip_ws('b.text')} AS question, f.response, r.source, r.dataset_source,
       r.similarity_score, r.is_grounded
FROM routed r JOIN benchmark b ON b.item_id = r.query_id JOIN f_fmt f ON f.id = r.query_id
UNION ALL
SELECT item_id, '', {q(EMPTY_QUESTION_REPLY)}, 'uncertain', NULL, 0.0, NULL
FROM benchmark WHERE {strip_ws('text')} = ''""")

from .oracle_sql import answer_results_ctes, event_results_src, g_queries  # noqa: E402

for _n, _s in g_queries(event_results_src()).items():
    sql(_n, _s)

_ANSWERED = with_(route_ctes(), f"""
fsrc AS (
  SELECT r.query_id AS id, r.response AS raw, {strip_ws('b.text')} AS question
  FROM routed r JOIN benchmark b ON b.item_id = r.query_id WHERE {strip_ws('b.text')} <> ''
)""", format_ctes("fsrc", "f"), answer_results_ctes())

sql("evaluate_questions", _ANSWERED + " SELECT * FROM res")
sql("evaluation_summary", _ANSWERED + """ SELECT count(*) AS total_questions,
    count_if(source_used <> 'error') AS successful_responses,
    round(avg(CAST(context_retrieved AS DOUBLE)), 6) AS context_retrieval_rate,
    round(avg(similarity_score), 6) AS mean_similarity, round(avg(latency_ms), 6) AS mean_latency_ms,
    round(avg(CAST(is_grounded AS DOUBLE)), 6) AS grounding_rate FROM res""")
sql("detail_table", _ANSWERED + """ SELECT question_id, question, source_used, similarity_score,
    context_retrieved, is_grounded, latency_ms FROM res""")

from .oracle_sql import (  # noqa: E402
    STOP, TOKEN_RE, chunk_ctes as _chunk_ctes, index_ctes, qa_corpus_ctes, qa_ctes, query_ctes, score_ctes,
    token_blocks_sql, topk_cte, upload_docs_src, upload_corpus_ctes,
)

sql("dedup_first_by_question", with_(qa_ctes()) + " SELECT row_idx, question, answer FROM qa_dedup")
sql("drop_null_qa", with_(qa_ctes()) + " SELECT row_idx, question, answer FROM qa_kept")
sql("prepare_qa_corpus", with_(qa_ctes()) + " SELECT question_idx, question, answer FROM qa_proc")
sql("explode_qa_chunks", with_(qa_corpus_ctes("qa")) + """
 SELECT 'main_dataset' AS dataset, p.question_idx, c.chunk_idx, p.question, p.answer, c.chunk_text
 FROM qa_chunks c JOIN qa_proc p ON p.question_idx = c.question_idx""")
sql("explode_upload_chunks", with_(_chunk_ctes(upload_docs_src(), "doc_id", "t", "u"), """
u_tot AS (SELECT doc_id, count(*) AS total_chunks FROM u_chunks GROUP BY doc_id)""") + """
 SELECT 'uploaded_file' AS source, 'doc_' || CAST(c.doc_id AS VARCHAR) || '.txt' AS filename, c.chunk_idx,
        t.total_chunks, c.chunk_text
 FROM u_chunks c JOIN u_tot t ON t.doc_id = c.doc_id""")
sql("question_index", with_(qa_ctes(), index_ctes(
    "(SELECT question_idx, CAST(0 AS BIGINT) AS chunk_idx, question FROM qa_proc)",
    ["question_idx", "chunk_idx"], "question", "qi")) +
    " SELECT question_idx, term, round(weight, 9) AS weight FROM qi_post")
sql("retrieve_qa", with_(qa_corpus_ctes("qa"), retrieval_ctes(
    "qa", DEFAULT.top_k, DEFAULT.context_threshold,
    "(SELECT conv_id * 4294967296 + turn * 2 AS qid, text FROM conversations WHERE role = 'user')", "qid", "text",
    ("question_idx", "chunk_idx"))) + """
 SELECT t.query_id, t.rank, t.score, t.question_idx, t.chunk_idx, p.answer
 FROM qa_top t JOIN qa_proc p ON p.question_idx = t.question_idx""")

sql("tokenize", f"""SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS term FROM documents
) WHERE term NOT IN (SELECT term FROM {STOP}) GROUP BY doc_id""")
sql("term_frequency", with_(all_corpus_ctes("m")) + " SELECT doc_id, chunk_idx, term, tf FROM m_tf")
sql("transform_queries", with_(all_corpus_ctes("m"), query_ctes("benchmark", "item_id", "text", "m_vocab", "m")) +
    " SELECT query_id, term, round(qweight, 9) AS qweight FROM m_qpost")
_SC = with_(all_corpus_ctes("m"), query_ctes("benchmark", "item_id", "text", "m_vocab", "m"),
            score_ctes("m_qpost", "m_post", ["doc_id", "chunk_idx"], "m"))
sql("cosine_scores", _SC + " SELECT query_id, doc_id, chunk_idx, score FROM m_scores")
sql("threshold_filter", _SC + f" SELECT query_id, doc_id, chunk_idx, score FROM m_scores WHERE score >= {DEFAULT.context_threshold}")
sql("top_k_per_query", _SC + "," + topk_cte("m_scores", ["doc_id", "chunk_idx"], DEFAULT.top_k, DEFAULT.context_threshold, "m").lstrip() +
    " SELECT query_id, rank, score, doc_id, chunk_idx FROM m_top")
sql("best_chunk", _SC + "," + topk_cte("m_scores", ["doc_id", "chunk_idx"], 1, DEFAULT.context_threshold, "m").lstrip() +
    " SELECT query_id, score, doc_id, chunk_idx FROM m_top")
sql("select_source", with_(main_corpus_ctes("m"), upload_corpus_ctes("u"),
                           retrieval_ctes("m", DEFAULT.top_k, DEFAULT.similarity_threshold),
                           retrieval_ctes("u", DEFAULT.top_k, DEFAULT.similarity_threshold)) + """
 SELECT 'main' AS source, t.query_id, t.rank, t.score, {_pre_text} AS text FROM m_top t JOIN documents d USING (doc_id)
 UNION ALL SELECT 'uploaded', t.query_id, t.rank, t.score, c.chunk_text FROM u_top t JOIN u_chunks c ON c.doc_id = t.doc_id AND c.chunk_idx = t.chunk_idx"""
    .replace("{_pre_text}", pre("d.text")))
sql("rank_chunks", ORACLE["top_k_per_query"].replace("SELECT query_id, rank, score", "SELECT query_id, rank AS place, score"))
sql("pack_token_blocks", token_blocks_sql(128))

from ..config import (  # noqa: E402
    DATASET_SOURCE_NAMES, SOURCE_LABELS, UPLOAD_BAD_TYPE, UPLOAD_EMPTY, UPLOAD_NO_NAME, UPLOAD_TOO_LARGE,
)
from .oracle_sql import (  # noqa: E402
    UPLOADS, generated_src, joined_items, json_items, lookup_sql, pre as _pre, prompt_ctes,
)

sql("assemble_prompt", with_(cascade_ctes(), prompt_ctes()) + " SELECT query_id, prompt FROM prompts")



def _escaped(quote):
    x = "coalesce(text, '')"
    for plain, put in (("\\", "\\\\"), (quote, "\\" + quote)):
        x = f"replace({x}, {q(plain)}, {q(put)})"
    for code, put in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        x = f"replace({x}, chr({code}), {q(put)})"
    return x


_LISTS = f"""(SELECT conv_id, turn, CASE (conv_id + turn) % 8
  WHEN 0 THEN '["' || w || '", "true", "0", "", "None"]' WHEN 1 THEN '["' || w || '", null, true, 0, 2.5, false]'
  WHEN 2 THEN '[''' || v || ''', None, True, ''x'', "it''s"]' WHEN 3 THEN '["' || w || '", ["n", 1], {{"k": "v"}}, [], {{}}]'
  WHEN 4 THEN '["' || w || '", broken]' WHEN 5 THEN '["' || w || '"] and ["x"]' WHEN 6 THEN '[''' || v || ''', true]'
  ELSE 'Context 1: Question: ' || t || chr(10) || 'Answer: ' || t || chr(10) || chr(10) || chr(10) || chr(10) || 'Context 22:  end' END AS text
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t, {_escaped('"')} AS w, {_escaped("'")} AS v FROM conversations))"""
sql("parse_list_string", f"SELECT conv_id, turn, {joined_items(json_items(strip_ws('text')), 'format')} AS items FROM conversations")
sql("parse_list_typed", f"""SELECT conv_id, turn, array_to_string(list_transform({json_items('text')},
  lambda i: i.kind || '=' || i.text), '|') AS items FROM {_LISTS}""")
sql("clean_context_lists", f"SELECT conv_id, turn, {clean_context('text')} AS text FROM {_LISTS}")
sql("clean_generated_lists", f"SELECT conv_id, turn, {clean_generated('text')} AS text FROM {_LISTS}")
sql("format_answer_lists", with_(format_ctes(
    f"(SELECT conv_id * 4294967296 + turn * 2 AS id, text AS raw, 'What?' AS question FROM {_LISTS})", "f").lstrip()) +
    " SELECT id AS row_idx, response FROM f_fmt")
_MARKED = """(SELECT doc_id AS id, '- ' || w || '. ' || w || '.' || chr(10) || '```' || chr(10) || w || '.' || chr(10) || w || '.' || chr(10) ||
  '```' || chr(10) || '* ' || w || '!' || chr(10) || '  + other ' || w || '. ' || w || chr(10) || w AS t
  FROM (SELECT doc_id, text AS w FROM documents))"""
sql("dedup_sentences_marked", with_(dedup_ctes(_MARKED, "d")) + " SELECT id AS doc_id, text FROM d_out")
sql("clean_context", f"SELECT doc_id, {clean_context('text')} AS text FROM documents")
sql("clean_generated", f"SELECT conv_id, turn, {clean_generated('text')} AS text FROM conversations")
sql("strip_prompt_prefix", with_(cascade_ctes(), prompt_ctes()) +
    f" SELECT query_id, {strip_prompt_prefix('prompt', 'question')} AS text FROM prompts")
sql("dedup_sentences", with_(dedup_ctes("(SELECT doc_id AS id, text AS t FROM documents)", "d")) +
    " SELECT id AS doc_id, text FROM d_out")
sql("format_answer", with_(qa_ctes(), format_ctes("(SELECT row_idx AS id, answer AS raw, question FROM qa_raw)", "f")) +
    " SELECT id AS row_idx, response FROM f_fmt")
sql("response_preview", """SELECT doc_id, CAST(length(text) AS BIGINT) AS response_length,
  CASE WHEN length(coalesce(text, '')) > 100 THEN substring(text, 1, 100) || '...' ELSE coalesce(text, '') END AS response_preview
  FROM documents""")
sql("label_answers", with_(route_ctes()) + f""" SELECT query_id, {lookup_sql('source', SOURCE_LABELS)} AS source_label,
  CASE WHEN dataset_source IS NOT NULL AND dataset_source <> 'none'
       THEN 'From: ' || {lookup_sql('dataset_source', DATASET_SOURCE_NAMES)} END AS dataset_label,
  CASE WHEN similarity_score > 0 THEN 'Similarity: ' || printf('%.2f', similarity_score) END AS score_label
  FROM routed""")

sql("qa_csv_roundtrip", ORACLE["prepare_qa_corpus"])
sql("qa_csv_positions", """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, CAST(doc_id AS VARCHAR) AS doc_id,
  sha256('"' || text || '"') AS answer_sha256 FROM documents WHERE text IS NOT NULL""")
sql("chunks_jsonl_roundtrip", ORACLE["explode_qa_chunks"])
sql("index_roundtrip", ORACLE["fit_index"])
sql("read_eval_set", """SELECT item_id AS query_id, text AS question, 'topic_' || CAST(item_id % 6 AS VARCHAR) AS topic,
  CASE item_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'llm' END AS expected_source,
  'category_' || CAST(item_id % 2 AS VARCHAR) AS category FROM benchmark""")
_FILES = f"""(SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(strlen(text) AS BIGINT) AS size
  FROM documents WHERE source IN {UPLOADS}
  UNION ALL SELECT string_split(url, '/')[-1], CAST(strlen(html) AS BIGINT) FROM pages
  UNION ALL SELECT CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'd' || CAST(doc_id AS VARCHAR) || '.CSV' END,
    CASE doc_id % 3 WHEN 0 THEN n_chars * 1048576 WHEN 1 THEN 0 ELSE n_chars END FROM documents)"""
_SUF = "lower(regexp_extract(coalesce(filename, ''), '(\\.[^./]*)$', 1))"
_REASON = f"""CASE WHEN coalesce(filename, '') = '' THEN {q(UPLOAD_NO_NAME)}
  WHEN {_SUF} NOT IN ('.txt', '.csv', '.md', '.markdown') THEN {q(UPLOAD_BAD_TYPE)}
  WHEN size > {DEFAULT.max_upload_bytes} THEN {q(UPLOAD_TOO_LARGE)}
  WHEN size = 0 THEN {q(UPLOAD_EMPTY)} END"""
sql("validate_uploads", f"SELECT filename, size, ({_REASON}) IS NULL AS accepted, {_REASON} AS reason FROM {_FILES}")
sql("write_eval_results", _ANSWERED.replace("FROM routed r JOIN f_fmt f ON f.id = r.query_id", "FROM routed r JOIN f_fmt f ON f.id = r.query_id WHERE r.query_id % 5 <> 0") + """
 SELECT question_id, question, topic, category, context_retrieved, source_used, expected_source, source_match, similarity_score,
   answer_type, is_grounded, dataset_source, latency_ms, response_length, CASE WHEN response_preview <> '' THEN response_preview END AS response_preview,
   CASE WHEN source_used = 'error' THEN 'no answer' END AS error FROM res""")
sql("write_eval_summary", ORACLE["events_summary"])
sql("prepare_uploads", ORACLE["explode_upload_chunks"])
sql("stream_uploads", ORACLE["explode_upload_chunks"])
sql("stream_answers", ORACLE["answer_questions"])
sql("replace_upload_index", with_(
    _chunk_ctes(f"(SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, {_pre('text')} AS t "
                f"FROM documents WHERE source = 'src5')", "filename", "t", "v"),
    index_ctes("v_chunks", ["filename", "chunk_idx"], "chunk_text", "v")) +
    " SELECT filename, chunk_idx, term, round(weight, 9) AS weight FROM v_post")
sql("corpus_status", with_(qa_corpus_ctes("qa"), _chunk_ctes(
    f"(SELECT doc_id, {_pre('text')} AS t FROM documents WHERE source IN {UPLOADS})", "doc_id", "t", "u")) + """
 SELECT CASE WHEN r THEN 'ready' ELSE 'not_ready' END AS status, r AS ready, hd AS has_dataset, FALSE AS has_llm,
        hu AS has_uploaded_files, ds AS dataset_size, 'Retrieval-only' AS mode, mc AS main_chunks_count,
        uc AS uploaded_chunks_count
 FROM (SELECT *, (hd OR hu) AS r FROM (
   SELECT ds, mc, uc, ds > 0 AS hd, uc > 0 AS hu FROM (
     SELECT (SELECT count(*) FROM qa_proc) AS ds, (SELECT count(*) FROM qa_chunks) AS mc,
            (SELECT count(*) FROM u_chunks) AS uc)))""")

sql("generate_answers", with_(cascade_ctes(), prompt_ctes()) +
    " SELECT query_id, string_split(prompt, chr(10) || chr(10))[2] AS raw FROM prompts")
sql("generate_stored", ORACLE["generate_answers"])
sql("load_corpus", ORACLE["prepare_qa_corpus"])

_ODD = f"""benchmark AS (
  SELECT item_id, text FROM main.benchmark UNION ALL SELECT item_id + 1000000, NULL FROM main.benchmark
  UNION ALL SELECT item_id + 2000000, ' ' || chr(9) || ' ' FROM main.benchmark UNION ALL SELECT item_id + 3000000, reverse(text) FROM main.benchmark)"""
sql("answer_odd_questions", with_(_ODD, route_ctes("query_id < 3000000"), f"""
fsrc AS (
  SELECT r.query_id AS id, r.response AS raw, {strip_ws('b.text')} AS question
  FROM routed r JOIN benchmark b ON b.item_id = r.query_id WHERE {strip_ws('b.text')} <> ''
)""", format_ctes("fsrc", "f")) + f"""
SELECT r.query_id, {strip_ws('b.text')} AS question, f.response, r.source, r.dataset_source,
       r.similarity_score, r.is_grounded
FROM routed r JOIN benchmark b ON b.item_id = r.query_id JOIN f_fmt f ON f.id = r.query_id
UNION ALL
SELECT item_id, '', {q(EMPTY_QUESTION_REPLY)}, 'uncertain', NULL, 0.0, NULL
FROM benchmark WHERE coalesce({strip_ws('text')}, '') = ''""")
sql("route_without_index", with_(_ODD, gate_cte("g", "query_id < 3000000")) + f"""
 SELECT b.item_id AS query_id, CASE WHEN ok THEN answer ELSE {q(DEFAULT.uncertain_response)} END AS response,
   CASE WHEN ok THEN 'llm' ELSE 'uncertain' END AS source, CAST(0.0 AS DOUBLE) AS similarity_score,
   CASE WHEN ok THEN 'llm_fallback' ELSE 'none' END AS dataset_source, FALSE AS is_grounded
 FROM benchmark b LEFT JOIN (SELECT *, gate_reason IS NULL AS okay FROM g_gate) g ON g.query_id = b.item_id,
   LATERAL (SELECT coalesce(okay, FALSE) AS ok) WHERE b.text IS NOT NULL""")
sql("route_generated", with_(cascade_ctes(), prompt_ctes(), gate_cte("x"), route_ctes()[len(cascade_ctes()) + 1:]).replace(
    generated_src(), "(SELECT query_id, string_split(prompt, chr(10) || chr(10))[2] AS raw FROM prompts)") +
    " SELECT query_id, response, source, similarity_score, dataset_source, is_grounded FROM routed")
sql("corpus_job", ORACLE["retrieve_qa"])
sql("read_csv_as_text", """SELECT 'customers' || CAST(k AS VARCHAR) || '.csv' AS filename,
  CASE WHEN k % 2 = 1 THEN 'id name note ' ELSE 'id title ' END ||
  string_agg(CAST(r AS VARCHAR) || ' ' || CAST(c_custkey AS VARCHAR) || ' ' || c_name || ', "so"' || CASE WHEN k % 2 = 1 THEN ' NaN' ELSE '' END, ' ' ORDER BY r) AS text
  FROM (SELECT c_custkey // 100 AS k, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS r FROM customer) GROUP BY k""")
sql("upload_rejects", f"""SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename, {q(UPLOAD_BAD_TYPE)} AS reason
  FROM documents WHERE coalesce(source, '') IN {UPLOADS} AND doc_id % 2 = 1""")
