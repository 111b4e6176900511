"""Oracle SQL (DuckDB dialect) for the registered queries.

The SQL states each operator's semantics independently of the Spark code:
same regular expressions (RE2 forms), same stop list, same rounding.  Views
``documents``, ``benchmark``, ``conversations``, ``events`` ... are the
supplied tables.
"""

from __future__ import annotations

from ..config import ANSWER_MARK, CONTEXT_BLOCK, CONTEXT_QUESTION, DEFAULT
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..functions.text import WS_CLASS
from .fixtures import UPLOAD_SOURCES

WS = WS_CLASS
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
STOP = "(SELECT unnest([" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]) AS term)"
UPLOADS = "(" + ", ".join(f"'{s}'" for s in UPLOAD_SOURCES) + ")"
CS, OV = DEFAULT.chunk_size, DEFAULT.chunk_overlap
D = DEFAULT.score_digits


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def pre(x: str) -> str:
    """B1."""
    return f"trim(regexp_replace(CAST({x} AS VARCHAR), '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    """B2."""
    return f"lower({pre(x)})"


def chunk_ctes(src: str, key: str, txt: str, prefix: str) -> str:
    """CTEs ``{prefix}_chunks(key, chunk_idx, chunk_text)`` from
    ``src(key, txt)`` by the chunking loop (recursive CTE)."""
    win = f"substring(s.{txt}, w.e - {OV} + 1, {CS})"
    brk = f"(length(regexp_extract({win}, '(?s)^(.*[.\\n])', 1)) - 1)"
    e_next = (f"CASE WHEN w.e - {OV} + {CS} < s.n AND {brk} > {CS * 0.5} "
              f"THEN w.e - {OV} + {brk} + 1 ELSE w.e - {OV} + {CS} END")
    win0 = f"substring(s.{txt}, 1, {CS})"
    brk0 = f"(length(regexp_extract({win0}, '(?s)^(.*[.\\n])', 1)) - 1)"
    e0 = f"CASE WHEN {CS} < s.n AND {brk0} > {CS * 0.5} THEN {brk0} + 1 ELSE {CS} END"
    return f"""
{prefix}_src AS (SELECT {key} AS k, {txt}, length({txt}) AS n FROM {src}),
{prefix}_walk AS (
  SELECT s.k, 0 AS step, 0 AS st, {e0} AS e FROM {prefix}_src s WHERE s.n > {CS}
  UNION ALL
  SELECT w.k, w.step + 1, w.e - {OV}, {e_next}
  FROM {prefix}_walk w JOIN {prefix}_src s ON s.k = w.k WHERE w.e - {OV} < s.n
),
{prefix}_pieces AS (
  SELECT w.k, w.step, {strip_ws(f"substring(s.{txt}, w.st + 1, w.e - w.st)")} AS c
  FROM {prefix}_walk w JOIN {prefix}_src s ON s.k = w.k
),
{prefix}_chunks AS (
  SELECT k AS {key}, CAST(row_number() OVER (PARTITION BY k ORDER BY step) - 1 AS BIGINT) AS chunk_idx,
         c AS chunk_text
  FROM {prefix}_pieces WHERE c <> ''
  UNION ALL
  SELECT k AS {key}, CAST(0 AS BIGINT) AS chunk_idx, {txt} AS chunk_text FROM {prefix}_src WHERE n <= {CS}
)"""


def index_ctes(chunks: str, keys: list[str], txt: str, prefix: str, max_features: int = DEFAULT.max_features) -> str:
    """CTEs ``{prefix}_vocab(term, df, idf, n_docs)`` and
    ``{prefix}_post(keys..., term, weight)``."""
    k = ", ".join(keys)
    return f"""
{prefix}_tok AS (SELECT {k}, unnest(regexp_extract_all(lower({txt}), '{TOKEN_RE}')) AS term FROM {chunks}),
{prefix}_tf AS (
  SELECT {k}, term, count(*) AS tf FROM {prefix}_tok
  WHERE term NOT IN (SELECT term FROM {STOP}) GROUP BY {k}, term
),
{prefix}_stats AS (SELECT term, sum(tf) AS total, count(*) AS df FROM {prefix}_tf GROUP BY term),
{prefix}_n AS (SELECT count(*) AS n FROM {chunks}),
{prefix}_vocab AS (
  SELECT v.term, CAST(v.df AS BIGINT) AS df, ln((1.0 + n.n) / (1.0 + v.df)) + 1.0 AS idf,
         CAST(n.n AS BIGINT) AS n_docs
  FROM (SELECT term, df FROM {prefix}_stats ORDER BY total DESC, term ASC LIMIT {max_features}) v, {prefix}_n n
),
{prefix}_w AS (SELECT {k}, t.term, t.tf * v.idf AS w FROM {prefix}_tf t JOIN {prefix}_vocab v ON v.term = t.term),
{prefix}_post AS (
  SELECT {k}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS weight FROM {prefix}_w
)"""


def query_ctes(queries: str, qid: str, qtext: str, vocab: str, prefix: str) -> str:
    """CTE ``{prefix}_qpost(query_id, term, qweight)``."""
    return f"""
{prefix}_qtok AS (
  SELECT {qid} AS query_id, unnest(regexp_extract_all(lower({norm(qtext)}), '{TOKEN_RE}')) AS term FROM {queries}
),
{prefix}_qtf AS (
  SELECT query_id, term, count(*) AS tf FROM {prefix}_qtok
  WHERE term NOT IN (SELECT term FROM {STOP}) GROUP BY query_id, term
),
{prefix}_qw AS (SELECT query_id, t.term, t.tf * v.idf AS w FROM {prefix}_qtf t JOIN {vocab} v ON v.term = t.term),
{prefix}_qpost AS (
  SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qweight FROM {prefix}_qw
)"""


def score_ctes(qpost: str, post: str, keys: list[str], prefix: str) -> str:
    k = ", ".join(f"p.{c}" for c in keys)
    return f"""
{prefix}_scores AS (
  SELECT q.query_id, {k}, round(sum(q.qweight * p.weight), {D}) AS score
  FROM {qpost} q JOIN {post} p ON p.term = q.term GROUP BY q.query_id, {k}
)"""


def topk_cte(scores: str, keys: list[str], k: int, threshold: float, prefix: str) -> str:
    order = ", ".join(f"{c} DESC" for c in keys)
    return f"""
{prefix}_top AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}) AS BIGINT) AS rank
    FROM {scores} WHERE score >= {threshold}
  ) WHERE rank <= {k}
)"""


# -- corpora -----------------------------------------------------------------

def main_docs_src() -> str:
    return f"(SELECT doc_id, {pre('text')} AS t FROM documents WHERE coalesce(source, '') NOT IN {UPLOADS})"


def upload_docs_src() -> str:
    return (f"(SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, "
            f"{pre('text')} AS t FROM documents WHERE coalesce(source, '') IN {UPLOADS})")


def main_corpus_ctes(prefix: str = "m") -> str:
    return (chunk_ctes(main_docs_src(), "doc_id", "t", prefix) + "," +
            index_ctes(f"{prefix}_chunks", ["doc_id", "chunk_idx"], "chunk_text", prefix))


def all_corpus_ctes(prefix: str = "m") -> str:
    """Chunks and index of all documents."""
    src = f"(SELECT doc_id, {pre('text')} AS t FROM documents)"
    return (chunk_ctes(src, "doc_id", "t", prefix) + "," +
            index_ctes(f"{prefix}_chunks", ["doc_id", "chunk_idx"], "chunk_text", prefix))


def upload_corpus_ctes(prefix: str = "u") -> str:
    return (chunk_ctes(upload_docs_src(), "doc_id", "t", prefix) + "," +
            index_ctes(f"{prefix}_chunks", ["doc_id", "chunk_idx"], "chunk_text", prefix))


def retrieval_ctes(prefix: str, k: int, threshold: float, queries: str = "benchmark",
                   qid: str = "item_id", qtext: str = "text", keys=("doc_id", "chunk_idx")) -> str:
    """``{prefix}_top(query_id, key..., score, rank)`` of the questions
    against a corpus built by the CTEs above."""
    return (query_ctes(queries, qid, qtext, f"{prefix}_vocab", prefix) + "," +
            score_ctes(f"{prefix}_qpost", f"{prefix}_post", list(keys), prefix) + "," +
            topk_cte(f"{prefix}_scores", list(keys), k, threshold, prefix))


def with_(*ctes: str) -> str:
    body = ",".join(ctes)
    return "WITH RECURSIVE " + body.strip().lstrip(",")


# -- text post-processing (B6-B10) ----------------------------------------------

LB = r"\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def lstrip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def _typed(x: str) -> str:
    """Items (kind, text) of a JSON list text, null when it is not one.  Nested
    items are printed as Python prints them (plain strings and numbers only)."""
    _printed = "replace(replace(replace(CAST(j AS VARCHAR), '\"', chr(39)), ',', ', '), ':', ': ')"
    return f"""CASE WHEN json_valid({x}) AND json_type(CAST({x} AS JSON)) = 'ARRAY'
      THEN list_transform(CAST(CAST({x} AS JSON) AS JSON[]), lambda j: CASE coalesce(json_type(j), 'NULL')
        WHEN 'VARCHAR' THEN {{'kind': 'string', 'text': json_extract_string(j, '$')}}
        WHEN 'NULL' THEN {{'kind': 'null', 'text': 'None'}}
        WHEN 'BOOLEAN' THEN {{'kind': 'bool', 'text': CASE WHEN CAST(j AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END}}
        WHEN 'ARRAY' THEN {{'kind': 'nested', 'text': {_printed}}}
        WHEN 'OBJECT' THEN {{'kind': 'nested', 'text': {_printed}}}
        ELSE {{'kind': 'number', 'text': CAST(j AS VARCHAR)}} END) END"""


# tokens of a Python literal (RE2 form)
LITERAL_TOKEN = r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s'",\[\]{}:()]+|[\[\]{},:()]"""


def json_items(x: str) -> str:
    """Items (kind, text) of a whole-text JSON list, else of a Python list
    literal; null when the text is neither."""
    inner = "replace(replace(substring(t, 2, length(t) - 2), " + q("\\'") + ", " + q("'") + "), " + q('"') + ", " + q('\\"') + ")"
    spell = f"""CASE WHEN starts_with(t, {q("'")}) THEN '"' || {inner} || '"' WHEN t = 'None' THEN 'null' WHEN t = 'True' THEN 'true'
      WHEN t = 'False' THEN 'false' WHEN t IN ('null', 'true', 'false') THEN '!' ELSE t END"""
    python = f"array_to_string(list_transform(regexp_extract_all({x}, {q(LITERAL_TOKEN)}), lambda t: {spell}), '')"
    return f"CASE WHEN regexp_matches({x}, '(?s)^\\[.*\\]$') THEN coalesce({_typed(x)}, {_typed(python)}) END"


def joined_items(items: str, mode: str) -> str:
    kept = items
    if mode == "context":
        falsy = """(i.text = '' OR i.kind = 'null' OR (i.kind = 'bool' AND i.text = 'False')
          OR (i.kind = 'number' AND TRY_CAST(i.text AS DOUBLE) = 0) OR (i.kind = 'nested' AND i.text IN ('[]', '{}')))"""
        kept = f"list_filter({items}, lambda i: NOT {falsy})"
    texts = f"list_transform({kept}, lambda i: {strip_ws('i.text')})"
    if mode == "format":
        texts = f"list_filter({texts}, lambda x: x <> '')"
    return f"array_to_string({texts}, chr(10))"


def strip_brackets(x: str) -> str:
    return f"regexp_replace({x}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')"


def clean_context(x: str) -> str:
    """B6."""
    items = json_items(x)
    joined = joined_items(items, "context")
    listy = f"(starts_with({x}, '[') AND ends_with({x}, ']'))"
    fb = f"CASE WHEN {listy} THEN trim({strip_brackets(x)}) ELSE {x} END"
    return f"CASE WHEN {items} IS NOT NULL THEN {joined} ELSE regexp_replace({strip_ws(fb)}, '{WS}+', ' ', 'g') END"


def clean_generated(x: str) -> str:
    """B7."""
    t = strip_ws(f"CAST({x} AS VARCHAR)")
    t = f"regexp_replace({t}, '(?i)Context{WS}+\\p{{Nd}}+:{WS}*', '', 'g')"
    t = f"regexp_replace({t}, '(?i)Question:{WS}*', '', 'g')"
    t = f"regexp_replace({t}, '(?im)^Answer:{WS}*', '', 'g')"
    items = json_items(t)
    joined = joined_items(items, "llm")
    listy = f"(starts_with({t}, '[') AND ends_with({t}, ']'))"
    t2 = f"CASE WHEN {items} IS NOT NULL THEN {joined} WHEN {listy} THEN trim({strip_brackets(t)}) ELSE {t} END"
    return strip_ws(f"regexp_replace({t2}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def strip_prompt_prefix(x: str, question: str) -> str:
    """B8."""
    p = DEFAULT.prompt_prefix
    t = lstrip_ws(x)
    after = f"regexp_replace(substring({t}, {len(p) + 1}), '^[\\n :]+', '')"
    qq = strip_ws(f"coalesce(CAST({question} AS VARCHAR), '')")
    lc = lstrip_ws(after)
    cut = f"regexp_replace(substring({lc}, length({qq}) + 1), '^[\\n :]+', '')"
    handled = (f"CASE WHEN {qq} = '' THEN {after} WHEN starts_with(lower({lc}), lower({qq})) "
               f"THEN {cut} ELSE {lc} END")
    return f"CASE WHEN starts_with({t}, {q(p)}) THEN {handled} ELSE {t} END"


def dedup_ctes(src: str, prefix: str) -> str:
    """``{prefix}_out(id, text)`` from ``src(id, t)``."""
    sent_split = f"string_split(regexp_replace(body, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""
{prefix}_s AS (SELECT id, string_split_regex(coalesce(t, ''), '{LB}') AS l FROM {src}),
{prefix}_l AS (SELECT id, unnest(l) AS line, unnest(range(len(l))) AS ln FROM {prefix}_s),
{prefix}_k AS (
  SELECT id, ln, line, {strip_ws('line')} AS stripped,
         starts_with({strip_ws('line')}, '```') AS fence
  FROM {prefix}_l
),
{prefix}_p AS (
  SELECT *, (fence OR coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY id ORDER BY ln
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 OR stripped = '') AS pass
  FROM {prefix}_k
),
{prefix}_c AS (
  SELECT id, ln, regexp_extract(line, '^({WS}*)', 1) AS lead,
         CASE WHEN regexp_matches(stripped, '^[*+\\-] ') THEN substring(stripped, 1, 1) ELSE '' END AS bullet,
         CASE WHEN regexp_matches(stripped, '^[*+\\-] ') THEN {lstrip_ws('substring(stripped, 3)')} ELSE stripped END AS body
  FROM {prefix}_p WHERE NOT pass
),
{prefix}_ss AS (SELECT id, ln, lead, bullet, {sent_split} AS sl FROM {prefix}_c),
{prefix}_se AS (SELECT id, ln, lead, bullet, unnest(sl) AS sentence, unnest(range(len(sl))) AS sn FROM {prefix}_ss),
{prefix}_sn AS (
  SELECT *, lower(trim(regexp_replace(sentence, '{WS}+', ' ', 'g'))) AS norm FROM {prefix}_se
),
{prefix}_first AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY ln, sn) AS rn FROM {prefix}_sn WHERE norm <> ''
  ) WHERE rn = 1
),
{prefix}_rb AS (
  SELECT id, ln, CASE WHEN bullet <> '' THEN lead || bullet || ' ' || body ELSE lead || body END AS out
  FROM (SELECT id, ln, lead, bullet, string_agg({strip_ws('sentence')}, ' ' ORDER BY sn) AS body
        FROM {prefix}_first GROUP BY id, ln, lead, bullet)
),
{prefix}_lines AS (
  SELECT id, ln, line AS out FROM {prefix}_p WHERE pass
  UNION ALL SELECT id, ln, out FROM {prefix}_rb
),
{prefix}_txt AS (
  SELECT id, {strip_ws("string_agg(out, chr(10) ORDER BY ln)")} AS c FROM {prefix}_lines GROUP BY id
),
{prefix}_out AS (
  SELECT s.id, CASE WHEN coalesce(x.c, '') <> '' AND NOT ends_with(x.c, '```') AND right(x.c, 1) NOT IN ('.', '!', '?')
                    THEN x.c || '.' ELSE coalesce(x.c, '') END AS text
  FROM {src} s LEFT JOIN {prefix}_txt x ON x.id = s.id
)"""


def format_ctes(src: str, prefix: str) -> str:
    """``{prefix}_fmt(id, response)`` from ``src(id, raw, question)``."""
    pre_ = strip_ws(strip_prompt_prefix("raw", "question"))
    items = json_items("p")
    m = f"regexp_replace(p, '(?i)Context{WS}+\\p{{Nd}}+:{WS}*', '', 'g')"
    m = f"regexp_replace({m}, '(?im)^Answer:{WS}*', '', 'g')"
    m = f"regexp_replace({m}, '(?i)Question:{WS}*', '', 'g')"
    m = strip_ws(f"regexp_replace({m}, '\\n{{3,}}', chr(10) || chr(10), 'g')")
    return f"""
{prefix}_pre AS (SELECT id, raw IS NULL AS rawnull, {pre_} AS p FROM {src}),
{prefix}_st AS (SELECT id, rawnull, {items} AS items, {m} AS t FROM {prefix}_pre),
{prefix}_todo AS (SELECT id, t FROM {prefix}_st WHERE NOT rawnull AND items IS NULL),
{dedup_ctes(f"{prefix}_todo", f"{prefix}_d")},
{prefix}_fmt AS (
  SELECT s.id, CASE WHEN s.rawnull THEN '' WHEN s.items IS NOT NULL THEN
     {joined_items('s.items', 'format')}
     ELSE d.text END AS response
  FROM {prefix}_st s LEFT JOIN {prefix}_d_out d ON d.id = s.id
)"""


# -- answering (F1-F7) -------------------------------------------------------------

UNC = DEFAULT.uncertain_response


def generated_src() -> str:
    """Stand-in generator output ``(query_id, raw)`` (fixtures.generated_answers)."""
    return f"""(SELECT b.item_id AS query_id,
        CASE b.item_id % 4 WHEN 0 THEN b.text WHEN 1 THEN coalesce(n.text, '') WHEN 2 THEN ''
             ELSE {q(UNC)} END AS raw
      FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1)"""


def gate_cte(prefix: str = "g", only: str = "TRUE") -> str:
    """``{prefix}_gate(query_id, answer, gate_reason)``; ``only``: which
    questions have a generated row."""
    c = clean_generated("raw")
    gen = f"CASE WHEN length({strip_ws(c)}) < 10 THEN '' ELSE {c} END"
    s = strip_ws("coalesce(generated, '')")
    leak = f"(contains(lower({s}), {q(UNC.lower())}) AND length({s}) < {len(UNC) + 20})"
    return f"""
{prefix}_gen AS (SELECT query_id, {gen} AS generated FROM {generated_src()} WHERE {only}),
{prefix}_gate AS (
  SELECT query_id, {s} AS answer,
         CASE WHEN length({s}) < 5 THEN 'empty' WHEN {leak} THEN 'leak' END AS gate_reason
  FROM {prefix}_gen
)"""


def cascade_ctes() -> str:
    """Both corpora, retrieval at the context threshold with k=3, the hits
    with their texts (``hits``), and the context list (``ctx``)."""
    k = max(DEFAULT.top_k, DEFAULT.context_top_k)
    lo = min(DEFAULT.similarity_threshold, DEFAULT.context_threshold)
    return ",".join([
        main_corpus_ctes("m"), upload_corpus_ctes("u"),
        retrieval_ctes("m", k, lo), retrieval_ctes("u", k, lo),
        f"""
hits AS (
  SELECT t.query_id, t.rank, t.score, c.chunk_text AS text, 0 AS source_order
  FROM u_top t JOIN u_chunks c ON c.doc_id = t.doc_id AND c.chunk_idx = t.chunk_idx
  UNION ALL
  SELECT t.query_id, t.rank, t.score, {pre('d.text')} AS text, 1 AS source_order
  FROM m_top t JOIN documents d ON d.doc_id = t.doc_id
),
ctx AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source_order, rank) AS BIGINT) AS pos
  FROM hits WHERE rank <= {DEFAULT.context_top_k} AND score >= {DEFAULT.context_threshold}
)"""])


def relevance_ctes(answers: str, prefix: str = "r") -> str:
    """``{prefix}_rel(query_id, relevance, is_relevant)`` for
    ``answers(query_id, answer)`` against ``ctx``."""
    mf = DEFAULT.relevance_max_features
    return f"""
{prefix}_docs AS (
  SELECT query_id, 0 AS doc, {norm('answer')} AS t FROM {answers}
  WHERE query_id IN (SELECT query_id FROM ctx)
  UNION ALL
  SELECT query_id, CAST(pos AS INT) AS doc, {norm('text')} AS t FROM ctx
  WHERE query_id IN (SELECT query_id FROM {answers})
),
{prefix}_n AS (SELECT query_id, count(*) AS n FROM {prefix}_docs GROUP BY query_id),
{prefix}_tok AS (SELECT query_id, doc, unnest(regexp_extract_all(t, '{TOKEN_RE}')) AS term FROM {prefix}_docs),
{prefix}_tf AS (
  SELECT query_id, doc, term, count(*) AS tf FROM {prefix}_tok
  WHERE term NOT IN (SELECT term FROM {STOP}) GROUP BY query_id, doc, term
),
{prefix}_st AS (SELECT query_id, term, sum(tf) AS total, count(*) AS df FROM {prefix}_tf GROUP BY query_id, term),
{prefix}_v AS (
  SELECT v.query_id, v.term, ln((1.0 + n.n) / (1.0 + v.df)) + 1.0 AS idf
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, term ASC) AS r FROM {prefix}_st) v
  JOIN {prefix}_n n ON n.query_id = v.query_id WHERE v.r <= {mf}
),
{prefix}_w0 AS (
  SELECT t.query_id, t.doc, t.term, t.tf * v.idf AS w
  FROM {prefix}_tf t JOIN {prefix}_v v ON v.query_id = t.query_id AND v.term = t.term
),
{prefix}_w AS (SELECT query_id, doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, doc)) AS w FROM {prefix}_w0),
{prefix}_cos AS (
  SELECT c.query_id, c.doc, sum(c.w * a.w) AS cos
  FROM {prefix}_w c JOIN {prefix}_w a ON a.query_id = c.query_id AND a.term = c.term AND a.doc = 0
  WHERE c.doc > 0 GROUP BY c.query_id, c.doc
),
{prefix}_rel AS (
  SELECT a.query_id, round(coalesce(m.m, 0.0), {D}) AS relevance,
         round(coalesce(m.m, 0.0), {D}) >= {DEFAULT.relevance_threshold} AS is_relevant
  FROM {answers} a LEFT JOIN (SELECT query_id, max(cos) AS m FROM {prefix}_cos GROUP BY query_id) m
    ON m.query_id = a.query_id
)"""


def route_ctes(generated: str = "TRUE") -> str:
    """F6 over the benchmark questions: ``routed(query_id, response, source,
    similarity_score, dataset_source, is_grounded)``."""
    sth = DEFAULT.similarity_threshold
    strict = DEFAULT.strict_context_score
    hard = DEFAULT.hard_reject_relevance
    return ",".join([cascade_ctes(), gate_cte("g", generated), f"""
best AS (
  SELECT * FROM (
    SELECT query_id, text, score, source_order,
           row_number() OVER (PARTITION BY query_id ORDER BY source_order) AS o
    FROM hits WHERE rank = 1 AND score >= {sth}
  ) WHERE o = 1
),
rest AS (SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM best)),
ctxbest AS (SELECT query_id, max(score) AS ctx_score FROM ctx WHERE query_id IN (SELECT query_id FROM rest) GROUP BY query_id),
okans AS (
  SELECT g.query_id, g.answer FROM g_gate g JOIN ctxbest c ON c.query_id = g.query_id
  WHERE g.gate_reason IS NULL AND c.ctx_score > {strict} AND g.query_id IN (SELECT query_id FROM rest)
)""", relevance_ctes("okans", "r"), f"""
fb AS (
  SELECT r.query_id, g.answer, CASE WHEN g.query_id IS NULL THEN 'empty' ELSE g.gate_reason END AS gate_reason, c.ctx_score, l.relevance, l.is_relevant,
         (c.ctx_score IS NOT NULL AND c.ctx_score > {strict}) AS strong,
         (c.ctx_score IS NOT NULL AND c.ctx_score > {strict} AND NOT l.is_relevant AND l.relevance < {hard}) AS rejected
  FROM rest r LEFT JOIN g_gate g ON g.query_id = r.query_id
  LEFT JOIN ctxbest c ON c.query_id = r.query_id LEFT JOIN r_rel l ON l.query_id = r.query_id
),
routed AS (
  SELECT query_id, text AS response, CASE WHEN source_order = 0 THEN 'uploaded' ELSE 'dataset' END AS source,
         CAST(score AS DOUBLE) AS similarity_score,
         CASE WHEN source_order = 0 THEN 'uploaded_files' ELSE 'main_dataset' END AS dataset_source,
         TRUE AS is_grounded
  FROM best
  UNION ALL
  SELECT query_id,
         CASE WHEN gate_reason IS NOT NULL OR rejected THEN {q(UNC)} ELSE answer END,
         CASE WHEN gate_reason IS NOT NULL OR rejected THEN 'uncertain' ELSE 'llm' END,
         CAST(CASE WHEN gate_reason IS NOT NULL THEN 0.0 WHEN strong THEN relevance
                   WHEN ctx_score IS NOT NULL THEN ctx_score ELSE 0.0 END AS DOUBLE),
         CASE WHEN gate_reason IS NOT NULL THEN 'none' WHEN rejected THEN NULL ELSE 'llm_fallback' END,
         CASE WHEN gate_reason IS NULL AND strong THEN is_relevant ELSE FALSE END
  FROM fb
)"""])


# -- evaluation (G) ------------------------------------------------------------------

def event_results_src() -> str:
    """fixtures.event_results + evaluation.results_from_events."""
    return f"""(
  SELECT question_id, topic, source_used,
         CASE WHEN source_used = 'error' THEN FALSE
              ELSE (similarity_score > 0 OR source_used IN ('dataset', 'uploaded')) END AS context_retrieved,
         CASE WHEN source_used <> 'error' THEN expected_source END AS expected_source,
         CASE WHEN source_used <> 'error' THEN (expected_source IS NULL OR source_used = expected_source) END AS source_match,
         similarity_score, is_grounded, latency_ms
  FROM (
    SELECT event_id AS question_id, 'topic_' || CAST(user_id % 6 AS VARCHAR) AS topic, source_used,
           CASE event_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'llm' END AS expected_source,
           CAST(CASE WHEN source_used = 'error' THEN NULL ELSE round(value - floor(value), 6) END AS DOUBLE) AS similarity_score,
           CASE WHEN source_used = 'error' THEN NULL ELSE user_id % 2 = 0 END AS is_grounded,
           CAST(CASE WHEN source_used = 'error' THEN NULL ELSE value END AS DOUBLE) AS latency_ms
    FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 'dataset' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'llm' WHEN 3 THEN 'uncertain'
                 WHEN 4 THEN 'dataset' WHEN 5 THEN event_type ELSE 'error' END AS source_used FROM events)
  )
)"""


def stats_sql(col: str) -> str:
    return (f"round(avg({col}), 6) AS mean, round(quantile_cont({col}, 0.5), 6) AS median, "
            f"round(min({col}), 6) AS min, round(max({col}), 6) AS max, round(stddev_samp({col}), 6) AS std")


def g_queries(src: str) -> dict:
    return {
        "totals_error_rate": f"""SELECT count(*) AS total_questions, count_if(source_used <> 'error') AS successful_responses,
            round((count(*) - count_if(source_used <> 'error')) * 100.0 / count(*), 6) AS error_rate_pct FROM {src}""",
        "source_distribution": f"""SELECT source_used, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct
            FROM (SELECT source_used, count(*) AS n FROM {src} GROUP BY source_used)""",
        "context_rate": f"""SELECT count_if(context_retrieved) AS with_context,
            round(count_if(context_retrieved) * 100.0 / count(*), 6) AS pct FROM {src}""",
        "similarity_stats": f"SELECT count(*) AS n, {stats_sql('similarity_score')} FROM {src} WHERE similarity_score > 0",
        "source_accuracy": f"""SELECT count_if(source_match) AS matches, count_if(expected_source IS NOT NULL) AS expected,
            CASE WHEN count_if(expected_source IS NOT NULL) > 0
                 THEN round(count_if(source_match) * 100.0 / count_if(expected_source IS NOT NULL), 6) END AS accuracy_pct
            FROM {src}""",
        "grounding_rate": f"""SELECT count_if(is_grounded) AS grounded, round(count_if(is_grounded) * 100.0 / count(*), 6) AS grounded_pct,
            count(*) - count_if(is_grounded) AS fallback,
            round((count(*) - count_if(is_grounded)) * 100.0 / count(*), 6) AS fallback_pct FROM {src}""",
        "latency_stats": f"SELECT count(*) AS n, {stats_sql('latency_ms')} FROM {src} WHERE latency_ms IS NOT NULL",
        "latency_by_source": f"""SELECT source_used, count(*) AS n, round(avg(latency_ms), 6) AS mean,
            round(quantile_cont(latency_ms, 0.5), 6) AS median
            FROM {src} WHERE source_used <> 'error' AND latency_ms IS NOT NULL GROUP BY source_used""",
        "topic_breakdown": f"""SELECT topic, source_used, count(*) AS n, FALSE AS topic_total FROM {src} GROUP BY topic, source_used
            UNION ALL SELECT topic, NULL, count(*), TRUE FROM {src} GROUP BY topic""",
        "events_summary": f"""SELECT count(*) AS total_questions, count_if(source_used <> 'error') AS successful_responses,
            round(avg(CAST(context_retrieved AS DOUBLE)), 6) AS context_retrieval_rate,
            round(avg(similarity_score), 6) AS mean_similarity, round(avg(latency_ms), 6) AS mean_latency_ms,
            round(avg(CAST(is_grounded AS DOUBLE)), 6) AS grounding_rate FROM {src}""",
        "dataset_hit_accuracy": f"""SELECT count_if(expected_source = 'dataset' AND source_used = 'dataset') AS hits,
            count_if(expected_source = 'dataset') AS expected,
            coalesce(CASE WHEN count_if(expected_source = 'dataset') > 0 THEN
              round(count_if(expected_source = 'dataset' AND source_used = 'dataset') * 100.0 / count_if(expected_source = 'dataset'), 6) END, 0.0) AS accuracy_pct,
            round_even(min(latency_ms), 1) AS min_ms, round_even(avg(latency_ms), 1) AS avg_ms,
            round_even(max(latency_ms), 1) AS max_ms FROM {src}""",
    }


def answer_results_ctes() -> str:
    """G1 over F7: ``res`` with the 15 result columns."""
    return f"""
aq AS (
  SELECT r.query_id, f.response, r.source, r.dataset_source, r.similarity_score, r.is_grounded
  FROM routed r JOIN f_fmt f ON f.id = r.query_id
),
res AS (
  SELECT b.item_id AS question_id, b.text AS question, 'topic_' || CAST(b.item_id % 6 AS VARCHAR) AS topic,
         'category_' || CAST(b.item_id % 2 AS VARCHAR) AS category,
         CASE WHEN a.source IS NOT NULL THEN (a.similarity_score > 0 OR a.source IN ('dataset', 'uploaded')) ELSE FALSE END AS context_retrieved,
         coalesce(a.source, 'error') AS source_used,
         CASE WHEN a.source IS NOT NULL THEN CASE b.item_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'llm' END END AS expected_source,
         CASE WHEN a.source IS NOT NULL THEN (CASE b.item_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'llm' END IS NULL
              OR a.source = CASE b.item_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'llm' END) END AS source_match,
         CAST(a.similarity_score AS DOUBLE) AS similarity_score,
         CASE WHEN a.source IS NOT NULL THEN CASE WHEN a.is_grounded THEN 'grounded' ELSE 'fallback' END END AS answer_type,
         CASE WHEN a.source IS NOT NULL THEN coalesce(a.is_grounded, FALSE) END AS is_grounded,
         a.dataset_source, CAST(NULL AS DOUBLE) AS latency_ms,
         CASE WHEN a.source IS NOT NULL THEN CAST(length(coalesce(a.response, '')) AS BIGINT) END AS response_length,
         CASE WHEN a.source IS NOT NULL THEN CASE WHEN length(coalesce(a.response, '')) > 100
              THEN substring(a.response, 1, 100) || '...' ELSE coalesce(a.response, '') END END AS response_preview
  FROM benchmark b LEFT JOIN aq a ON a.query_id = b.item_id
)"""


# -- Q&A corpus ---------------------------------------------------------------------

def qa_ctes() -> str:
    """``qa_raw(row_idx, question, answer)``, ``qa_dedup``, ``qa_kept``,
    ``qa_proc(question_idx, question, answer)``."""
    return f"""
qa_turns AS (
  SELECT c.conv_id, c.turn, c.role, c.text, n.role AS next_role, n.text AS next_text
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
),
qa_q AS (
  SELECT CAST(conv_id * 4294967296 + turn * 2 AS BIGINT) AS row_idx, text AS question,
         CASE WHEN next_role = 'assistant' THEN next_text END AS answer
  FROM qa_turns WHERE role = 'user'
),
qa_raw AS (SELECT * FROM qa_q UNION ALL SELECT row_idx + 1, question, question FROM qa_q),
qa_dedup AS (
  SELECT row_idx, question, answer FROM (
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY row_idx) AS rn FROM qa_raw
  ) WHERE rn = 1
),
qa_kept AS (SELECT * FROM qa_dedup WHERE question IS NOT NULL AND answer IS NOT NULL),
qa_proc AS (SELECT row_idx AS question_idx, {norm('question')} AS question, {pre('answer')} AS answer FROM qa_kept)"""


def qa_corpus_ctes(prefix: str = "qa") -> str:
    return (qa_ctes() + "," + chunk_ctes("(SELECT question_idx, answer AS t FROM qa_proc)", "question_idx", "t", prefix)
            + "," + index_ctes(f"{prefix}_chunks", ["question_idx", "chunk_idx"], "chunk_text", prefix))


def token_blocks_sql(block: int = 128) -> str:
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_RE}') AS toks FROM documents),
o AS (SELECT doc_id, toks, coalesce(sum(len(toks)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t),
e AS (SELECT off, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM o),
b AS (SELECT CAST((off + pos) // {block} AS BIGINT) AS block_id, string_agg(token, ' ' ORDER BY off + pos) AS text,
             count(*) AS n FROM e GROUP BY 1)
SELECT block_id, text FROM b WHERE n = {block}"""


def prompt_ctes() -> str:
    """``prompts(query_id, question, prompt)`` (F2) after :func:`cascade_ctes`."""
    p = DEFAULT.prompt_prefix
    return f"""
cc AS (SELECT query_id, pos, {clean_context('text')} AS c FROM ctx WHERE pos <= {DEFAULT.context_top_k}),
blocks AS (
  SELECT query_id, string_agg({q(CONTEXT_BLOCK)} || c, chr(10) || chr(10) ORDER BY pos) AS context
  FROM cc WHERE c <> '' GROUP BY query_id
),
prompts AS (
  SELECT b.item_id AS query_id, b.text AS question,
         CASE WHEN k.context IS NOT NULL
              THEN {q(p)} || chr(10) || chr(10) || k.context || chr(10) || chr(10) || {q(CONTEXT_QUESTION)} || b.text || chr(10) || chr(10) || {q(ANSWER_MARK)}
              ELSE {q(p)} || chr(10) || chr(10) || b.text || chr(10) || chr(10) || {q(ANSWER_MARK)} END AS prompt
  FROM benchmark b LEFT JOIN blocks k ON k.query_id = b.item_id
)"""


def lookup_sql(x: str, mapping: dict) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {x} {cases} END, {x})"
