"""DuckDB SQL for the queries that SQL can express whole."""

from .queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS

_SPACE_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents),
t AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
      WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM t),
n AS (SELECT t.doc_id, count(g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.a = n.doc_id
"""

_GIVEN = ", ".join(f"('{s}', {w!r})" for s, w in MIX_WEIGHTS.items())
MIXING = f"""
WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
g AS (SELECT c.s, c.n, v.w FROM c LEFT JOIN (VALUES {_GIVEN}) v(s, w) ON v.s = c.s),
t AS (SELECT sum(n) AS all_rows, coalesce(sum(w), 0) AS given, sum(n) FILTER (w IS NULL) AS others FROM g),
r AS (SELECT s, {MIX_EPOCHS!r} * all_rows / n * CASE WHEN w IS NOT NULL THEN w / CASE WHEN others IS NULL THEN given ELSE 1 END
      ELSE n * ((1 - given) / others) END AS rate FROM g, t),
k AS (SELECT s, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate)) + 31)::INT)) AS k FROM r),
cdf AS (SELECT s, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM k),
lists AS (SELECT s, list(c) AS cs FROM cdf GROUP BY 1),
o AS (SELECT *, ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' ||
      row_number() OVER (PARTITION BY coalesce(doc_id::VARCHAR, ''), coalesce(text, ''), coalesce(source, ''))::VARCHAR AS who FROM documents),
d AS (SELECT doc_id, source, text, rate, cs, who, ('0x' || substr(md5('{MIX_SEED}' || who), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
      FROM o JOIN r ON r.s = coalesce(source, '') JOIN lists USING (s)),
e AS (SELECT *, len(list_filter(cs, lambda x: x <= u)) AS n_copies FROM d),
f AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM e)
SELECT doc_id, source, text, rate AS mean_rate, n_copies, copy,
  ('0x' || substr(md5('{MIX_SEED + 1}' || who || ':' || copy::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)!r} AS order_key FROM f
"""

SUBSTRINGS = f"""
WITH t AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i, w FROM t),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM s),
again AS (SELECT g FROM h GROUP BY 1 HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h WHERE g IN (SELECT g FROM again)),
gone AS (SELECT doc_id, list(j) AS js FROM cover GROUP BY 1)
SELECT doc_id, len(coalesce(w, [])) AS n_words, len(coalesce(js, [])) AS n_removed,
  sha256(array_to_string(list_filter(coalesce(w, []), lambda x, k: NOT list_contains(coalesce(js, []), k)), ' ')) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9])
      WHEN len(w) > 0 THEN [w] ELSE [] END) AS x FROM b),
n AS (SELECT DISTINCT len(x) AS n FROM q),
s AS (SELECT doc_id, n, w, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, n),
o AS (SELECT doc_id, i, n, w[i:i + n - 1] AS x FROM s),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM o JOIN q USING (x)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1),
dw AS (SELECT doc_id, w[i] AS term, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT term, count(*) AS f FROM dw GROUP BY 1),
wins AS (SELECT item_id, x, row_number() OVER () AS wid FROM q),
kinds AS (SELECT wid, item_id, x[p] AS term, min(p) AS p, count(*) AS often FROM (SELECT wid, item_id, x, unnest(range(1, len(x) + 1)) AS p FROM wins) GROUP BY 1, 2, 3),
rare AS (SELECT kinds.*, row_number() OVER (PARTITION BY wid ORDER BY coalesce(f, 0), p) AS r, count(*) OVER (PARTITION BY wid) AS n FROM kinds LEFT JOIN f USING (term)),
asks AS (SELECT wid, item_id, list(struct_pack(t := term, o := CASE WHEN n < 3 THEN often ELSE 1 END) ORDER BY r) AS l FROM rare WHERE r <= 3 GROUP BY 1, 2),
ask AS (SELECT l, row_number() OVER () AS a FROM (SELECT DISTINCT l FROM asks)),
c AS (SELECT a, doc_id, i AS p, l FROM ask JOIN dw ON dw.term = l[1].t),
have AS (SELECT a, c.doc_id, p, len(l) AS n, k.t, k.o FROM (SELECT *, unnest(l) AS k FROM c) c JOIN dw ON dw.doc_id = c.doc_id AND dw.term = k.t AND dw.i BETWEEN p - 20 AND p + 20
         GROUP BY a, c.doc_id, p, len(l), k.t, k.o HAVING count(*) >= k.o),
close AS (SELECT DISTINCT a, doc_id FROM (SELECT a, doc_id, p FROM have GROUP BY a, doc_id, p, n HAVING count(*) = n)),
nr AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS near_ids FROM (
       SELECT DISTINCT doc_id, item_id FROM close JOIN ask USING (a) JOIN asks ON asks.l = ask.l) GROUP BY 1)
SELECT doc_id, len(coalesce(w, [])) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
      regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT page_id, max(struct_pack(n := length(h) + length(q), hn := length(h), rule := h || q, v := v)) AS m
      FROM p JOIN (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')) k(h, q, v)
      ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q) GROUP BY 1)
SELECT p.page_id, host, path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

# a byte, then seven zeros, for every character: xor it in, then shift one bit at a time
_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({x}::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"""
CONVERSATIONS = f"""
WITH t AS (SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
      len({_SPACE_WORDS.replace("text", "coalesce(text, '')")}) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(d := d, w := w) ORDER BY turn NULLS FIRST, d) AS t FROM t GROUP BY 1),
h AS (SELECT conv_id, t, conv_id - conv_id % 20 AS base, xor({_CRC32.format(x="conv_id")}, 4294967295) % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
m AS (SELECT conv_id, depth, size, md5(array_to_string(list_transform(t[1:depth], lambda x: x.d), '')) AS k,
      CASE WHEN depth = 0 THEN 0 ELSE t[depth].w END AS w, CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(t[1:depth - 1], lambda x: x.d), '')) END AS up FROM p),
n AS (SELECT k, depth, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS c, count(*) AS n,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = size), '')) AS e FROM m GROUP BY 1, 2),
kids AS (SELECT up AS k, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
s AS (SELECT a.k, count(*) FILTER (v.kids = 0) AS leaves, sum((v.n - 1) * v.w) AS saved FROM f v JOIN m a ON a.conv_id = v.c AND a.depth <= v.depth GROUP BY 1)
SELECT f.c AS conv_id, f.depth, q.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves AS n_leaves,
  s.saved::BIGINT AS saved_tokens, f.e AS ends_sha256 FROM f JOIN s USING (k) LEFT JOIN f q ON q.k = f.up
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
t AS (SELECT r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
z AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM t),
i AS (SELECT DISTINCT item_id, unnest({_ALNUM_WORDS}) AS term FROM benchmark),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
q AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, z GROUP BY 1),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // words AS m FROM t, z),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN q USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 50
"""

EXACT = r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g') AS x FROM documents),
b AS (SELECT doc_id, x, r, first_value(r) OVER g AS best, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM n
      WINDOW g AS (PARTITION BY x ORDER BY chars DESC, doc_id, r))
SELECT doc_id, keep_id, group_size, r = best AS kept, sha256(x) AS text_sha256 FROM b
"""

ORACLE = {
    "op1_minhash_near_dedup": NEAR_DEDUP, "op2_poisson_mixing": MIXING, "op6_substring_dedup": SUBSTRINGS,
    "op7_benchmark_decontamination": DECONTAMINATION, "op9_url_filter": URLS,
    "op11_conversation_trie": CONVERSATIONS, "op12_ranked_search": RANKED, "op13_exact_dedup": EXACT,
}
