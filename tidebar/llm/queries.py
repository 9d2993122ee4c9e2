"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tidebar.llm.ann import op6_nearest
from tidebar.llm.html import op9_main_text
from tidebar.llm.importance import op11_importance
from tidebar.llm.licenses import op3_license_scan
from tidebar.llm.mixing import op5_mix_sources
from tidebar.llm.neardup import op8_near_duplicates
from tidebar.llm.negatives import op12_hard_negatives
from tidebar.llm.passages import op13_repeated_passages
from tidebar.llm.pii import op2_pseudonyms
from tidebar.llm.quality import op10_quality_rules
from tidebar.llm.tokens import op4_byte_bpe, op7_token_files
from tidebar.llm.urls import op1_url_verdicts

QUERIES = {
    "op1_url_verdicts": op1_url_verdicts,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mix_sources": op5_mix_sources,
    "op6_nearest": op6_nearest,
    "op7_token_files": op7_token_files,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_main_text": op9_main_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance": op11_importance,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_repeated_passages": op13_repeated_passages,
}

#: Left out: iteration until convergence (1), keyed permutations (2), fuzzy matching (3), tokenizers (4, 7), approximate search (6), HTML (9)
#: and the hash of the n-grams (10) aren't in SQL; tests hold those queries against brute force.
SQL: dict[str, str] = {
    "op5_mix_sources": r"""
WITH sizes AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
filled AS (
  SELECT *, cap / weight AS level,
    ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill
  FROM weighed),
chosen AS (SELECT coalesce((SELECT fill FROM filled WHERE level > fill ORDER BY level, place LIMIT 1), (SELECT max(level) FROM filled)) AS water),
targets AS (
  SELECT source, source_size, least(cap, water * weight) AS target,
    CASE WHEN source_size > 0 THEN least(cap, water * weight) / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM filled, chosen),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST, text) AS i FROM sizes)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CAST((floor(r.i * t.rate + t.u) - floor((r.i - 1) * t.rate + t.u)) * r.size AS BIGINT) AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
""",
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
""",
    "op11_importance": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
qw AS (SELECT unnest(ws) AS w FROM q),
crc AS (
  SELECT w, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 10000 AS INTEGER) AS b
  FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
raw AS (SELECT b, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY b),
wanted AS (SELECT b, count(*) AS t FROM qw JOIN crc USING (w) GROUP BY b),
sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM qw)::DOUBLE AS t_all),
gain AS (
  SELECT raw.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS g
  FROM raw LEFT JOIN wanted ON raw.b = wanted.b, sums),
mean AS (SELECT doc_id, CAST(floor(sum(g) / count(*)) AS BIGINT) AS m FROM dw JOIN crc USING (w) JOIN gain ON crc.b = gain.b GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(m, 0) AS weight,
    coalesce(m, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20)
SELECT doc_id, n_words AS n_features, weight, score, CASE WHEN r <= (10 * (SELECT count(*) FROM ranked)) // 100 THEN r END AS rank, n_words
FROM scored LEFT JOIN ranked USING (doc_id)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS INTEGER) AS positive_rank
  FROM pairs WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM near JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
    "op13_repeated_passages": r"""
WITH w AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT d, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda k: array_to_string(ws[k:k + 34], ' '))) AS t FROM w WHERE len(ws) >= 35),
twice AS (SELECT t FROM win GROUP BY t HAVING count(*) >= 2),
hit AS (SELECT d, i FROM win JOIN twice USING (t)),
each AS (SELECT d, doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
marked AS (
  SELECT d, doc_id, i, x, max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY each.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM each LEFT JOIN hit USING (d, i)),
left_ AS (SELECT d, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN x END, ' ' ORDER BY i) AS kept FROM marked GROUP BY d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (d)
""",
}
