"""DuckDB SQL of the operators that SQL can state."""

from __future__ import annotations

import string

from . import jaccard, licenses, suffix, topk


def top_k() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {topk.K}"""


def license_scan() -> str:
    grams: dict[str, list[str]] = {}
    for name, text in licenses.TEMPLATES.items():
        w = licenses.normal_words(text)
        grams[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
    held = ", ".join(f"('{n}', {g})" for n, g in grams.items())
    probes = ", ".join(f"('{n}', {words}, {size}, '{gram}', {place})" for n, words, size, gram, place in licenses.index(licenses.TEMPLATES, licenses.DICE))
    return f"""
WITH g(license, grams) AS (VALUES {held}), p(license, t_words, t_size, bigram, place) AS (VALUES {probes}),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT doc_id, words, unnest(range(len(words) - 1)) AS i FROM d WHERE len(words) > 1),
m AS (SELECT DISTINCT doc_id, words, license, t_words, t_size, greatest(i - place, 0) AS f, least(i - place + t_words, len(words)) AS t FROM b JOIN p ON p.bigram = words[i + 1] || ' ' || words[i + 2]),
o AS (SELECT *, list_distinct(list_transform(range(f, t - 1), lambda k: words[k + 1] || ' ' || words[k + 2])) AS own FROM m),
h AS (SELECT doc_id, license, t_words, f, t, len(list_intersect(own, grams)) AS shared, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + t_size) AS dice FROM o JOIN g USING (license)),
k AS (SELECT * FROM h WHERE dice >= {licenses.DICE})
SELECT doc_id, license, CAST(f AS INT) AS start_word, CAST(t - f AS INT) AS n_words, CAST(shared AS INT) AS shared, dice FROM k
WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.doc_id = k.doc_id AND x.license = k.license AND abs(x.f - k.f) < k.t_words AND (x.dice > k.dice OR x.dice = k.dice AND (x.f < k.f OR x.f = k.f AND x.t > k.t)))"""


def suffix_dedup() -> str:
    """Every window of 100 bytes, as hexadecimal digits; those that are not the first of their equals go, and what they cover together."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * suffix.LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - {suffix.LENGTH - 1}))) AS i FROM d)),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1)),
r AS (SELECT doc_id, i, sum(CASE WHEN i - before <= {suffix.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {suffix.LENGTH} AS b FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM runs),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS t FROM runs GROUP BY doc_id),
parts AS (SELECT doc_id, a AS place, substr(h, 2 * f + 1, 2 * (a - f)) AS p FROM gaps JOIN d USING (doc_id) UNION ALL SELECT doc_id, length(h) AS place, substr(h, 2 * coalesce(t, 0) + 1) AS p FROM d LEFT JOIN sums USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(p, '' ORDER BY place))) AS kept_sha256 FROM parts GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""


def jaccard_join() -> str:
    """Sets of shingles as lists, links by counts of what two sets share, and what is reachable by them."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    k = jaccard.SHINGLE
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(len(words) - {k - 1}), lambda i: array_to_string(words[i + 1 : i + {k}], ' '))) END AS held FROM w),
n AS (SELECT doc_id, len(held) AS n, CASE WHEN len(held) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(held)) END AS class_id FROM s),
t AS (SELECT doc_id, unnest(held) AS shingle FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {jaccard.PERCENT} * (p.n + q.n - shared)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, root FROM reach JOIN links ON a = doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id, class_id FROM n JOIN reach USING (doc_id) GROUP BY doc_id, n, class_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup(), "op3_jaccard_join": jaccard_join(), "op4_license_scan": license_scan(), "op7_exact_topk": top_k()}
