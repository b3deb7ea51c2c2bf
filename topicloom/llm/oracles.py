"""The results of the queries in plain SQL, for the checks that compare both engines.

Written without the operators' methods: all windows, shingles and pairs are spelled out and joined, and
components are the transitive closure. What a trained model, random rounding or a tokenizer decides is not
expressible and has no twin.
"""

from __future__ import annotations

import string

from topicloom.llm import filter_audit

LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACED = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

# from links(a, b) between ids of nodes(id): the smallest id that each can reach
CLOSURE = """
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
smallest AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {SPACED}) AS w FROM documents),
nodes AS (SELECT doc_id AS id FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s
           WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),{CLOSURE}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM smallest LEFT JOIN sizes ON doc_id = id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM places),
again AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
dropped AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(dropped.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN dropped USING (doc_id)
"""

_FIVE_BITS = " + ".join(f"{16 >> k} * (substr(bits, 5 * i + {k + 1}, 1) = '1')::INTEGER" for k in range(5))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
             (unhex(sha1(html))::BIT)::VARCHAR AS bits FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{string.ascii_uppercase}234567', 1 + {_FIVE_BITS}, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""

EMBEDDING_PAIRS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
sound AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.9),{CLOSURE},
degree AS (SELECT a AS id, count(*) AS n FROM ways GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM smallest LEFT JOIN degree USING (id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {PLAIN}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), {PLAIN}) AS w FROM benchmark),
item_places AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM item_places),
sizes AS (SELECT DISTINCT n FROM item_windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
windows AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM places),
found AS MATERIALIZED (SELECT doc_id, item_id, i, n FROM windows JOIN item_windows USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES = {
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op4_warc": WARC,
    "op6_embedding_pairs": EMBEDDING_PAIRS,
    "op7_decontamination": DECONTAMINATION,
    "op11_filter_audit": filter_audit.SQL,
}
