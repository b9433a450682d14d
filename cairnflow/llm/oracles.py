"""DuckDB SQL for the operators that SQL can express: the same rows by plain joins over all sequences."""

from __future__ import annotations

from cairnflow.llm.divergence import TERM
from cairnflow.llm.urlfilter import LOWER, UPPER

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = _WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")


def repeated_bytes(size: int = 400) -> str:
    """What is left of every text's bytes without the strings of ``size`` bytes that start more than once."""
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * size})) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {size - 1})) AS i FROM texts)),
again AS (SELECT r, i FROM starts SEMI JOIN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1) USING (m)),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {size} THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT r, min(i) AS a, max(i) + {size} AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
cut AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS rest, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * rest + 1), h))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)"""


def near_duplicates(percent: int = 85) -> str:
    """Groups of documents linked by the overlap of their sets of five-word shingles."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, len(s) AS k, array_to_string(s, ' ') AS s
  FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(k || s, '\x1f' ORDER BY k, s)) AS m FROM shingles GROUP BY doc_id),
classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY m) AS class_id FROM sizes),
own AS MATERIALIZED (SELECT * FROM shingles SEMI JOIN (SELECT DISTINCT class_id AS doc_id FROM classes) USING (doc_id)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM own a JOIN own b ON a.k = b.k AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(node, root) AS (SELECT DISTINCT class_id, class_id FROM classes UNION SELECT w.b, r.root FROM reached r JOIN ways w ON w.a = r.node WHERE r.root < w.b),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN roots ON node = class_id"""


def contained(percent: int = 80) -> str:
    """Benchmark items with enough of their shingles in a document; shorter ones are looked for as sequences."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_LOWERED} AS w FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT row_number() OVER () AS q, item_id, w, least(5, len(w)) AS k FROM (SELECT DISTINCT item_id, text, {_LOWERED} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
wanted AS MATERIALIZED (SELECT DISTINCT q, item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT q, item_id, count(*) AS n FROM wanted GROUP BY q, item_id),
held AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
found AS (SELECT doc_id, item_id, q, r, count(*) AS c FROM wanted JOIN held USING (k, s) GROUP BY ALL)
SELECT DISTINCT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM found JOIN sizes USING (q, item_id) WHERE 100 * c >= {percent} * n"""


def repeated_words(size: int = 20) -> str:
    """What is left of every text's words without the windows of ``size`` words that also start earlier."""
    words = _WORDS.format("coalesce(text, '')")
    return f"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {words} AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS m FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS i FROM texts)),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY m ORDER BY r, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + unnest(range(0, {size})) AS i FROM later),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""


def nearest(k: int = 5, every: int = 50) -> str:
    """The exact nearest vectors, which the tree finds for certain while it has one leaf (below 800 vectors)."""
    return f"""
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= {k}"""


def divergences(least: int = 3, top: int = 200) -> str:
    """Sources against each other and terms against their language, over the whole grid of sources and kept terms."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    share = "1 + (1000000000::HUGEINT * (n + 1)) // ({} + v)"
    f = "((p - q) * (p - q)) // q"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS w FROM documents),
terms AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
whole AS (SELECT lang, term, {share.format("total")} AS q FROM kept JOIN sizes USING (lang)),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL),
grid AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS MATERIALIZED (SELECT lang, source, term, n, {share.format("sum(n) OVER (PARTITION BY lang, source)")} AS p FROM grid JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(value), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum({f}) AS value FROM shares x JOIN (SELECT lang, source, term, p AS q FROM shares) y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  GROUP BY ALL),
marked AS (SELECT lang, source, 'term' AS part, term AS item, {f} AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked))
WHERE part = 'pair' OR rank <= {top}"""


def hard_negatives(k: int = 5, least: int = 80) -> str:
    """Positives and negatives of every hundredth vector by all inner products of integers."""
    return f"""
WITH sound AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scores WHERE same) WHERE place <= {k}),
found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND {least} * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT * FROM found WHERE rank <= {k}"""
