"""Queries of this subpackage and, where SQL can say the same, their SQL.

``base_opN`` is ``opN`` without the columns that a learned model, a sketch or a hash makes; DuckDB gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ann_search import op10_additive_quantisation
from .chat import op13_chat_examples
from .decontaminate import op9_latent_decontamination
from .divergence import op12_source_divergence
from .hard_negatives import op11_hard_negatives
from .language_id import op4_language_id, page_language_id
from .licences import PHRASES, op8_licence_templates
from .lm_scoring import op5_lm_scoring
from .mixing import op7_source_mixing
from .ngram_join import op6_ngram_jaccard_join
from .pii import op3_pii
from .quality import op1_quality_fm
from .url_filter import RULES, op2_url_filter

_ALL = (
    op1_quality_fm, op2_url_filter, op3_pii, op4_language_id, op5_lm_scoring, op6_ngram_jaccard_join, op7_source_mixing,
    op8_licence_templates, op9_latent_decontamination, op10_additive_quantisation, op11_hard_negatives, op12_source_divergence,
    op13_chat_examples, page_language_id,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {}


def _base(name: str, of, sql: str, *columns) -> None:
    def query(spark, sf_dir: str) -> DataFrame:
        return of(spark, sf_dir).selectExpr(*columns)

    query.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = query, sql


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
#: CRC-32 of the id as text, a bit at a time: -1 in the list stands for one shift.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"
_HELD = lambda folds, fold: f"coalesce({_CRC} % {folds} = {fold}, false)"

_base("base_op1", op1_quality_fm, f"SELECT doc_id, {_HELD(3, 1)} AS held_out FROM documents", "doc_id", "held_out")

_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = "(VALUES " + ", ".join(f"('{what}', '{host}', '{path}')" for what, host, path in RULES) + ") AS r(what, h, p)"
_base(
    "base_op2", op2_url_filter,
    f"WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) SELECT page_id, host, path, (SELECT arg_max(h || p, length(h || p)) FROM {_RULES} WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM u",
    "page_id", "host", "path", "rule",
)

_DIGITS = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS('m')}) + 1), lambda i: CASE WHEN (length({_DIGITS('m')}) - i) % 2 = 0 THEN substr({_DIGITS('m')}, i, 1)::INT ELSE substr({_DIGITS('m')}, i, 1)::INT * 2 - CASE WHEN substr({_DIGITS('m')}, i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MATCHES = lambda pattern, keeps: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}'), lambda m: {keeps}))::BIGINT"
_base(
    "base_op3", op3_pii,
    rf"""SELECT doc_id, {_MATCHES(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')} AS n_email, {_MATCHES(r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast(p AS HUGEINT) > 255)) = 0")} AS n_ip,
 {_MATCHES(r'[0-9](?:[\x20-]?[0-9])+', f"length({_DIGITS('m')}) BETWEEN 13 AND 19 AND {_LUHN}")} AS n_card, {_MATCHES(r'\+[0-9][\x20().0-9-]+[0-9]', f"length({_DIGITS('m')}) BETWEEN 9 AND 15")} AS n_phone FROM documents""",
    "doc_id", "n_email", "n_ip", "n_card", "n_phone",
)

_base(
    "base_op5", op5_lm_scoring,
    f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_HELD(7, 2)} AS held_out, list_append(regexp_extract_all({_LOW}, '{_WORD}'), chr(10)) AS w FROM documents), t AS (SELECT k, held_out, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
 s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c), r AS (SELECT k, count(*) AS n_tokens, count(c)::BIGINT AS n_known, sum(log10((coalesce(c, 0) + 1) / ((SELECT n FROM s) + (SELECT v FROM s) + 1))) AS base FROM t LEFT JOIN c USING (w) GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM s) AS train_tokens, round(base, 4) AS base_score FROM d JOIN r USING (k)""",
    "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) AS base_score",
)

_base(
    "base_op6", op6_ngram_jaccard_join,
    f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents), s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s), f AS MATERIALIZED (SELECT * FROM e WHERE g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1)),
 l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 r AS (SELECT a AS id, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b), m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM s LEFT JOIN m ON m.id = s.doc_id""",
    "doc_id", "n_shingles", "component_id",
)

_base(
    "base_op7", op7_source_mixing,
    rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
 l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "doc_id", "size", "source_size", "round(target, 3) AS target",
)

_PLACES = lambda phrase: "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(
    f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())
) + ")"
_base(
    "base_op8", op8_licence_templates,
    f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), p AS (SELECT doc_id, len(w)::BIGINT AS n_words, {', '.join(f'{_PLACES(p)} AS p{k}' for k, (p, _) in enumerate(PHRASES))} FROM d),
 q AS (SELECT *, list_concat({', '.join(f'p{k}' for k in range(len(PHRASES)))}) AS spots FROM p)
SELECT doc_id, n_words, len(spots)::BIGINT AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM q""",
    "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
)

_base(
    "base_op10", op10_additive_quantisation,
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 5""",
    "query_id", "rank", "vec_id", "round(score, 9) AS score",
)

ORACLE_SQL["op11_hard_negatives"] = """WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.k, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.k <> b.k AND len(a.v) = len(b.v)),
 p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
 n AS (SELECT p.k, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.k = s.k AND p.place <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLE_SQL["op12_source_divergence"] = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(list_append(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), NULL)) AS term FROM documents),
 t AS (SELECT k, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d), g AS (SELECT DISTINCT lang, source FROM t),
 w AS (SELECT lang, term, count(*)::HUGEINT AS whole FROM t WHERE term IS NOT NULL GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
 l AS (SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(whole), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM g) LEFT JOIN w USING (lang) GROUP BY lang),
 c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN w USING (lang, term) GROUP BY lang, source, term), s AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
 p AS (SELECT s.lang, s.source, w.term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 2) // (s.n + 2 * v) AS p, 1 + 1000000000 * (whole + 2) // (l.n + 2 * v) AS q FROM s JOIN l USING (lang) JOIN w USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = w.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10"""

_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn')"
_ESCAPED_ROLE = r"replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>')"
ORACLE_SQL["op13_chat_examples"] = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
 s AS (SELECT *, sum(length({_ESCAPED}) + length({_ESCAPED_ROLE}) + 16) OVER o AS so_far, row_number() OVER o AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(so_far) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""
