"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .divergence import LEAST_DOCS, SCALE, SMOOTHING, TERM_RANKS
from .merkle import ARITY, FIELDS, LOWER, UPPER

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)
, w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d)
, kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= {LEAST_DOCS})
, c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3)
, grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term))
, sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS big, count(*) OVER (PARTITION BY lang, source) AS v FROM grid)
, whole AS (SELECT lang, sum(total) AS big FROM kept GROUP BY 1)
, p AS (SELECT s.lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {SMOOTHING})) // (s.big + {SMOOTHING} * v) AS p, 1 + ({SCALE}::HUGEINT * (total + {SMOOTHING})) // (whole.big + {SMOOTHING} * v) AS q FROM sized s JOIN whole USING (lang))
, far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3)
, g AS (SELECT DISTINCT lang, source FROM d)
, pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source)
, term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""


def field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"


#: crc32 of a text of digits, bit by bit.
CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: ord(b)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"


def levels(first: str, name: str, depth: int) -> str:
    """CTEs name0 .. name<depth> (tree, place, hash) of a tree's levels, from ``first``; a tree that has one node keeps it."""
    made = f", {name}0 AS ({first})\n"
    for k in range(1, depth + 1):
        made += f""", {name}{k} AS (SELECT tree, place // {ARITY} AS place, CASE WHEN max(n) = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k - 1}) GROUP BY tree, place // {ARITY})
"""
    return made


def climb(rows: str, tree: str, name: str, depth: int, into: str) -> str:
    """CTEs that take ``rows`` (i, tree, place, proof, folded) up the levels, with the siblings left and right."""
    made, last = "", rows
    for k in range(depth):
        made += f""", {into}{k} AS (SELECT r.* EXCLUDE (place, proof, folded), r.place // {ARITY} AS place, r.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof,
  CASE WHEN s.n > 1 THEN sha256(coalesce(s.l, '') || r.folded || coalesce(s.r, '')) ELSE r.folded END AS folded
  FROM {last} r JOIN (SELECT tree, place, count(*) OVER (PARTITION BY tree) AS n, string_agg(hash, '') OVER (PARTITION BY tree, place // {ARITY} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  string_agg(hash, '') OVER (PARTITION BY tree, place // {ARITY} ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {name}{k}) s ON s.tree IS NOT DISTINCT FROM r.{tree} AND s.place = r.place)
"""
        last = f"{into}{k}"
    return made


#: Up to 16^5 rows of a source and as many sources.
DEPTH = 5
MERKLE = (
    f"""WITH h AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {CRC} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS shown FROM documents)
, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM h)
"""
    + levels("SELECT source AS tree, place, leaf AS hash FROM n", "a", DEPTH)
    + levels(f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, hash FROM a{DEPTH}", "b", DEPTH)
    + f", sub AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS nth FROM a{DEPTH})\n"
    + ", start AS (SELECT *, '' AS proof, shown AS folded FROM n)\n"
    + climb("start", "source", "a", DEPTH, "u")
    + f", mid AS (SELECT u.* EXCLUDE (place), subroot, nth AS place, 0 AS tree FROM u{DEPTH - 1} u JOIN sub ON sub.tree IS NOT DISTINCT FROM u.source)\n"
    + climb("mid", "tree", "b", DEPTH, "v")
    + f"SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM v{DEPTH - 1}, (SELECT hash AS root FROM b{DEPTH})"
)
