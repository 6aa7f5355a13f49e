"""SQL of the Merkle manifest and of the collocations."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The remainders of the sixteen half bytes under CRC-32's reversed polynomial."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


_STEP = f"xor(c >> 4, list_extract({_crc_table()}::BIGINT[], CAST(1 + (xor(c, b) & 15) AS BIGINT)))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) & 15 AS BIGINT), CAST(ord(x) >> 4 AS BIGINT)]))), lambda c, b: {_STEP}))"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf,
         {_leaf("low")} AS now
  FROM (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM documents)
), l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), up AS (
  SELECT 0 AS lev, g, i, leaf AS h, n FROM l
  UNION ALL
  SELECT lev + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lev, g, i // 8, n
), sub AS MATERIALIZED (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), sky AS (
  SELECT 0 AS lev, '' AS g, i, h, n FROM sub
  UNION ALL
  SELECT lev + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM sky WHERE n > 1 GROUP BY lev, g, i // 8, n
), walk AS (
  SELECT row_number() OVER () AS r, 0 AS lev, g, i, n, now AS h, '' AS p FROM l
  UNION ALL
  SELECT w.r, w.lev + 1, w.g, w.i // 8, (w.n + 7) // 8, sha256(string_agg(CASE WHEN u.i = w.i THEN w.h ELSE u.h END, '' ORDER BY u.i)), w.p || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> w.i), '')
  FROM walk w JOIN up u ON u.lev = w.lev AND u.g = w.g AND u.i // 8 = w.i // 8 WHERE w.n > 1 GROUP BY w.r, w.lev, w.g, w.i, w.n, w.h, w.p
), high AS (
  SELECT w.r, 0 AS lev, s.i, s.n, w.h, w.p FROM walk w JOIN sub s ON s.g = w.g WHERE w.n = 1
  UNION ALL
  SELECT w.r, w.lev + 1, w.i // 8, (w.n + 7) // 8, sha256(string_agg(CASE WHEN u.i = w.i THEN w.h ELSE u.h END, '' ORDER BY u.i)), w.p || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> w.i), '')
  FROM high w JOIN sky u ON u.lev = w.lev AND u.i // 8 = w.i // 8 WHERE w.n > 1 GROUP BY w.r, w.lev, w.i, w.n, w.h, w.p
), o AS (
  SELECT *, row_number() OVER () AS r FROM l
)
SELECT o.doc_id, o.leaf, sub.h AS subroot, k.h AS root, sha256(e.p) AS proof_sha256, e.h AS folded_root, e.h = k.h AS verified
FROM o JOIN sub USING (g) JOIN high e ON e.r = o.r AND e.n = 1 CROSS JOIN (SELECT h FROM sky WHERE n = 1) k
"""


COLLOCATIONS = r"""
WITH p AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, CAST(len(w) AS BIGINT) - size + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)
), f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), u AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), s AS (
  SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r, CAST((CAST(u.a AS HUGEINT) * 2000000) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.x JOIN f r ON r.lang = u.lang AND r.phrase = u.y
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, size, a, w, n, unnest(range(1, size - n + 2)) AS i FROM c, (VALUES (2), (3)) t(n) WHERE n < size) GROUP BY ALL
), t AS (
  SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t QUALIFY rank <= 2000
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang)
"""
