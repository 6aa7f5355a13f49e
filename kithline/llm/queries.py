"""The queries of this subpackage, opN_<name> for operator N, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.llm.bpe_lexicon import encode
from kithline.llm.collocations import collocations
from kithline.llm.decontaminate import contaminated
from kithline.llm.exact_dedup import exact_dedup
from kithline.llm.license_scan import BASE, scan_licenses, templates
from kithline.llm.merkle import audit, lower_ascii
from kithline.llm.oracles import COLLOCATIONS, MERKLE
from kithline.llm.secret_scan import scan_secrets
from kithline.llm.sentencepiece_rounds import encode_pieces
from kithline.llm.simhash import near_duplicates
from kithline.llm.substring_dedup import substring_dedup
from kithline.llm.suffix_dedup import suffix_dedup
from kithline.llm.token_counts import token_counts
from kithline.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _digest(passages: DataFrame) -> DataFrame:
    return passages.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(substring_dedup(_table(spark, sf_dir, "documents")))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(suffix_dedup(_table(spark, sf_dir, "documents")))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"), "source", F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_live", "n_copied", "owners", "repositories", F.sha2("base", 256).alias("base_sha256"), "spans")


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text")))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": _op1,
        "op2_decontamination": _op2,
        "op3_substring_dedup": _op3,
        "op4_suffix_dedup": _op4,
        "op5_token_counts": _op5,
        "op6_secret_scan": _op6,
        "op7_bpe_codec": _op7,
        "op8_license_scan": _op8,
        "op9_toxicity": _op9,
        "op10_simhash_near_dedup": _op10,
        "op11_piece_codec": _op11,
        "op12_collocations": _op12,
        "op13_merkle_manifest": _op13,
        "pipeline": _pipeline,
    }


_OP1 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


_OP2 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark
), i AS (
  SELECT item_id, r, s, n, count(*) OVER (PARTITION BY r) AS n_shingles FROM (
    SELECT DISTINCT item_id, r, n, array_to_string(w[p:p + n - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(5, len(w)) AS n FROM b WHERE len(w) > 0)))
), x AS (
  SELECT DISTINCT doc_id, r, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT d.*, k.n, unnest(range(1, len(w) - k.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) k WHERE len(w) >= k.n)
)
SELECT x.doc_id, i.item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM x JOIN i ON x.s = i.s AND x.n = i.n GROUP BY x.doc_id, x.r, i.item_id, i.r HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS text FROM documents
), k AS (
  SELECT * FROM (VALUES
    ('assign', '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]+'), ('other', '[A-Za-z0-9+/_-]{20,}')) t(kind, pattern)
), m AS (
  SELECT doc_id, rid, owner, repo, 'assign' AS kind, string_split_regex(text, (SELECT pattern FROM k WHERE kind = 'assign')) AS gaps,
         regexp_extract_all(text, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS found,
         regexp_extract_all(text, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals FROM d
  UNION ALL SELECT doc_id, rid, owner, repo, 'access', string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL SELECT doc_id, rid, owner, repo, 'hex', string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM d
  UNION ALL SELECT doc_id, rid, owner, repo, 'other', string_split_regex(text, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}', 0), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}', 0) FROM d
), u AS (
  SELECT doc_id, rid, owner, repo, kind, unnest(range(1, len(found) + 1)) AS i, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS found, unnest(vals) AS val FROM m WHERE len(found) > 0
), p AS (
  SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM u
), good AS (
  SELECT doc_id, rid, owner, repo, kind, CAST(stop - length(found) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, val, CAST(stop - length(val) AS BIGINT) AS val_start FROM p
  WHERE CASE kind WHEN 'assign' THEN length(val) >= 12 WHEN 'access' THEN length(val) >= 18 WHEN 'hex' THEN length(val) >= 16
        ELSE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND len(list_distinct(list_filter(string_split(val, ''), lambda c: c <> ''))) >= 12 END
), owned AS (
  SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repositories FROM good GROUP BY val
), s AS (
  SELECT rid, kind, start, stop, 0 AS owners, 0 AS repositories FROM good WHERE kind <> 'other'
  UNION ALL SELECT DISTINCT rid, CASE WHEN owners <= 1 AND repositories <= 2 THEN 'live' ELSE 'copied' END, val_start, stop, owners, repositories FROM good JOIN owned USING (val)
), r AS (
  SELECT rid, kind, start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS rk, stop, owners, repositories, concat_ws(':', kind, start, stop) AS label FROM s
), a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (kind = 'copied') AS n_copied, max(owners) AS owners, max(repositories) AS repositories,
         string_agg(label, ',' ORDER BY start, rk, stop) FILTER (kind NOT IN ('live', 'copied')) AS base, string_agg(label, ',' ORDER BY start, rk, stop) FILTER (kind <> 'copied') AS spans FROM r GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(owners, 0) AS owners, coalesce(repositories, 0) AS repositories, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


def _op8_sql() -> str:
    """The templates are the operator's own; everything else is written anew."""
    rows = ", ".join(f"({i}, {str(i < len(BASE)).lower()}, '{' '.join(words)}', '{label}')" for i, (words, label) in enumerate(templates()))
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), t AS (
  SELECT *, len(w) - 2 AS n_grams FROM (SELECT id, is_base, label, string_split(phrase, ' ') AS w FROM (VALUES {rows}) v(id, is_base, phrase, label))
), tg AS (
  SELECT id, is_base, label, n_grams, k - 1 AS t, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS k FROM t)
), h AS (
  SELECT x.rid, tg.*, x.p - tg.t AS diagonal
  FROM (SELECT rid, p - 1 AS p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)) x JOIN tg USING (g)
), dg AS (
  SELECT rid, id, is_base, label, n_grams, diagonal, count(*) AS votes, list(t) AS ts FROM h GROUP BY ALL
), c AS (
  SELECT *, floor((diagonal - min(diagonal) OVER (PARTITION BY rid, id, run)) / (n_grams + 2)) AS cut FROM (SELECT *, sum(apart) OVER (PARTITION BY rid, id ORDER BY diagonal) AS run
  FROM (SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY rid, id ORDER BY diagonal) > 2 AS INT), 0) AS apart FROM dg))
), m AS (
  SELECT rid, id, is_base, label, n_grams, run, cut,
         list_reduce(list_sort(flatten(list(list_transform(ts, lambda t: {{'t': CAST(t AS BIGINT), 'p': CAST(t + diagonal AS BIGINT), 'n': CAST(1 AS BIGINT)}})))), lambda x, y: CASE WHEN y.t > x.t AND y.p > x.p THEN {{'t': y.t, 'p': y.p, 'n': x.n + 1}} ELSE x END).n / n_grams AS part,
         count(*) FILTER (is_base AND votes = n_grams) AS places, min(diagonal) FILTER (is_base AND votes = n_grams) AS lo, max(diagonal) FILTER (is_base AND votes = n_grams) AS hi
  FROM c GROUP BY rid, id, is_base, label, n_grams, run, cut
), a AS (
  SELECT rid, sum(places) AS n_base, min(lo) AS lo, max(hi) AS hi, max(part) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR part >= 0.8) AS labels
  FROM m GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (rid)
"""


_PASSAGES = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT doc_id, p, sha256(array_to_string(words[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM d WHERE len(words) >= 50)
), m AS (
  SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM w) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS at FROM m
), kept AS (
  SELECT d.doc_id, string_agg(u.word, ' ' ORDER BY u.at) AS t, count(*) AS n
  FROM d, LATERAL (SELECT unnest(d.words) AS word, unnest(range(1, len(d.words) + 1)) AS at) u
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.at = u.at)
  GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op2_decontamination": _OP2, "op3_substring_dedup": _PASSAGES, "op4_suffix_dedup": _PASSAGES, "op6_secret_scan": _OP6, "op8_license_scan": _op8_sql(),
            "op12_collocations": COLLOCATIONS, "op13_merkle_manifest": MERKLE}
