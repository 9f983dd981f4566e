"""The queries of this package's operators, with DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated
from tessera.llm.fingerprint import edit_probes
from tessera.llm.html_text import extract
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.line_quality import line_quality
from tessera.llm.near_dup import near_duplicates
from tessera.llm.piece_codec import piece_codec
from tessera.llm.secret_scan import secret_spans, span_digests
from tessera.llm.suffix_tree import suffix_tree_scores
from tessera.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int, column: str = "doc_id"):
    """True where crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col(column).cast("string")) % modulus == remainder


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(_table(spark, sf_dir, "documents"), fold(7, 2))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(_table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secret_spans(_table(spark, sf_dir, "documents")))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(5, 0))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probes(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(4, 2))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_piece_codec": op7_piece_codec,
    "op8_line_quality": op8_line_quality,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM sets
), class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sets WHERE len(s) > 0
), items AS (SELECT doc_id, unnest(s) AS x FROM sets WHERE doc_id IN (SELECT rep FROM class)
), freq AS (SELECT x, count(*) AS f FROM items GROUP BY x
), ranked AS (
  SELECT i.doc_id, x, n, row_number() OVER (PARTITION BY i.doc_id ORDER BY f, x) AS r
  FROM items i JOIN freq USING (x) JOIN n ON n.doc_id = i.doc_id
), prefix AS (SELECT doc_id, x, n FROM ranked WHERE r <= n - (8 * n + 9) // 10 + 1
), pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM (
    SELECT a, b, na, nb, len(list_intersect(x.s, y.s)) AS k FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b)
  WHERE 100 * k >= 80 * (na + nb - k)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(id, peer) AS (
  SELECT rep, rep FROM (SELECT DISTINCT rep FROM class) UNION SELECT id, b FROM reach JOIN edges ON peer = a
), comp AS (SELECT id, min(peer) AS c FROM reach GROUP BY id)
SELECT d.doc_id, n.n AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d JOIN n USING (doc_id) LEFT JOIN class USING (doc_id) LEFT JOIN comp ON comp.id = class.rep
"""

LINES_SQL = f"""
l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {{docs}}
), k AS (
  SELECT doc_id, pos, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN shared USING (key)
), deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id
)"""

SQL: dict[str, str] = {
    "op3_near_duplicates": _NEAR,
    "op4_line_dedup": f"WITH {LINES_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped",
}
