"""The queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm import copies, leakage, neardup, packing, pii, subjects, survivors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_members(table(spark, sf_dir, "asper_record"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(table(spark, sf_dir, "asper_record"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found(table(spark, sf_dir, "asper_record"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "asper_record"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "asper_record"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of enough words with the class of its copies and how many classes are similar to it."""
    return neardup.membership(table(spark, sf_dir, "asper_record"))


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that may hold personal information; a turn delivered twice is one text."""
    records = table(spark, sf_dir, "asper_record").select(F.lit("record").alias("origin"), F.col("id").alias("rec_key"), F.col("content").alias("text"))
    turns = table(spark, sf_dir, "asper_turn").select(F.lit("turn").alias("origin"), F.concat_ws(":", "session", F.col("seq").cast("string")).alias("rec_key"), "text")
    return records.unionByName(turns)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_personal_texts(spark, sf_dir), ["origin", "rec_key"], "text").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(_personal_texts(spark, sf_dir), "text").select("origin", "rec_key", "redacted").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds half of an item or more, in whatever order, with the tiles found and the share they cover."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), min_coverage=0.5)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(*(table(spark, sf_dir, t) for t in ("documents", "doc_label", "subject_area")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_groups, p4_found, p4_survivors, p5_found, p5_classes, p6_found, p6_redacted, p7_containers, p8_found, p8_report, p9_found)}

_COPIES = r"""
WITH keyed AS (
  SELECT *, regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g') AS letters,
    list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g')), lambda t: t <> ''))) AS tagset
  FROM asper_record
),
grouped AS (SELECT *, min(id) OVER (PARTITION BY letters, tagset) AS kept_id, count(*) OVER (PARTITION BY letters, tagset) AS copies FROM keyed)
"""
_VOTES = (
    _COPIES
    + """, member AS (
  SELECT kept_id AS group_id, id, created_at, updated_at, relevance, source, access_count,
    CASE source WHEN 'seed' THEN 1.0 WHEN 'manual' THEN 0.8 WHEN 'curator' THEN 0.6 ELSE 0.3 END AS trust,
    CASE source WHEN 'seed' THEN 1.0 WHEN 'manual' THEN 0.8 WHEN 'curator' THEN 0.6 ELSE 0.3 END
      * pow(0.5::DOUBLE, greatest(0.0, (1785319920 - coalesce(updated_at, 0)) / 86400.0) / 90.0) AS weight
  FROM grouped WHERE copies > 1
),
cells AS (
  SELECT group_id, id, 'updated_at' AS field, updated_at::VARCHAR AS v, updated_at::DOUBLE AS number, weight FROM member WHERE updated_at BETWEEN created_at AND 1785319920
  UNION ALL SELECT group_id, id, 'relevance', relevance::VARCHAR, relevance, weight FROM member WHERE relevance BETWEEN 0 AND 1
  UNION ALL SELECT group_id, id, 'source', source, trust::DOUBLE, weight FROM member WHERE source IN ('seed', 'manual', 'curator')
  UNION ALL SELECT group_id, id, 'access_count', access_count::VARCHAR, access_count::DOUBLE, weight FROM member WHERE access_count BETWEEN 0 AND 4294967295
),
tally AS (SELECT group_id, field, number, v, round(sum(weight), 9) AS votes, min(id) AS id FROM cells GROUP BY ALL)
"""
)

ORACLES: dict[str, str] = {
    "p3_found": _COPIES + "SELECT kept_id, id FROM grouped WHERE id <> kept_id",
    "p3_groups": _COPIES + "SELECT kept_id, copies FROM grouped WHERE id = kept_id",
    "p4_found": _VOTES + "SELECT group_id, field, arg_max(id, (number, votes)) AS id FROM tally GROUP BY 1, 2",
    "p8_found": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM doc, unnest(range(1, len(w) - 10)) AS u(i)),
iw AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM item, unnest(range(1, len(w) - 10)) AS u(i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)""",
    "p4_survivors": _VOTES
    + """, won AS (SELECT group_id, field, arg_max(v, (votes, number)) AS v, max(votes) AS votes FROM tally GROUP BY 1, 2)
SELECT group_id, max(CASE WHEN field = 'updated_at' THEN v END)::BIGINT AS updated_at, max(CASE WHEN field = 'relevance' THEN v END)::DOUBLE AS relevance,
  max(CASE WHEN field = 'source' THEN v END) AS source, max(CASE WHEN field = 'access_count' THEN v END)::BIGINT AS access_count, round(sum(votes), 6) AS votes
FROM won GROUP BY 1""",
}
