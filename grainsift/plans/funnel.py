"""The flagship query: exact-key dedup, ordered rejection reasons, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.plans.registry import query
from grainsift.session import table


@query(
    "curation_funnel",
    r"""
WITH k AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM k),
c AS (SELECT CASE WHEN rn > 1 THEN 'duplicate' WHEN length(text) < 100 THEN 'too_short'
      WHEN regexp_matches(text, '^\p{Ll}') THEN 'lowercase_start' WHEN contains(text, '@') THEN 'contact'
      ELSE 'kept' END AS reason, length(text) AS n FROM r)
SELECT reason, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars FROM c GROUP BY reason
""",
)
def curation_funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")))
    reason = (
        F.when(F.length("text") < 100, "too_short")
        .when(F.col("text").rlike(r"^\p{Ll}"), "lowercase_start")
        .when(F.contains("text", F.lit("@")), "contact")
        .otherwise("kept")
    )
    # One narrow row for each key, combined before the shuffle: its first document is judged, all others are duplicates.
    rows = docs.select(key.alias("key"), "doc_id", reason.alias("reason"), F.length("text").cast("long").alias("n"))
    keys = rows.groupBy("key").agg(F.min(F.struct("doc_id", "reason", "n")).alias("first"), F.count("*").alias("docs"), F.sum("n").alias("chars"))
    judged = F.struct(F.col("first.reason").alias("reason"), F.lit(1).cast("long").alias("docs"), F.col("first.n").alias("chars"))
    rest = F.struct(F.lit("duplicate").alias("reason"), (F.col("docs") - 1).alias("docs"), (F.col("chars") - F.col("first.n")).alias("chars"))
    parts = keys.select(F.inline(F.array(judged, rest))).where("docs > 0")
    return parts.groupBy("reason").agg(F.sum("docs").alias("n_docs"), F.sum("chars").alias("n_chars"))
