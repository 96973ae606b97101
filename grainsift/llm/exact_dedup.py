"""Exact dedup by content sort. Native: DataFrame expressions only.

Sampled splitters cut the ordered content into ranges, an external sort inside each range places equal
texts next to each other, and each row is compared in full with its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.llm.common import shuffle_partitions, written

HEAD = 24  # leading characters that take part in the order of contents
MAX_RANGES = 1 << 15  # of about 100 bytes of splitter each, a literal of the plan; an external sort makes large ranges good
SAMPLE_PER_RANGE = 24


def _order_key(text: Column, doc_id: Column) -> Column:
    """A short total order in which equal texts are neighbours: head of the text, its digest, then the id.

    The digest stands for the rest of the text, so that splitters stay small however long texts are; the id
    comes last, so that a splitter can fall inside a hot group of copies and spread it over many ranges.
    """
    flipped = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.substring(text, 1, HEAD), F.lit("\x00"), F.sha2(text, 256), F.coalesce(flipped, F.lit("")))


def sampled_splitters(rows: DataFrame, key: Column, n_ranges: int) -> list[str]:
    """At most n_ranges - 1 increasing splitters of a key, from a sample of bounded size; only sampled rows compute it."""
    n = rows.count()
    if n == 0 or n_ranges < 2:
        return []
    want = n_ranges * SAMPLE_PER_RANGE
    got = sorted(r[0] for r in rows.sample(min(1.0, 1.1 * want / n), seed=17).select(key).limit(2 * want).collect())
    return sorted({got[len(got) * i // n_ranges] for i in range(1, n_ranges)}) if got else []


def range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters <= key, found in two steps of about sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    tops = F.lit(splitters[::step])
    top = F.size(F.filter(tops, lambda s: s <= key))
    fine = F.slice(F.lit(splitters), (top - 1) * step + 1, F.lit(step))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + F.size(F.filter(fine, lambda s: s <= key)))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text: Column | None = None, keep: str = "min", n_ranges: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    text is the normalised content (default: column text unchanged, null as empty). Of equal texts the row
    with the smallest (keep="min") or largest ("max") id stays; of rows that repeat one id and text exactly
    one is kept. Null ids sort before all others, are never keep_id beside a non-null id under "max", and a
    group of null ids only has a null keep_id. An empty table gives no rows. Other columns are ignored.

    The text crosses the network once. A group of copies may be cut by splitters; its pieces are joined
    again by comparing the last text of a range with the first of the next, 2 rows a range.
    """
    spark = docs.sparkSession
    n_ranges = n_ranges or min(MAX_RANGES, 4 * shuffle_partitions(spark))
    content = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), content.alias("_text"))
    key = _order_key(F.col("_text"), F.col("_id"))
    splitters = sampled_splitters(rows, key, n_ranges)
    rows = rows.withColumn("key", key)
    rows = rows.withColumn("range", range_of(F.col("key"), splitters).cast("int"))

    order = Window.partitionBy("range").orderBy("key")
    nth = F.row_number().over(order)
    marked = rows.select(
        "_id", "_text", "range", "key", nth.alias("nth"), F.lag("_text").over(order).eqNullSafe(F.col("_text")).alias("same"), F.lead("key").over(order).isNull().alias("ends"),
    )
    runs = marked.select(
        "_id", "range", "nth", "ends",
        F.sum(F.when(F.col("same"), 0).otherwise(1)).over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.unhex(F.substring(F.substring_index("key", "\x00", -1), 1, 64)).alias("digest"),
        F.when(F.col("ends") | (F.col("nth") == 1), F.col("_text")).alias("edge"),
    )
    whole = Window.partitionBy("range", "run")
    pick = F.max if keep == "max" else F.min
    local = written(
        runs.select("_id", "range", "run", "nth", "ends", "digest", "edge", pick("_id").over(whole).alias("run_keep"), F.count("*").over(whole).alias("run_size"), (F.max("nth") if keep == "max" else F.min("nth")).over(whole).alias("run_nth")),
        "exact-runs",
    )

    # Runs that touch the edge of their range: at most two a range, so the stitching below is bounded by n_ranges.
    size = "range", "run", "run_keep", "run_size"
    first = local.where("nth = 1").select(*size, F.col("edge").alias("first_text"))
    last = local.where("ends").select("range", F.col("run").alias("last_run"), F.col("edge").alias("last_text"), F.col("run_keep").alias("last_keep"), F.col("run_size").alias("last_size"))
    chain = Window.orderBy("range")
    before = first.select("range").withColumn("prev", F.lag("range").over(chain))
    meets = (
        before.join(first.select("range", "first_text"), "range")
        .join(last.select(F.col("range").alias("prev"), F.col("last_text")), "prev", "left")
        .select("range", F.coalesce(F.col("first_text") == F.col("last_text"), F.lit(False)).alias("meets"))
    )
    edges = first.drop("first_text").join(last.drop("last_text"), "range").join(meets, "range")
    # A chain of ranges that one text runs through starts anew where the text changes inside a range.
    edges = edges.withColumn("opens", (~F.col("meets") | (F.col("last_run") > 1)).cast("int"))
    edges = edges.withColumn("tail_class", F.sum("opens").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("head_class", F.when(F.col("meets"), F.coalesce(F.lag("tail_class").over(chain), F.lit(0))))
    pieces = edges.select(F.col("tail_class").alias("class"), "range", F.col("last_run").alias("run"), F.col("last_keep").alias("k"), F.col("last_size").alias("n")).unionByName(
        edges.where(F.col("meets") & (F.col("last_run") > 1)).select(F.col("head_class").alias("class"), "range", "run", F.col("run_keep").alias("k"), F.col("run_size").alias("n"))
    )
    same = Window.partitionBy("class")
    nulls_end = F.max("range") if keep == "max" else F.min("range")
    stitched = pieces.select("range", "run", pick("k").over(same).alias("all_keep"), F.sum("n").over(same).alias("all_size"), (nulls_end.over(same) == F.col("range")).alias("holds"))
    out = local.join(F.broadcast(stitched), ["range", "run"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("all_keep", "run_keep").alias("keep_id"),
        F.coalesce("all_size", "run_size").cast("long").alias("group_size"),
        ((F.col("nth") == F.col("run_nth")) & F.coalesce("holds", F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: texts unchanged, the largest doc_id of equal texts stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="max")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
