"""The corpus pipeline: quality, near-duplicates, decontamination, mixture, token shards.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what the stage before it kept. run() writes
every stage's result as Parquet into the shared folder and hands the reread table on.

What holds for every stage: docs has columns doc_id, text and source, in any order, and may have others of any
name; all stages but the last return the columns of docs. An empty table gives an empty one. A null text counts
as empty; texts of any length are read whole. Ids may be null or repeat: rows are judged each for itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.llm import decontaminate, mixing, near_dedup, quality, token_shards
from grainsift.llm.common import shuffle_partitions, work_path, written
from grainsift.llm.features import held_out

NEAR_PERCENT = 80  # op6_near_dedup alone links from 85 on
BROADCAST_FILES = 100_000
REMEMBERED_PIECES = 400_000  # by a token worker, beside what the stages before it hold


class Numbered:
    """A frame under column names c0, c1, .. that no operator's own columns clash with."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.doc_id, self.text, self.source = (f"c{self.names.index(c)}" if c in self.names else None for c in ("doc_id", "text", "source"))

    def named(self, rows: DataFrame) -> DataFrame:
        """The columns of docs under their own names."""
        return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.names)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of rows that are not held out.

    Null and empty texts get the score of a text without n-grams and are judged by it. Without labels of both
    classes all rows have one score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_quality_model(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    n = Numbered(docs)
    scored = quality.quality_scores(n.rows, model, id_col=n.doc_id, text_col=n.text, keep_columns=True)
    return n.named(scored.where(F.col("score") >= quality.THRESHOLD))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of every near-duplicate group (links of NEAR_PERCENT and more).

    Texts without words are linked with nothing and stay. Where ids repeat or are null, rows are numbered in the order of
    (id, hash of the text), nulls last, and the first of a group stays: rows of one id and different texts are
    different documents, and of rows equal in both one stays.
    """
    n = Numbered(docs)
    rows, key = n.rows, n.doc_id
    if not rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        order = F.col(n.doc_id).asc_nulls_last(), F.xxhash64(n.text)
        rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        rows, key = written(rows.withColumn("nth", F.monotonically_increasing_id()), "pipeline-numbered"), "nth"
    kept = near_dedup.near_groups(rows, percent=NEAR_PERCENT, id_col=key, text_col=n.text).where("kept").select(key)
    return n.named(rows.join(kept, key, "left_semi"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null, empty and very short texts hold none and stay."""
    n = Numbered(docs)
    return n.named(decontaminate.without_contaminated(n.rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=n.text))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture: file after file, row after row.

    Rows of a null source are a source of their own. No row is dropped or repeated: once the first source has run out, its
    slots stay empty and the others go on at their release times.
    """
    n = Numbered(docs)
    at = {"source_col": n.source, "text_col": n.text}
    totals = mixing.source_totals(n.rows, **at)
    weights = mixing.temperature_weights(totals, mixing.ALPHA) or {mixing.NULL_SOURCE: 1.0}
    placed = mixing.mix_order(n.rows, weights, totals=totals, id_col=n.doc_id, **at)
    order = "mix_slot", "mix_offset", n.doc_id
    return n.named(placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))


def placed_rows(docs: DataFrame) -> DataFrame:
    """(place, doc_id, text): a row's place is the number of its file, in the order of part numbers and paths, and its row there.

    A frame that isn't read from Parquet files is written to the shared folder first, in the order it has.
    """
    try:
        rows = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "text")
    except AnalysisException:
        return placed_rows(written(docs.select("doc_id", "text"), "pipeline-unplaced"))
    files = rows.select("file").distinct()
    part = F.regexp_extract(F.substring_index("file", "/", -1), r"part-(\d+)", 1).try_cast("long")
    files = files.select("file", F.row_number().over(Window.orderBy(part.asc_nulls_last(), "file")).cast("long").alias("nth"))  # one row per file
    few = files.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    placed = rows.join(F.broadcast(files) if few else files.hint("merge"), "file")
    return placed.select((F.shiftleft("nth", 40) + F.col("row")).alias("place"), "doc_id", "text")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order in which the mixture lies in its files; one row per document, read back from them.

    The key of a document in the shards is its place, which no two rows share, so null and repeated ids keep their own
    tokens. A null text is the end id alone.
    """
    placed = placed_rows(docs)
    manifest = token_shards.write_shards(placed, work_path(spark, "mixture-shards"), "byte_bpe_50k.json", end_id=0, order_col="place", pieces=REMEMBERED_PIECES, texts=0)
    stored = token_shards.read_shards(manifest).select(F.col("doc_id").alias("place"), "start", "n_tokens", "ids_crc32")
    # Planned from the few rows of the manifest, `stored` looks small; it has a row per document, so it is never broadcast.
    return placed.select("place", "doc_id").hint("merge").join(stored, "place").select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixture", mix),
    ("token_shards", write_tokens),
]

ORACLE_SQL = None  # classifiers, tokenizers and edit distance are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
