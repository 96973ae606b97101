"""Joins and lookups by key, ordinal or fallback; sampling; set overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def left_with_defaults(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join to a table with one row per key; missing values get defaults."""
    out = left.join(right.select(on, *defaults), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def unfinished(todo: DataFrame, done: DataFrame, on: str | list[str], ok: Column) -> DataFrame:
    """Rows whose key has no successful row in earlier output; failed rows are tried again."""
    return todo.join(done.where(ok).select(on).distinct(), on, "left_anti")


def fallback_lookup(left: DataFrame, table: DataFrame, keys: Sequence[str], table_key: str, value: str) -> DataFrame:
    """The value under the first of several keys that has one."""
    out, found = left, []
    for i, k in enumerate(keys):
        side = table.select(F.col(table_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(side, F.col(k) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def by_position(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Rows joined on an explicit ordinal; rows of either side without partner stay."""
    return left.join(right, ordinal, "full")


def merge_versions(old: DataFrame, new: DataFrame, keys: Sequence[str], good: Column) -> DataFrame:
    """Rows of old, replaced by new ones where old is bad and new is good; both frames have the same columns."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rank = F.when(good & (F.col("_v") == 0), 3).when(good, 2).when(F.col("_v") == 0, 1).otherwise(0)
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_v"), rank).alias("_r"), F.min("_v").alias("_first"))
    return best.where("_first = 0").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], (F.col("_r._v") == 1).alias("replaced"))


def ordinal_in(group: Sequence[str], order: Sequence[str | Column]) -> Column:
    """0-based place within a group."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1


def task_id(source_id: Column, place: Column) -> Column:
    """Identifier of the k-th question of a source."""
    return F.concat(source_id, F.lit("#"), place.cast("string"))


def source_of_task(task: Column) -> Column:
    """The inverse of task_id."""
    return F.regexp_replace(task, "#[^#]*$", "")


def hash_order(ids: Column, seed: int) -> Column:
    """L3: a seeded pseudo-random key; the same on every run and any number of partitions."""
    return F.xxhash64(ids, F.lit(seed))


def seeded_sample(df: DataFrame, n: int, ids: str, seed: int = 42) -> DataFrame:
    """L3, L4: n rows without replacement in seeded order; Spark keeps the n smallest keys of each partition."""
    return df.orderBy(hash_order(F.col(ids), seed), ids).limit(n)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of every group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def proportional_sample(df: DataFrame, stratum: str, n: int, order: Sequence[str | Column]) -> DataFrame:
    """max(1, round(n * share)) rows of each stratum (half to even), in the given order; at most n in all."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_s"))
    total = F.sum("_s").over(Window.partitionBy())  # one row per stratum
    quota = sizes.withColumn("_q", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_s") / total).cast("int"))).drop("_s")
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("_rn", rn).join(quota, stratum).where("_rn <= _q").orderBy("_rn", stratum).limit(n).drop("_rn", "_q")


def even_stride(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every step-th row of the ordered rows, n at most; step = max(1, rows // n).

    Places come from a range sort and the row counts of its partitions, so no task holds all rows.
    """
    step = max(1, df.count() // n)
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    base = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_n", place).join(base, "_p").where((F.col("_b") + F.col("_n")) % step == 0).orderBy(*order).limit(n).drop("_p", "_n", "_b")


def tiered_round_robin(df: DataFrame, tier: Column, stratum: str, order: Sequence[str], n: int) -> DataFrame:
    """N rows, lower tiers first; inside a tier strata take turns, each in its own order."""
    rn = F.row_number().over(Window.partitionBy("_t", stratum).orderBy(*order))
    return df.withColumn("_t", tier).withColumn("_r", rn).orderBy("_t", "_r", stratum).limit(n).drop("_t", "_r")


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """D10, T-11: sizes of two id sets, their intersection and union, as one row."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bit_or("s").alias("m"))
    return both.agg(
        F.count_if(F.col("m").bitwiseAND(1) > 0).alias("n_a"), F.count_if(F.col("m").bitwiseAND(2) > 0).alias("n_b"), F.count_if(F.col("m") == 3).alias("n_both"), F.count("*").alias("n_any"),
    )


def batches(df: DataFrame, order: Sequence[str], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Batch number of every row, `size` rows a batch, counted inside groups of `by`."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))


def query_grid(terms: DataFrame, templates: DataFrame, done: DataFrame) -> DataFrame:
    """Every term under every template that is not done yet; both sides are small vocabularies."""
    return terms.crossJoin(templates).join(done, [*terms.columns, *templates.columns], "left_anti")


def similar_token_sets(a: DataFrame, b: DataFrame, a_id: str, a_set: str, b_id: str, b_set: str, least: float) -> DataFrame:
    """M1: all pairs (a_id, b_id, jaccard) of token sets with a Jaccard similarity of at least `least`.

    Prefix filter: sets of n and m tokens that similar share `least` times n tokens and `least` times m, so they also share
    one when each leaves out all but one of so many of its commonest tokens. Only such rare tokens are joined on, and only
    pairs that meet there are compared on whole sets. Tokens are ordered by how many sets of b hold them, so those that no
    set of b holds cost nothing. Empty sets are similar to nothing. Ids are unique on either side.
    """
    one = a.select(F.col(a_id).alias("a"), F.col(a_set).alias("x")).where(F.size("x") > 0)
    two = b.select(F.col(b_id).alias("b"), F.col(b_set).alias("y")).where(F.size("y") > 0)
    known = two.select(F.explode("y").alias("t")).groupBy("t").agg(F.count("*").alias("held"))

    def rare(sets: DataFrame, key: str, tokens: str) -> DataFrame:
        rows = sets.select(key, F.size(tokens).alias("n"), F.explode(tokens).alias("t")).join(known, "t")
        nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("held"), F.desc("t")))  # commonest first
        return rows.withColumn("nth", nth).where(F.col("nth") >= F.ceil(F.col("n") * least - 1e-9)).select(key, "t")

    pairs = rare(one, "a", "x").join(rare(two, "b", "y"), "t").select("a", "b").distinct()
    shared = F.size(F.array_intersect("x", "y"))
    similar = pairs.join(one, "a").join(two, "b").select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard"))
    return similar.where(F.col("jaccard") >= least).select(F.col("a").alias(a_id), F.col("b").alias(b_id), "jaccard")
