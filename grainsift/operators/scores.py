"""Scores, buckets, leaderboards and the metrics of a result set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICT_VALUE = {"met": 1.0, "yes": 1.0, "partial": 0.5, "not_met": 0.0, "no": 0.0}  # fixed values


def verdict_value(v: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in VERDICT_VALUE.items() for x in kv])[F.lower(v)]


def checklist_scores(criteria: DataFrame, verdicts: DataFrame, task: str, criterion: str, weight: str, verdict: str) -> DataFrame:
    """Weighted share of met criteria of each task: score, n_criteria. Criteria without a verdict don't count; none matched gives 0."""
    both = criteria.join(verdicts.select(task, criterion, verdict), [task, criterion], "left")
    hit = verdict_value(F.col(verdict))
    w = F.when(hit.isNotNull(), F.col(weight).cast("double"))
    out = both.groupBy(task).agg(F.sum(w * hit).alias("_s"), F.sum(w).alias("_w"), F.count("*").alias("n_criteria"))
    return out.select(task, F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(F.lit(0.0)).alias("score"), "n_criteria")


def model_buckets(scores: DataFrame, task: str, model: str, score: str, models: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Tasks scored by all models, with the number that fail and all_fail, split or all_pass."""
    mine = scores.where(F.col(model).isin(list(models)) & F.col(score).isNotNull())
    per = mine.groupBy(task).agg(F.count_distinct(model).alias("_m"), F.count_if(F.col(score) < threshold).alias("n_fail"), F.avg(score).alias("mean_score"))
    n = len(models)
    label = F.when(F.col("n_fail") == n, "all_fail").when(F.col("n_fail") == 0, "all_pass").otherwise("split")
    return per.where(F.col("_m") == n).select(task, "n_fail", "mean_score", label.alias("bucket"))


def robust_core(scores: DataFrame, task: str, model: str, score: str, models: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Tasks that every model of the roster scored and failed."""
    return model_buckets(scores, task, model, score, models, threshold).where("bucket = 'all_fail'").select(task)


def leaderboard(scores: DataFrame, task: str, model: str, score: str, core: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """N, average and solve rate of each model over all its scored tasks, and over a set of core tasks."""
    marked = scores.where(F.col(score).isNotNull())
    marked = marked.join(core.select(task).distinct().withColumn("_core", F.lit(True)), task, "left") if core is not None else marked.withColumn("_core", F.lit(True))
    solved = (F.col(score) >= threshold).cast("int")
    return marked.groupBy(model).agg(
        F.count("*").alias("n"), F.avg(score).alias("avg_score"), F.avg(solved).alias("solve_rate"), F.count("_core").alias("n_core"), F.avg(F.when(F.col("_core"), solved)).alias("core_solve_rate"),
    )


def by_group(tasks: DataFrame, group: str, score: str, threshold: float, all_groups: DataFrame | None = None) -> DataFrame:
    """A3, A4: tasks, judged tasks, average and pass rate of each group; with all_groups every group is listed."""
    out = tasks.groupBy(group).agg(F.count("*").alias("n_tasks"), F.count(score).alias("n_judged"), F.avg(score).alias("avg_score"), F.avg((F.col(score) >= threshold).cast("int")).alias("pass_rate"))
    if all_groups is None:
        return out
    return all_groups.join(out, group, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tasks", "n_judged")})


def judge_table(rows: DataFrame, model: str, supports: str) -> DataFrame:
    """Yes, partial, no, judged and errors of each model and overall (model null)."""
    v = F.col(supports)
    return rows.rollup(model).agg(
        *[F.count_if(v == x).alias(f"n_{x}") for x in ("yes", "partial", "no")],
        F.count_if(v.isin("yes", "partial", "no")).alias("n_judged"), F.count_if(~F.coalesce(v, F.lit("error")).isin("yes", "partial", "no")).alias("n_errors"),
    )


def type_satisfaction(rows: DataFrame, kind: str, weight: str, verdict: str) -> DataFrame:
    """A10: weighted satisfaction by criterion type."""
    hit = verdict_value(F.col(verdict))
    return rows.where(hit.isNotNull()).groupBy(kind).agg(F.sum(F.col(weight) * hit).alias("got"), F.sum(weight).alias("of"))


def difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """A10: value of b minus value of a for every key of either; missing counts as 0."""
    x, y = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    return x.join(y, key, "full").select(key, (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("delta"))


def token_cost(usage: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Cost of each row: tokens in and out times the model's prices per million."""
    return usage.join(prices, model).withColumn("cost", (F.col(tokens_in) * F.col("price_in") + F.col(tokens_out) * F.col("price_out")) / 1e6)


def coverage_gaps(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows in which each field is missing: null, or empty for strings and arrays."""
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        out = F.col(c).isNull()
        if kinds[c] == "string":
            out |= F.col(c) == ""
        elif kinds[c].startswith(("array", "map")):
            out |= F.size(c) == 0
        return out

    return df.agg(*[F.count_if(missing(c)).alias(c) for c in fields])


def expectations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each named aggregate condition and whether it holds, in one pass: (name, ok)."""
    got = df.agg(*[c.alias(n) for n, c in checks.items()])
    return got.select(F.explode(F.map_entries(F.create_map(*[x for n in checks for x in (F.lit(n), F.coalesce(F.col(f"`{n}`"), F.lit(False)))]))).alias("e")).select(F.col("e.key").alias("name"), F.col("e.value").alias("ok"))
