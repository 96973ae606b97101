"""Queries for aggregations, joins, statistics and windows (A, J, T, W) on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.functions import stats as T
from grainsift.functions import text as X
from grainsift.operators import citations as C
from grainsift.operators import dedup as D
from grainsift.operators import rules as R
from grainsift.operators import scores as S
from grainsift.operators import tables as J
from grainsift.plans.registry import query
from grainsift.session import table

DEC = "decimal(20,4)"


# -- counts -------------------------------------------------------------------------------------------------
@query("a1_group_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 30")
def a1_group_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(30)


@query("a2_transitions", "SELECT prev || ' -> ' || event_type AS step, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY 1")
def a2_transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_type", F.lag("event_type").over(w).alias("prev")).where("prev IS NOT NULL")
    return e.groupBy(F.concat_ws(" -> ", "prev", "event_type").alias("step")).agg(F.count("*").alias("n"))


JUDGED = "SELECT d.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def judged(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source").join(labels, "doc_id", "left")


@query("a3_scores_by_group", f"SELECT lang, count(*) AS n_tasks, count(score) AS n_judged, avg(score) AS avg_score, avg(CASE WHEN score >= 0.6 THEN 1.0 WHEN score < 0.6 THEN 0.0 END) AS pass_rate FROM ({JUDGED}) GROUP BY lang")
def a3_scores_by_group(spark, sf):
    return S.by_group(judged(spark, sf), "lang", "score", 0.6)


@query(
    "a4_scores_by_bucket",
    """SELECT b.bucket, count(d.doc_id) AS n_tasks, count(score) AS n_judged, avg(score) AS avg_score, avg(CASE WHEN score >= 0.6 THEN 1.0 WHEN score < 0.6 THEN 0.0 END) AS pass_rate
FROM (VALUES ('easy'), ('medium'), ('hard'), ('unused')) b(bucket) LEFT JOIN (SELECT d.doc_id, CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 3000 THEN 'medium' ELSE 'hard' END AS bucket, CAST(l.quality AS DOUBLE) AS score
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d ON b.bucket = d.bucket GROUP BY b.bucket""",
)
def a4_scores_by_bucket(spark, sf):
    size = F.col("n_chars")
    rows = judged(spark, sf).withColumn("bucket", F.when(size < 1000, "easy").when(size < 3000, "medium").otherwise("hard"))
    dim = spark.createDataFrame([("easy",), ("medium",), ("hard",), ("unused",)], "bucket string")
    return S.by_group(rows, "bucket", "score", 0.6, dim)


@query("a5_group_by_bucket", "SELECT lang, CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 3000 THEN 'medium' ELSE 'hard' END AS bucket, count(*) AS n FROM documents GROUP BY 1, 2")
def a5_group_by_bucket(spark, sf):
    size = F.col("n_chars")
    return table(spark, sf, "documents").groupBy("lang", F.when(size < 1000, "easy").when(size < 3000, "medium").otherwise("hard").alias("bucket")).agg(F.count("*").alias("n"))


@query("a6_dimension_averages", "SELECT 'discount' AS dim, avg(l_discount) AS mean FROM lineitem UNION ALL SELECT 'tax', avg(l_tax) FROM lineitem UNION ALL SELECT 'quantity', avg(l_quantity) FROM lineitem")
def a6_dimension_averages(spark, sf):
    m = table(spark, sf, "lineitem").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    return m.unpivot([], ["discount", "tax", "quantity"], "dim", "mean")


@query(
    "a7_tool_usage",
    """WITH c AS (SELECT user_id, count(*) AS calls, len(list_intersect(list_distinct(list(event_type)), ['click', 'view', 'error'])) AS used FROM events GROUP BY user_id)
SELECT count(*) AS tasks, CAST(sum(calls) AS BIGINT) AS calls, avg(calls) AS per_task, avg(used / 3.0) AS overlap FROM c""",
)
def a7_tool_usage(spark, sf):
    want = F.lit(["click", "view", "error"])
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.collect_set("event_type").alias("tools"))
    return c.agg(F.count("*").alias("tasks"), F.sum("calls").alias("calls"), F.avg("calls").alias("per_task"), F.avg(F.size(F.array_intersect("tools", want)) / 3.0).alias("overlap"))


@query("a8_totals", f"SELECT l_returnflag, CAST(sum(CAST(l_quantity AS {DEC})) AS DOUBLE) AS total, max(l_extendedprice) AS top, count(*) AS n FROM lineitem GROUP BY 1")
def a8_totals(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast(DEC)).cast("double").alias("total"), F.max("l_extendedprice").alias("top"), F.count("*").alias("n"))


def criteria(spark, sf):
    v = F.when(F.col("l_returnflag") == "A", "met").when(F.col("l_returnflag") == "N", "partial").otherwise("not_met")
    # Line numbers repeat within test orders, so criteria are numbered by all that tells lines apart.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", place.alias("criterion"), "l_quantity", "l_linestatus", v.alias("verdict"))


VALUE = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END"


@query(
    "a9_checklist_score",
    f"""SELECT l_orderkey, coalesce(sum(CASE WHEN l_linenumber <> 2 THEN l_quantity * {VALUE} END) / nullif(sum(CASE WHEN l_linenumber <> 2 THEN l_quantity END), 0), 0) AS score, count(*) AS n_criteria FROM lineitem GROUP BY 1""",
)
def a9_checklist_score(spark, sf):
    c = criteria(spark, sf)
    verdicts = c.where("l_linenumber <> 2").select("l_orderkey", "criterion", "verdict")
    return S.checklist_scores(c.drop("verdict"), verdicts, "l_orderkey", "criterion", "l_quantity", "verdict")


@query(
    "a10_type_satisfaction",
    f"""WITH c AS (SELECT l_linestatus, l_orderkey % 2 AS run, sum(l_quantity * {VALUE}) / sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.l_linestatus, b.l_linestatus) AS l_linestatus, coalesce(b.s, 0) - coalesce(a.s, 0) AS delta FROM (SELECT * FROM c WHERE run = 0) a FULL JOIN (SELECT * FROM c WHERE run = 1) b ON a.l_linestatus = b.l_linestatus""",
)
def a10_type_satisfaction(spark, sf):
    c = criteria(spark, sf)
    run = lambda k: S.type_satisfaction(c.where(F.col("l_orderkey") % 2 == k), "l_linestatus", "l_quantity", "verdict").select("l_linestatus", (F.col("got") / F.col("of")).alias("s"))
    return S.difference(run(0), run(1), "l_linestatus", "s")


def model_scores(spark, sf):
    """One score per user and event type: the events as model runs."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("task"), F.col("event_type").alias("model")).agg((F.max(F.col("value") % 1)).alias("score"))


SCORES = "WITH s AS (SELECT user_id AS task, event_type AS model, max(value % 1) AS score FROM events GROUP BY 1, 2) "
MODELS = ["click", "view", "error"]
IN = "('click', 'view', 'error')"
CORE = f"core AS (SELECT task FROM s WHERE model IN {IN} GROUP BY task HAVING count(DISTINCT model) = 3 AND max(score) < 0.9) "


@query("a11_model_buckets", SCORES + f"SELECT task, sum(CASE WHEN score < 0.9 THEN 1 ELSE 0 END)::BIGINT AS n_fail, avg(score) AS mean_score, CASE WHEN max(score) < 0.9 THEN 'all_fail' WHEN min(score) >= 0.9 THEN 'all_pass' ELSE 'split' END AS bucket FROM s WHERE model IN {IN} GROUP BY task HAVING count(DISTINCT model) = 3")
def a11_model_buckets(spark, sf):
    return S.model_buckets(model_scores(spark, sf), "task", "model", "score", MODELS, 0.9)


@query("a13_leaderboard", SCORES.rstrip() + ", " + CORE + "SELECT model, count(*) AS n, avg(score) AS avg_score, avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0 END) AS solve_rate, count(core.task) AS n_core, avg(CASE WHEN core.task IS NOT NULL THEN CASE WHEN score >= 0.9 THEN 1.0 ELSE 0 END END) AS core_solve_rate FROM s LEFT JOIN core USING (task) GROUP BY model")
def a13_leaderboard(spark, sf):
    s = model_scores(spark, sf)
    return S.leaderboard(s, "task", "model", "score", S.robust_core(s, "task", "model", "score", MODELS, 0.9), 0.9)


@query("a15_robust_core", SCORES.rstrip() + ", " + CORE + "SELECT task FROM core")
def a15_robust_core(spark, sf):
    return S.robust_core(model_scores(spark, sf), "task", "model", "score", MODELS, 0.9)


@query("a12_models_failing", SCORES + f"SELECT task, sum(CASE WHEN score < 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_models_fail FROM s WHERE model IN {IN} GROUP BY task")
def a12_models_failing(spark, sf):
    m = model_scores(spark, sf).where(F.col("model").isin(MODELS)).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("model", "score"))).alias("scores"))
    return m.select("task", F.size(F.filter(F.map_values("scores"), lambda x: x < 0.5)).cast("long").alias("n_models_fail"))


@query("a14_frozen_and_complement", SCORES.rstrip() + ", " + CORE + f"SELECT model, sum(CASE WHEN core.task IS NOT NULL AND score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS k_frozen, sum(CASE WHEN core.task IS NULL AND score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS k_rest, count(score) AS n FROM s LEFT JOIN core USING (task) WHERE model IN {IN} GROUP BY model")
def a14_frozen_and_complement(spark, sf):
    s = model_scores(spark, sf)
    core = S.robust_core(s, "task", "model", "score", MODELS, 0.9).withColumn("frozen", F.lit(True))
    hit = F.col("score") >= 0.5
    rows = s.where(F.col("model").isin(MODELS)).join(core, "task", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    return rows.groupBy("model").agg(F.count_if(F.col("frozen") & hit).alias("k_frozen"), F.count_if(~F.col("frozen") & hit).alias("k_rest"), F.count("score").alias("n"))


SUPPORTS = "SELECT *, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'no' END ELSE 'error' END AS supports FROM orders"


def supports(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return table(spark, sf, "orders").withColumn("supports", F.when(s == "F", "yes").when((s == "O") & (k % 3 == 0), "partial").when(s == "O", "no").otherwise("error"))


@query("a16_judge_table", f"SELECT o_orderpriority, count(*) FILTER (supports = 'yes') AS n_yes, count(*) FILTER (supports = 'partial') AS n_partial, count(*) FILTER (supports = 'no') AS n_no, count(*) FILTER (supports <> 'error') AS n_judged, count(*) FILTER (supports = 'error') AS n_errors FROM ({SUPPORTS}) GROUP BY ROLLUP (o_orderpriority)")
def a16_judge_table(spark, sf):
    return S.judge_table(supports(spark, sf), "o_orderpriority", "supports")


@query("a17_wrong_rate_by_type", f"SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN supports = 'no' THEN 1 ELSE 0 END)::BIGINT AS wrong FROM ({SUPPORTS}) WHERE supports IN ('yes', 'partial', 'no') GROUP BY 1")
def a17_wrong_rate_by_type(spark, sf):
    return supports(spark, sf).where(F.col("supports").isin("yes", "partial", "no")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("supports") == "no").alias("wrong"))


@query("a18_evaluable_split", f"SELECT o_totalprice >= 100000 AS evaluable, count(*) AS n, avg(CASE WHEN supports = 'no' THEN 1.0 ELSE 0 END) AS wrong_rate FROM ({SUPPORTS}) GROUP BY 1")
def a18_evaluable_split(spark, sf):
    return supports(spark, sf).groupBy((F.col("o_totalprice") >= 100000).alias("evaluable")).agg(F.count("*").alias("n"), F.avg((F.col("supports") == "no").cast("int")).alias("wrong_rate"))


@query("a19_composition", "SELECT lang, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang")
def a19_composition(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("a20_behaviour", r"SELECT role, count(*) AS n, avg(CASE WHEN length(trim(text)) < 60 THEN 1.0 ELSE 0 END) AS short_rate, avg(CASE WHEN regexp_matches(text, 'PMID[:\s]*\d{5,9}|\b\d{8}\b') OR regexp_matches(text, 'NCT\d{8}') THEN 1.0 ELSE 0 END) AS cite_rate, avg(length(text)) AS mean_len FROM conversations GROUP BY role")
def a20_behaviour(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.avg((F.length(F.trim(t)) < 60).cast("int")).alias("short_rate"), F.avg(X.has_citation(t).cast("int")).alias("cite_rate"), F.avg(F.length(t)).alias("mean_len"),
    )


@query("a21_ungrounded_rate", """WITH e AS (SELECT user_id, event_id, user_id % 7 AS a, event_id % 7 AS b, event_id % 5 AS c FROM events),
m AS (SELECT user_id, event_id, len(list_distinct([a, c])) AS cited, len(list_filter(list_distinct([a, c]), lambda x: x <> b)) AS loose FROM e)
SELECT CAST(sum(cited) AS BIGINT) AS mentions, CAST(sum(loose) AS BIGINT) AS ungrounded, count(*) FILTER (loose > 0) AS traces FROM m""")
def a21_ungrounded_rate(spark, sf):
    one = lambda x: F.concat(F.lit("PMID:"), x.cast("string"))
    answer = F.concat_ws(" and ", one(F.col("user_id") % 7), one(F.col("event_id") % 5))
    e = table(spark, sf, "events").select(F.size(X.mentioned_pmids(answer)).alias("m"), F.size(C.ungrounded(answer, one(F.col("event_id") % 7))).alias("u"))
    return e.agg(F.sum("m").alias("mentions"), F.sum("u").alias("ungrounded"), F.count_if(F.col("u") > 0).alias("traces"))


@query("a22_screen_summary", "SELECT o_orderkey % 5 AS kind, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM orders GROUP BY 1")
def a22_screen_summary(spark, sf):
    n = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5).alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("a23_injected_controls", "SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS hit, count(*) FILTER (toxic = 1) AS injected, count(*) FILTER (toxic = 0 AND quality = 0) AS false_alarm, count(*) FILTER (toxic = 0) AS negatives FROM labels")
def a23_injected_controls(spark, sf):
    bad, flagged = F.col("toxic") == 1, F.col("quality") == 1
    return table(spark, sf, "labels").agg(F.count_if(bad & flagged).alias("hit"), F.count_if(bad).alias("injected"), F.count_if(~bad & ~flagged).alias("false_alarm"), F.count_if(~bad).alias("negatives"))


@query("a24_token_cost", f"SELECT l_shipmode AS model, CAST(sum(CAST(cost AS decimal(28,10))) AS DOUBLE) AS total FROM (SELECT l_returnflag AS l_shipmode, (l_extendedprice * p.pin + l_quantity * p.pout) / 1e6 AS cost FROM lineitem JOIN (VALUES ('A', 2.0, 8.0), ('N', 0.5, 1.0)) p(m, pin, pout) ON l_returnflag = m) GROUP BY 1")
def a24_token_cost(spark, sf):
    prices = spark.createDataFrame([("A", 2.0, 8.0), ("N", 0.5, 1.0)], "model string, price_in double, price_out double")
    usage = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "model")
    return S.token_cost(usage, prices, "model", "l_extendedprice", "l_quantity").groupBy("model").agg(F.sum(F.col("cost").cast("decimal(28,10)")).cast("double").alias("total"))


@query("a25_yes_share", "SELECT d.source, count(*) AS n, sum(quality)::BIGINT AS yes, avg(quality) AS mean FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def a25_yes_share(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("yes"), F.avg("quality").alias("mean"))


def item_count(benchmark) -> int:
    """Item ids run from 0, so documents are dealt to items by doc_id modulo this."""
    return (benchmark.agg(F.max("item_id")).first()[0] or 0) + 1


@query("a26_citation_relevance", """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS item_id FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS bs FROM benchmark),
j AS (SELECT b.item_id, len(list_intersect(ws, bs)) / len(list_distinct(list_concat(ws, bs))) AS s FROM w JOIN b ON w.item_id = b.item_id)
SELECT item_id, count(*) AS n, avg(s) AS mean_jaccard, count(*) FILTER (s < 0.1) AS weak FROM j GROUP BY item_id""")
def a26_citation_relevance(spark, sf):
    words = lambda c: F.array_distinct(X.tokens(c))
    b = table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("bs"))
    d = table(spark, sf, "documents").select((F.col("doc_id") % item_count(b)).alias("item_id"), words(F.col("text")).alias("ws"))
    s = F.size(F.array_intersect("ws", "bs")) / F.size(F.array_union("ws", "bs"))
    return d.join(b, "item_id").select("item_id", s.alias("s")).groupBy("item_id").agg(F.count("*").alias("n"), F.avg("s").alias("mean_jaccard"), F.count_if(F.col("s") < 0.1).alias("weak"))



@query("a27_validity_gate", f"SELECT count(*) AS total, count(DISTINCT o_custkey) AS unique_ids, count(*) FILTER (supports = 'error') AS invalid, CASE WHEN count(*) FILTER (supports = 'error') / count(*) < 0.05 AND count(*) FILTER (supports = 'yes') / count(*) > 0.9 THEN 'PASS' ELSE 'FAIL' END AS gate FROM ({SUPPORTS})")
def a27_validity_gate(spark, sf):
    bad, good = F.count_if(F.col("supports") == "error"), F.count_if(F.col("supports") == "yes")
    gate = F.when((bad / F.count("*") < 0.05) & (good / F.count("*") > 0.9), "PASS").otherwise("FAIL")
    return supports(spark, sf).agg(F.count("*").alias("total"), F.count_distinct("o_custkey").alias("unique_ids"), bad.alias("invalid"), gate.alias("gate"))


@query("a28_completeness_histogram", """WITH d AS (SELECT (length(text) >= 200)::INT * 2 + (left(text, 100) <> '' AND length(text) >= 100)::INT + (n_chars % 5 >= 2)::INT + (n_chars % 2 >= 1)::INT + ((n_chars % 13) / 10.0 BETWEEN 0 AND 1)::INT AS met FROM documents)
SELECT CASE WHEN met = 6 THEN 'full' WHEN met >= 4 THEN 'high' WHEN met >= 2 THEN 'mid' ELSE 'low' END AS bucket, count(*) AS n FROM d GROUP BY 1""")
def a28_completeness_histogram(spark, sf):
    """Criteria of F8 that documents meet, in four buckets."""
    n, t = F.col("n_chars"), F.col("text")
    met = 6 - F.size(R.completeness_failures(t, t, t, n % 5, n % 2, (n % 13) / 10.0))
    d = table(spark, sf, "documents").select(met.alias("met"))
    return d.groupBy(F.when(F.col("met") == 6, "full").when(F.col("met") >= 4, "high").when(F.col("met") >= 2, "mid").otherwise("low").alias("bucket")).agg(F.count("*").alias("n"))


@query("a29_choice_accuracy", """WITH l AS (SELECT event_type, substr('ABCD', CAST(event_id % 4 AS INT) + 1, 1) AS gold, CASE event_id % 3 WHEN 0 THEN substr('ABCD', CAST(user_id % 4 AS INT) + 1, 1) WHEN 1 THEN 'B' END AS said FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (said = gold) AS correct, count(*) FILTER (said IS NULL) AS unparsed FROM l GROUP BY event_type""")
def a29_choice_accuracy(spark, sf):
    """Letters read out of three forms of answers, against the gold letter."""
    letter = lambda c: F.element_at(F.lit(list("ABCD")), (c % 4 + 1).cast("int"))
    kind = F.col("event_id") % 3
    said = F.when(kind == 0, F.concat(F.lit("Answer: E first. Then Answer: ("), letter(F.col("user_id")), F.lit(")"))).when(kind == 1, "Maybe C, or B. Not E").otherwise("none of these")
    e = table(spark, sf, "events").select("event_type", letter(F.col("event_id")).alias("gold"), X.choice_letter(said, F.lit(4)).alias("said"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("gold")).alias("correct"), F.count_if(F.col("said").isNull()).alias("unparsed"))


@query("a30_source_concentration", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rn FROM c) SELECT CAST(sum(n) FILTER (rn <= 50) AS BIGINT) AS top_n, CAST(sum(n) AS BIGINT) AS all_n FROM r")
def a30_source_concentration(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "o_custkey").limit(50).agg(F.sum("n").alias("top_n"))  # a top-k, no global sort
    return top.join(F.broadcast(c.agg(F.sum("n").alias("all_n"))))


@query("a31_coverage_gaps", "SELECT count(*) FILTER (lang IS NULL OR lang = '') AS lang, count(*) FILTER (text IS NULL OR text = '') AS text, count(*) FILTER (n_chars IS NULL) AS n_chars FROM documents")
def a31_coverage_gaps(spark, sf):
    return S.coverage_gaps(table(spark, sf, "documents"), ["lang", "text", "n_chars"])


@query("a32_contingency", "SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS n_a, count(*) FILTER (toxic = 1 AND quality = 1) AS n_b, count(*) FILTER (toxic = 0 AND quality = 0) AS n_c, count(*) FILTER (toxic = 0 AND quality = 1) AS n_d FROM labels")
def a32_contingency(spark, sf):
    return table(spark, sf, "labels").agg(*T.contingency(F.col("toxic") == 1, F.col("quality") == 0))


@query("a33_leniency", f"SELECT o_orderpriority, count(*) FILTER (supports IN ('yes', 'partial')) AS lenient, count(*) FILTER (supports = 'yes') AS strict, count(*) FILTER (supports = 'partial') AS bought FROM ({SUPPORTS}) GROUP BY 1")
def a33_leniency(spark, sf):
    v = F.col("supports")
    return supports(spark, sf).groupBy("o_orderpriority").agg(F.count_if(v.isin("yes", "partial")).alias("lenient"), F.count_if(v == "yes").alias("strict"), F.count_if(v == "partial").alias("bought"))


@query("a34_citations_per_answer", "SELECT 1 + event_id % 3 AS n_cited, count(*) AS answers FROM events GROUP BY 1")
def a34_citations_per_answer(spark, sf):
    """Distinct citations read out of answers that name one to three trials, some twice."""
    ident = lambda k: F.concat(F.lit("NCT"), F.lpad((F.col("event_id") * 3 + k).cast("string"), 8, "0"))
    said = F.concat(F.lit("As "), ident(0), F.lit(" and again "), ident(0), F.lit(" show. "), F.when(F.col("event_id") % 3 > 0, ident(1)).otherwise(""), F.lit(" "), F.when(F.col("event_id") % 3 > 1, ident(2)).otherwise(""))
    rows = C.citations(table(spark, sf, "events").select("event_id", said.alias("a")), ["event_id"], "a").groupBy("event_id").agg(F.count("*").alias("n_cited"))
    return rows.groupBy("n_cited").agg(F.count("*").alias("answers"))


@query("a36_expectations", "SELECT 'unique_ids' AS name, count(*) = count(DISTINCT doc_id) AS ok FROM documents UNION ALL SELECT 'few_langs', count(DISTINCT lang) <= 3 FROM documents UNION ALL SELECT 'filled', count(text) / count(*) > 0.95 FROM documents")
def a36_expectations(spark, sf):
    checks = {"unique_ids": F.count("*") == F.count_distinct("doc_id"), "few_langs": F.count_distinct("lang") <= 3, "filled": F.count("text") / F.count("*") > 0.95}
    return S.expectations(table(spark, sf, "documents"), checks)


# -- joins --------------------------------------------------------------------------------------------------
@query("j1_left_with_defaults", "SELECT o.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents o LEFT JOIN labels l ON o.doc_id = l.doc_id")
def j1_left_with_defaults(spark, sf):
    return J.left_with_defaults(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query("j2_anti_by_key", r"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j2_anti_by_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j3_star", f"SELECT o_orderpriority, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines, count(DISTINCT c_mktsegment) AS segments FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j3_star(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n"))  # shrink before joining
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(lines, "o_orderkey", "left").join(c, "o_custkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.count_distinct("c_mktsegment").alias("segments"))


@query("j4_join_on_normal_text", r"WITH k AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents) SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY key)")
def j4_join_on_normal_text(spark, sf):
    """Each document with the class of its normal text: copies are members of a class, not pairs."""
    k = table(spark, sf, "documents").select("doc_id", F.md5(X.normal_key(F.col("text"))).alias("key"))
    return k.join(k.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "key").select("doc_id", "class_id", "n")



@query("j5_fallback_key", "SELECT d.doc_id, coalesce(l1.quality, l2.quality) AS quality FROM documents d LEFT JOIN labels l1 ON d.doc_id = l1.doc_id LEFT JOIN labels l2 ON d.doc_id // 2 = l2.doc_id")
def j5_fallback_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 2").alias("half"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), "quality")
    return J.fallback_lookup(d, labels, ["doc_id", "half"], "k", "quality").select("doc_id", "quality")


@query("j6_common_tasks", SCORES + f"SELECT count(*) AS n FROM (SELECT task FROM s WHERE model IN {IN} GROUP BY task HAVING count(DISTINCT model) = 3)")
def j6_common_tasks(spark, sf):
    s = model_scores(spark, sf)
    one = lambda m: s.where(F.col("model") == m).select("task")
    return one("click").join(one("view"), "task").join(one("error"), "task").agg(F.count("*").alias("n"))


@query("j8_first_match", "SELECT l_orderkey, arg_min(l_returnflag, l_linenumber * 10000000 + l_partkey) AS flag FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def j8_first_match(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("flag"))


@query("j9_semi_then_aggregate", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def j9_semi_then_aggregate(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").join(rich, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("j10_by_position", "WITH a AS (SELECT doc_id AS ord, lang FROM documents), b AS (SELECT doc_id AS ord, quality FROM labels) SELECT ord, lang, quality FROM a FULL JOIN b USING (ord)")
def j10_by_position(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang")
    return J.by_position(a, table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), "quality"), "ord")


@query("j12_inner_required", "SELECT c.conv_id, c.turn, q.n FROM conversations c JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) q ON c.conv_id = q.conv_id WHERE c.role = 'assistant'")
def j12_inner_required(spark, sf):
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.where("role = 'assistant'").select("conv_id", "turn").join(q, "conv_id").select("conv_id", "turn", "n")


@query("j17_cache_hit_rate", "WITH c AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 2 = 0) SELECT count(*) AS calls, count(c.user_id) AS hits FROM events e LEFT JOIN c ON e.event_type = c.event_type AND e.user_id = c.user_id WHERE event_id % 2 = 1")
def j17_cache_hit_rate(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    cache = e.where("event_id % 2 = 0").select("event_type", "user_id").distinct().withColumn("hit", F.lit(1))
    return e.where("event_id % 2 = 1").join(cache, ["event_type", "user_id"], "left").agg(F.count("*").alias("calls"), F.count("hit").alias("hits"))


@query("j18_rubric_coverage", "SELECT count(*) AS n, count(l.doc_id) AS covered FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j18_rubric_coverage(spark, sf):
    have = table(spark, sf, "labels").select("doc_id").distinct().withColumn("c", F.lit(1))
    return table(spark, sf, "documents").select("doc_id").join(have, "doc_id", "left").agg(F.count("*").alias("n"), F.count("c").alias("covered"))


# -- statistics ---------------------------------------------------------------------------------------------
@query(
    "t1_wilson_by_lang",
    """WITH c AS (SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS d FROM c)
SELECT lang, 100 * p AS pct, greatest(0.0, 100 * ((p + 1.96 * 1.96 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d)) AS low,
 least(100.0, 100 * ((p + 1.96 * 1.96 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / d)) AS high FROM p""",
)
def t1_wilson_by_lang(spark, sf):
    c = judged(spark, sf).where("score IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.sum("score").alias("k"))
    pct, low, high = T.wilson(F.col("k"), F.col("n"))
    return c.select("lang", pct.alias("pct"), low.alias("low"), high.alias("high"))


@query(
    "t2_kappa_by_lang",
    """WITH r AS (SELECT lang, quality AS a, toxic AS b FROM documents JOIN labels USING (doc_id)), t AS (SELECT lang, count(*)::DOUBLE AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE AS o,
 sum(a)::DOUBLE * sum(b) + (count(*) - sum(a))::DOUBLE * (count(*) - sum(b)) AS e FROM r GROUP BY lang)
SELECT lang, n::BIGINT AS n, o::BIGINT AS agreed, o / n AS po, e / (n * n) AS pe, CASE WHEN e = n * n THEN 1.0 ELSE (o * n - e) / (n * n - e) END AS kappa FROM t""",
)
def t2_kappa_by_lang(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return T.kappa(r, "quality", "toxic", ["lang"])


@query("t3_panel_kappa", SCORES + """, w AS (SELECT task, max(CASE WHEN model = 'click' THEN (score >= 0.9)::INT END) AS x, max(CASE WHEN model = 'view' THEN (score >= 0.9)::INT END) AS y FROM s GROUP BY task), t AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN x = y THEN 1 ELSE 0 END)::DOUBLE AS o, sum(x)::DOUBLE * sum(y) + (count(*) - sum(x))::DOUBLE * (count(*) - sum(y)) AS e FROM w WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT 'click' AS rater_a, 'view' AS rater_b, n::BIGINT AS n, CASE WHEN e = n * n THEN 1.0 ELSE (o * n - e) / (n * n - e) END AS kappa FROM t""")
def t3_panel_kappa(spark, sf):
    s = model_scores(spark, sf).withColumn("pass", (F.col("score") >= 0.9).cast("int"))
    return T.pairwise_kappa(s, "task", "model", "pass", ["click", "view"])


@query("t5_spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1""")
def t5_spearman(spark, sf):
    return T.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])


CELLS = "SELECT lang, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS b, sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN toxic = 0 AND quality = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS d FROM documents JOIN labels USING (doc_id) GROUP BY lang"


@query("t6_risk_and_odds", f"""WITH c AS ({CELLS}), h AS (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END AS x FROM c),
o AS (SELECT *, CASE WHEN a > 0 AND c > 0 THEN (a / (a + b)) / (c / (c + d)) END AS rr, CASE WHEN a > 0 AND c > 0 THEN sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) END AS se, ((a + x) * (d + x)) / ((b + x) * (c + x)) AS odds, sqrt(1 / (a + x) + 1 / (b + x) + 1 / (c + x) + 1 / (d + x)) AS so FROM h)
SELECT lang, rr AS risk_ratio, exp(ln(rr) - 1.96 * se) AS rr_low, exp(ln(rr) + 1.96 * se) AS rr_high, odds AS odds_ratio, exp(ln(odds) - 1.96 * so) AS or_low, exp(ln(odds) + 1.96 * so) AS or_high FROM o""")
def t6_risk_and_odds(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    cells = r.groupBy("lang").agg(*T.contingency(F.col("toxic") == 1, F.col("quality") == 0))
    return cells.select("lang", *[c.alias(n) for n, c in T.risk_and_odds(*map(F.col, ("n_a", "n_b", "n_c", "n_d"))).items()])


@query("t7_ensemble", """WITH m AS (SELECT user_id, event_type, median(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY 1, 2)
SELECT user_id, sum(m * CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.5 ELSE 0 END) AS total, max(s) AS spread, sum(m * CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.5 ELSE 0 END) >= 6 AS passed FROM m GROUP BY 1""")
def t7_ensemble(spark, sf):
    return T.ensemble(table(spark, sf, "events"), "user_id", "event_type", "value", {"click": 0.25, "view": 0.5}, 6.0)


TWO = SCORES + ", w AS (SELECT a.task, a.score AS s1, b.score AS s2 FROM s a JOIN s b ON a.task = b.task WHERE a.model = 'click' AND b.model = 'view') "


def two_runs(spark, sf):
    s = model_scores(spark, sf)
    a, b = (s.where(F.col("model") == m).select("task", F.col("score").alias(n)) for m, n in (("click", "s1"), ("view", "s2")))
    return a.join(b, "task")


@query("t8_retest", TWO + "SELECT count(*) AS n, avg(abs(s1 - s2)) AS mean_change, median(abs(s1 - s2)) AS median_change, count(*) FILTER ((s1 >= 0.9) = (s2 >= 0.9)) AS agreed, count(*) FILTER (s1 < 0.9 AND s2 >= 0.9) AS flips FROM w")
def t8_retest(spark, sf):
    return two_runs(spark, sf).agg(*T.retest(two_runs(spark, sf), "s1", "s2", 0.9))


@query("t9_retention", TWO + "SELECT count(*) AS n, count(*) FILTER (s1 < 0.9 AND s1 >= 0.8) AS boundary, count(*) FILTER (s1 < 0.9 AND s1 >= 0.8 AND s2 < 0.9) AS boundary_retained, count(*) FILTER (s1 < 0.8) AS deep FROM w")
def t9_retention(spark, sf):
    edge = (F.col("s1") < 0.9) & (F.col("s1") >= 0.8)
    return two_runs(spark, sf).agg(F.count("*").alias("n"), F.count_if(edge).alias("boundary"), F.count_if(edge & (F.col("s2") < 0.9)).alias("boundary_retained"), F.count_if(F.col("s1") < 0.8).alias("deep"))


@query("t9b_deep_flips", SCORES + f"SELECT count(*) AS n, count(*) FILTER (top >= 0.97) AS flipped FROM (SELECT task, max(score) AS top FROM s WHERE model IN {IN} GROUP BY task HAVING count(*) = 3)")
def t9b_deep_flips(spark, sf):
    s = model_scores(spark, sf).where(F.col("model").isin(MODELS)).groupBy("task").agg(F.max("score").alias("top"), F.count("*").alias("m")).where("m = 3")
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("top") >= 0.97).alias("flipped"))


@query("t10_bootstrap")
def t10_bootstrap(spark, sf):
    return T.bootstrap_interval(table(spark, sf, "labels"), "quality", "doc_id")


@query("t11_roster_overlap", SCORES + f", a AS (SELECT task FROM s WHERE model IN ('click', 'view') GROUP BY task HAVING count(*) = 2 AND max(score) < 0.9), b AS (SELECT task FROM s WHERE model IN ('view', 'error') GROUP BY task HAVING count(*) = 2 AND max(score) < 0.9) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (task)) AS n_both, (SELECT count(*) FROM (SELECT task FROM a UNION SELECT task FROM b)) AS n_any")
def t11_roster_overlap(spark, sf):
    s = model_scores(spark, sf)
    core = lambda *m: S.robust_core(s, "task", "model", "score", m, 0.9)
    return J.set_overlap(core("click", "view"), core("view", "error"), "task")


@query("t12_similarity_summary", """WITH j AS (SELECT len(list_intersect(regexp_extract_all(lower(left(text, length(text) // 2)), '[a-z0-9]+'), regexp_extract_all(lower(right(text, length(text) - length(text) // 2)), '[a-z0-9]+'))) AS s FROM documents) SELECT avg(s) AS mean, median(s) AS median, max(s)::BIGINT AS top FROM j""")
def t12_similarity_summary(spark, sf):
    half = F.expr("length(text) div 2").cast("int")
    s = F.size(F.array_intersect(X.tokens(F.left("text", half)), X.tokens(F.right("text", F.length("text") - half)))).cast("long")
    return table(spark, sf, "documents").select(s.alias("s")).agg(F.avg("s").alias("mean"), F.median("s").alias("median"), F.max("s").alias("top"))



@query("t13_logprob_delta", "SELECT avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1) AS delta, median(value) FILTER (user_id % 2 = 0) AS core_median, median(value) FILTER (user_id % 2 = 1) AS reference_median FROM events")
def t13_logprob_delta(spark, sf):
    side = lambda k: F.when(F.col("user_id") % 2 == k, F.col("value"))
    return table(spark, sf, "events").agg((F.avg(side(0)) - F.avg(side(1))).alias("delta"), F.median(side(0)).alias("core_median"), F.median(side(1)).alias("reference_median"))


@query("t14_mean_logprob", "SELECT vec_id, (list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE))) / len(list_filter(embedding, lambda x: x > 0)) AS mean FROM embeddings")
def t14_mean_logprob(spark, sf):
    v = F.transform(F.filter("embedding", lambda x: x > 0), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).alias("mean"))


# -- windows, sorting, sampling -----------------------------------------------------------------------------
@query("w1_task_ids", "SELECT doc_id, source || '#' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS task_id, source AS back FROM documents")
def w1_task_ids(spark, sf):
    d = table(spark, sf, "documents").withColumn("task_id", J.task_id(F.col("source"), J.ordinal_in(["source"], ["doc_id"])))
    return d.select("doc_id", "task_id", J.source_of_task(F.col("task_id")).alias("back"))


@query("w2_rank_in_panel", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 10 AS in_top_10 FROM orders")
def w2_rank_in_panel(spark, sf):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", rn.cast("long").alias("place"), (rn <= 10).alias("in_top_10"))


@query("w3_average_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS r FROM part")
def w3_average_ranks(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.average_rank("p_size", ["p_brand"]).alias("r"))


@query("w5_first_per_group", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5")
def w5_first_per_group(spark, sf):
    return J.first_per_group(table(spark, sf, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], 5).select("event_id", "event_type")


@query("w6_round_robin", "WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size < 5 THEN 0 ELSE 1 END AS t, row_number() OVER (PARTITION BY CASE WHEN p_size < 5 THEN 0 ELSE 1 END, p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_partkey FROM r ORDER BY t, r, p_brand LIMIT 300")
def w6_round_robin(spark, sf):
    return J.tiered_round_robin(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.when(F.col("p_size") < 5, 0).otherwise(1), "p_brand", ["p_partkey"], 300).select("p_partkey")


@query("w7_even_stride", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () // 100 AS step FROM orders) WHERE i % step = 0 ORDER BY i LIMIT 100")
def w7_even_stride(spark, sf):
    return J.even_stride(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey")


@query("w9_thirds", "SELECT c_custkey, ntile(3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS third FROM customer")
def w9_thirds(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.ntile(3).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).cast("long").alias("third"))


@query("l1_latest_k", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def l1_latest_k(spark, sf):
    return J.first_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("l3_seeded_sample")
def l3_seeded_sample(spark, sf):
    return J.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id")


@query("l5_stratified_equal", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 10")
def l5_stratified_equal(spark, sf):
    return J.first_per_group(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], [F.md5(F.col("doc_id").cast("string")), "doc_id"], 10)


@query("l6_proportional", "WITH q AS (SELECT lang, greatest(1, round_even(100.0 * count(*) / sum(count(*)) OVER (), 0)::INT) AS q FROM documents GROUP BY lang), r AS (SELECT d.doc_id, d.lang, q, row_number() OVER (PARTITION BY d.lang ORDER BY doc_id) AS rn FROM documents d JOIN q ON d.lang = q.lang) SELECT doc_id, lang FROM r WHERE rn <= q ORDER BY rn, lang LIMIT 100")
def l6_proportional(spark, sf):
    return J.proportional_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 100, ["doc_id"])


@query("l8_samples_per_reason", "SELECT lang, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM (SELECT lang, '' || doc_id AS doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY lang".replace("ORDER BY doc_id) AS ids", "ORDER BY rn) AS ids"))
def l8_samples_per_reason(spark, sf):
    d = J.first_per_group(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 3)
    return d.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))


# -- dedup and sets -----------------------------------------------------------------------------------------
@query("d1_priority_union", r"""WITH u AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS prio FROM documents), k AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM u)
SELECT doc_id FROM (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY prio, doc_id) AS rn FROM k) WHERE rn = 1 AND key <> ''""")
def d1_priority_union(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    kept, _ = D.priority_union([d.where("lang = 'en'"), d.where("lang <> 'en'")], X.normal_key(F.col("text")), "doc_id")
    return kept.select("doc_id")


@query("d1_union_counts", r"""WITH k AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM documents) SELECT count(*) AS total, count(DISTINCT nullif(key, '')) AS kept, count(*) FILTER (key = '') AS empty, count(nullif(key, '')) - count(DISTINCT nullif(key, '')) AS duplicate FROM k""")
def d1_union_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return D.priority_union([d.where("lang = 'en'"), d.where("lang <> 'en'")], X.normal_key(F.col("text")), "doc_id")[1]


@query("d2_first_by_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def d2_first_by_key(spark, sf):
    return D.first_by(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("d4_last_by_key", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def d4_last_by_key(spark, sf):
    return D.last_by(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value").withColumn("o", F.col("event_id")), ["user_id", "event_type"], "o").drop("o")


@query("d5_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def d5_ordered_distinct(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.array_join(F.array_distinct("r.role"), ",").alias("roles"))


@query("d9_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM customer UNION ALL SELECT 's' FROM supplier) GROUP BY 1")
def d9_union_all(spark, sf):
    c, s = table(spark, sf, "customer").select(F.lit("c").alias("kind")), table(spark, sf, "supplier").select(F.lit("s").alias("kind"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"))


@query("d10_set_overlap", "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_a, (SELECT count(DISTINCT doc_id) FROM labels) AS n_b, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_both, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS n_any")
def d10_set_overlap(spark, sf):
    return J.set_overlap(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("d11_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def d11_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("d12_distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT md5(text)) AS texts FROM documents")
def d12_distinct_counts(spark, sf):
    return table(spark, sf, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct(F.md5("text")).alias("texts"))


SIM = "list_reduce(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), lambda s, v: s + v)"


@query("j16_similar_pairs", f"SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {SIM} >= 0.4")
def j16_similar_pairs(spark, sf):
    return D.similar_pairs(table(spark, sf, "embeddings"), 0.4).select("a", "b")


@query("m5_cosine_to_first", f"SELECT y.vec_id, {SIM} AS sim FROM embeddings x, embeddings y WHERE x.vec_id = (SELECT min(vec_id) FROM embeddings)")
def m5_cosine_to_first(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("probe"))  # one row, broadcast
    return e.join(F.broadcast(one)).select("vec_id", D.dot(F.col("probe"), F.col("embedding")).alias("sim"))


@query("d6_semantic_dedup_authority")
def d6_semantic_dedup_authority(spark, sf):
    return D.semantic_dedup(table(spark, sf, "embeddings").withColumn("p", F.col("label")), 0.4, variant="authority", prio=F.col("label"))


@query("d7_semantic_dedup_incremental")
def d7_semantic_dedup_incremental(spark, sf):
    e = table(spark, sf, "embeddings")
    return D.semantic_dedup(e.where("vec_id % 3 > 0"), 0.4, variant="incremental", existing=e.where("vec_id % 3 = 0"))


@query("d8_semantic_dedup_batch")
def d8_semantic_dedup_batch(spark, sf):
    e = table(spark, sf, "embeddings")
    return D.semantic_dedup(e.where("vec_id % 3 > 0"), 0.4, variant="batch", existing=e.where("vec_id % 3 = 0"))


@query("m1_token_jaccard", """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT d.doc_id, b.item_id FROM d, b WHERE len(list_intersect(d.w, b.w)) / len(list_distinct(list_concat(d.w, b.w))) >= 0.3""")
def m1_token_jaccard(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("w"))
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(X.tokens(F.col("text"))).alias("v"))
    return J.similar_token_sets(d, b, "doc_id", "w", "item_id", "v", 0.3).select("doc_id", "item_id")


RUNS = """b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM benchmark),
p AS (SELECT doc_id, b.item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS s, b FROM documents JOIN b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
i AS (SELECT *, unnest(range(0, len(b) + 1)) AS i FROM p), j AS (SELECT *, unnest(range(i, len(b) + 1)) AS j FROM i),
r AS (SELECT doc_id, item_id, any_value(len(b)) AS n, max(j - i) FILTER (i = j OR contains(s, ' ' || array_to_string(b[i + 1 : j], ' ') || ' '))::INT AS run FROM j GROUP BY doc_id, item_id)
"""  # every run of an item, sought in the text; tokens hold no blanks


@query("m2_longest_common_run", f"WITH {RUNS} SELECT doc_id, item_id, run FROM r")
def m2_longest_common_run(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", X.tokens(F.col("text")).alias("b"))
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % item_count(b)).alias("item_id"), X.tokens(F.col("text")).alias("a"))
    return D.longest_common_runs(d.join(b, "item_id"), "a", "b").select("doc_id", "item_id", "run")


@query("m3_run_shares", f"WITH {RUNS} SELECT count(*) AS n, count(*) FILTER (run <= 5) AS short, count(*) FILTER (2 * run >= n) AS half FROM r")
def m3_run_shares(spark, sf):
    """Shares of documents whose longest run in common with their benchmark item is up to five words, or half the item."""
    b = table(spark, sf, "benchmark").select("item_id", X.tokens(F.col("text")).alias("b"))
    d = table(spark, sf, "documents").select((F.col("doc_id") % item_count(b)).alias("item_id"), X.tokens(F.col("text")).alias("a"))
    r = D.longest_common_runs(d.join(b, "item_id"), "a", "b").select("run", F.size("b").alias("n"))
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("run") <= 5).alias("short"), F.count_if(2 * F.col("run") >= F.col("n")).alias("half"))


MENTIONS = "\n".join(
    rf"""m{k} AS (SELECT *, '{kind}' AS id_type, {k} AS kind, regexp_extract_all(s, '{pattern}', 1) AS ids, regexp_extract_all(s, '{pattern}', 0) AS found, string_split_regex(s, '{pattern}') AS parts FROM a),"""
    for k, (kind, pattern) in enumerate(C.KINDS)
)


@query("x5_citation_claims", rf"""WITH a AS (SELECT conv_id, turn, text || ' PMID: ' || (conv_id + 10000) || '. Then NCT00000001 too. ' || text AS s FROM conversations WHERE role = 'assistant'),
{MENTIONS}
m AS (SELECT *, unnest(range(len(ids))) AS i FROM (SELECT * FROM m0 UNION ALL SELECT * FROM m1)),
p AS (SELECT *, length(array_to_string(parts[1 : i + 1], '')) + length(array_to_string(found[1 : i], '')) AS b, length(found[i + 1]) AS n FROM m WHERE list_position(ids, ids[i + 1]) = i + 1),
w AS (SELECT *, regexp_extract(substring(s, 1, b), '[^.!?]*$', 0) AS opening, regexp_extract(substring(s, b + 1), '^[^.!?]*[.!?]', 0) AS ending, regexp_replace(substring(s, greatest(0, b - 360) + 1, b + n - greatest(0, b - 360)), '^\s+|\s+$', '', 'g') AS part FROM p),
c AS (SELECT *, CASE WHEN ending <> '' THEN regexp_replace(opening || ending, '^\s+|\s+$', '', 'g') END AS own, regexp_replace(array_to_string(regexp_extract_all(part, '[^.!?]*[.!?]')[-3:], ''), '^\s+|\s+$', '', 'g') AS tail FROM w),
f AS (SELECT *, own IS NULL OR len(list_filter(regexp_split_to_array(regexp_replace(trim(own), '[^a-zA-Z ]', ' ', 'g'), '\s+'), lambda w: w <> '')) < 6 OR regexp_matches(trim(own), '(?i)^[\s,.;:\)\(*#\]]*((19|20)\d\d|PMID|NCT|et al|doi|Source)') AS weak FROM c)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY kind, i) - 1)::INT AS place, id_type, ids[i + 1] AS id, CASE WHEN weak THEN right(CASE WHEN tail <> '' THEN tail ELSE part END, 400) ELSE left(own, 400) END AS claim FROM f""")
def x5_citation_claims(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    noted = F.concat("text", F.lit(" PMID: "), (F.col("conv_id") + 10000).cast("string"), F.lit(". Then NCT00000001 too. "), F.col("text"))
    return C.citations(c.withColumn("answer", noted), ["conv_id", "turn"], "answer")


# -- incremental --------------------------------------------------------------------------------------------
@query("s4_unfinished", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s4_unfinished(spark, sf):
    return J.unfinished(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", F.col("quality") == 1)


@query("s17_query_grid", "SELECT r_name, p_brand FROM region, (SELECT DISTINCT p_brand FROM part) WHERE NOT (r_name = 'ASIA' AND p_brand = 'Brand#11')")
def s17_query_grid(spark, sf):
    terms, templates = table(spark, sf, "region").select("r_name"), table(spark, sf, "part").select("p_brand").distinct()
    return J.query_grid(terms, templates, spark.createDataFrame([("ASIA", "Brand#11")], "r_name string, p_brand string"))


@query("s18_batches", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS batch FROM documents")
def s18_batches(spark, sf):
    return J.batches(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], 25, ["source"]).select("doc_id", "batch")


@query("r5_merge_versions", "SELECT d.doc_id, CASE WHEN d.n_chars < 500 AND l.quality = 1 THEN 1 ELSE CASE WHEN d.n_chars < 500 THEN 0 ELSE 1 END END AS ok, coalesce(d.n_chars < 500 AND l.quality = 1, false) AS replaced FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def r5_merge_versions(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") < 500, 0).otherwise(1).alias("ok"))
    new = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("ok"))
    return J.merge_versions(old, new, ["doc_id"], F.col("ok") == 1)


@query("r7_budget_stop", "SELECT event_id FROM (SELECT event_id, sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) WHERE spent <= 100")
def r7_budget_stop(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,2)").alias("cost"))
    return R.within_budget(e, "cost", ["event_id"], 100, ["user_id"]).select("event_id")
