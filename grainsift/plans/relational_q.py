"""Relational breadth: Spark-native operators without a counterpart in the curation workload.

Most are DataFrame plans; some are SQL that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.plans.registry import query
from grainsift.session import TABLES, table


def both(name: str, sql: str) -> None:
    """One SQL text for Spark and DuckDB over the named tables."""
    used = [t for t in TABLES if f" {t}" in sql]

    def run(spark, sf):
        for t in used:
            table(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    query(name, sql)(run)


# -- join strategies and kinds ------------------------------------------------------------------------------
JOIN_SQL = "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def hinted(hint: str):
    def run(spark, sf):
        o = table(spark, sf, "orders").select("o_custkey")
        c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        return o.join(c.hint(hint), "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))

    return run


for _name, _hint in (("merge", "merge"), ("shuffle_hash", "shuffle_hash")):
    query(f"ext_join_{_name}", JOIN_SQL)(hinted(_hint))

KEYS = "(SELECT doc_id AS k, lang FROM documents WHERE doc_id % 2 = 0)"
LAB = "(SELECT doc_id AS k, quality FROM labels WHERE doc_id % 3 = 0)"


def sides(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), "lang"), table(spark, sf, "labels").where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), "quality")


for _kind in ("inner", "left", "right", "full"):
    query(f"ext_join_{_kind}", f"SELECT k, lang, quality FROM {KEYS} a {_kind.upper()} JOIN {LAB} b USING (k)")(lambda spark, sf, kind=_kind: sides(spark, sf)[0].join(sides(spark, sf)[1], "k", kind))


@query("ext_join_semi", f"SELECT k, lang FROM {KEYS} WHERE k IN (SELECT k FROM {LAB})")
def ext_join_semi(spark, sf):
    a, b = sides(spark, sf)
    return a.join(b, "k", "left_semi")


@query("ext_join_anti", f"SELECT k, lang FROM {KEYS} a WHERE NOT EXISTS (SELECT 1 FROM {LAB} b WHERE a.k = b.k)")
def ext_join_anti(spark, sf):
    a, b = sides(spark, sf)
    return a.join(b, "k", "left_anti")


both("ext_join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("ext_join_lateral", "SELECT r_name, t.n_name AS n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 1) t")
both("ext_join_cross_small", "SELECT r_name, q.x AS x FROM region CROSS JOIN (SELECT 1 AS x UNION ALL SELECT 2) q")


@query("ext_range_join", "SELECT p_partkey, b.name FROM part JOIN (VALUES ('small', 1, 10), ('middle', 11, 30), ('large', 31, 50)) b(name, lo, hi) ON p_size BETWEEN lo AND hi")
def ext_range_join(spark, sf):
    bands = spark.createDataFrame([("small", 1, 10), ("middle", 11, 30), ("large", 31, 50)], "name string, lo int, hi int")
    return table(spark, sf, "part").join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "name")


@query("ext_asof_previous", "SELECT event_id, (SELECT max(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND (o.ts, o.event_id) < (e.ts, e.event_id)) AS last_purchase FROM events e WHERE event_type = 'click'".replace("max(o.event_id)", "arg_max(o.event_id, (o.ts, o.event_id))"))
def ext_asof_previous(spark, sf):
    """As-of join without a range join: one window over both sides by key."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return e.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'click'").select("event_id", "last_purchase")


@query("ext_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def ext_interval_join(spark, sf):
    """Interval join as an equi-join: each click is looked up in its hour and in the hour before."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", (F.unix_timestamp("ts") / 3600).cast("long").alias("h"))
    a = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("ta"), F.col("event_id").alias("a"), F.explode(F.array(F.col("h"), F.col("h") + 1)).alias("h"))
    b = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("tb"), F.col("event_id").alias("b"), "h")
    return a.join(b, ["user_id", "h"]).where("tb > ta AND tb <= ta + INTERVAL 1 HOUR").select("a", "b")


# -- aggregation --------------------------------------------------------------------------------------------
both("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
both("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("ext_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("ext_filter_clause", "SELECT event_type, count(*) FILTER (WHERE value > 10) AS big, count(DISTINCT user_id) AS users, max(value) AS top FROM events GROUP BY event_type")
both("ext_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")


@query("ext_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def ext_pivot(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("ext_unpivot", "SELECT p_partkey, 'size' AS k, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def ext_unpivot(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "k", "v")


@query("ext_pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_pricing_summary(spark, sf):
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(dec("l_quantity").alias("sum_qty"), dec("l_extendedprice").alias("sum_base"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("ext_approximate")
def ext_approximate(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 10000).alias("median"), F.hll_sketch_estimate(F.hll_sketch_agg("event_id")).alias("events"))


# -- windows ------------------------------------------------------------------------------------------------
both(
    "ext_window_ranks",
    """SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey)""".replace("rank() OVER w AS rk, dense_rank() OVER w AS dr", "CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr"),
)
both("ext_window_neighbours", "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
both("ext_window_rows_frame", "SELECT event_id, sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events".replace("sum(event_id % 10)", "CAST(sum(event_id % 10)").replace("CURRENT ROW) AS s", "CURRENT ROW) AS BIGINT) AS s"))
both("ext_window_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")


@query("ext_sessions", "SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id")
def ext_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 2 HOURS")
    return table(spark, sf, "events").select("user_id", F.when(gap, 0).otherwise(1).alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"))


# -- sorting, sets, subqueries ------------------------------------------------------------------------------
both("ext_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
both("ext_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("ext_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("ext_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("ext_subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
both("ext_subquery_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
both("ext_subquery_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
both("ext_subquery_correlated", "SELECT o_orderkey FROM orders a WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)")
both("ext_cte_multi", "WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM per) SELECT o_custkey FROM per, top WHERE n = m")

# -- scalar functions ---------------------------------------------------------------------------------------
both("ext_strings", "SELECT doc_id, upper(lang) AS u, lpad(source, 8, '*') AS p, substring(text, 3, 5) AS s, reverse(lang) AS r, levenshtein(lang, source) AS d, repeat(lang, 2) AS rep, instr(text, 'the') AS pos FROM documents".replace("levenshtein(lang, source) AS d", "CAST(levenshtein(lang, source) AS BIGINT) AS d").replace("instr(text, 'the') AS pos", "CAST(instr(text, 'the') AS BIGINT) AS pos"))


@query("ext_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, year(o_orderdate) AS y, dayofyear(o_orderdate) AS doy, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next FROM orders")
def ext_dates(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("m"), F.year(d).cast("long").alias("y"), F.dayofyear(d).cast("long").alias("doy"),
        F.datediff(F.to_date(d), F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_format(d + F.expr("INTERVAL 1 MONTH"), "yyyy-MM-dd").alias("next"),
    )


@query("ext_math", "SELECT p_partkey, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, p_partkey % 7 AS m, power(p_size, 2) AS sq, sign(p_size - 25)::DOUBLE AS sg, greatest(p_size, 25) AS g FROM part")
def ext_math(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.ceil("p_retailprice").alias("c"), F.floor("p_retailprice").alias("f"), F.pmod("p_partkey", F.lit(7)).alias("m"), F.pow("p_size", F.lit(2)).alias("sq"), F.signum(F.col("p_size") - 25).alias("sg"), F.greatest("p_size", F.lit(25)).alias("g"))


@query("ext_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ext_json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("ext_json_variant", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def ext_json_variant(spark, sf):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("ext_arrays", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS pos, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(embedding[1] AS DOUBLE) AS head FROM embeddings")
def ext_arrays(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("pos"), F.array_max(e).cast("double").alias("top"), e[0].cast("double").alias("head"))


@query("ext_explode", "SELECT role, w, count(*) AS n FROM (SELECT role, unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY 1, 2 HAVING count(*) >= 50")
def ext_explode(spark, sf):
    w = table(spark, sf, "conversations").select("role", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return w.groupBy("role", "w").agg(F.count("*").alias("n")).where("n >= 50")


@query("ext_xpath", "SELECT n_nationkey, n_name AS name FROM nation")
def ext_xpath(spark, sf):
    doc = F.concat(F.lit("<a><b>"), F.col("n_name"), F.lit("</b></a>"))
    return table(spark, sf, "nation").select("n_nationkey", F.xpath_string(doc, F.lit("a/b")).alias("name"))


# -- Python plug points -------------------------------------------------------------------------------------
@query("ext_pandas_scalar", "SELECT p_partkey, p_retailprice * 1.1 AS v FROM part")
def ext_pandas_scalar(spark, sf):
    @F.pandas_udf("double")
    def raised(v):
        return v * 1.1

    return table(spark, sf, "part").select("p_partkey", raised("p_retailprice").alias("v"))


@query("ext_apply_in_pandas", "SELECT p_brand, count(*) AS n, max(p_size)::BIGINT AS top FROM part GROUP BY 1")
def ext_apply_in_pandas(spark, sf):
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_brand": [pdf.p_brand.iloc[0]], "n": [len(pdf)], "top": [int(pdf.p_size.max())]})

    return table(spark, sf, "part").select("p_brand", "p_size").groupBy("p_brand").applyInPandas(one, "p_brand string, n long, top long")


@query("ext_cogroup", "SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def ext_cogroup(spark, sf):
    import pandas as pd

    def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey").groupBy("k")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey").groupBy("k")
    return c.cogroup(s).applyInPandas(meet, "k int, customers long, suppliers long")


@query("ext_udtf", "SELECT n_nationkey, unnest(string_split(n_name, '')) AS ch FROM nation")
def ext_udtf(spark, sf):
    @F.udtf(returnType="ch string")
    class Letters:
        def eval(self, s: str):
            for ch in s:
                yield (ch,)

    spark.udtf.register("letters_of", Letters)
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, ch FROM nation, LATERAL letters_of(n_name)")
