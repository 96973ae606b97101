"""Queries that complete the operator list: multi-file scans, paged fetching, predicates, array, map, date and math functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.functions import text as X
from grainsift.operators import citations as CI
from grainsift.operators import plugs as P
from grainsift.operators import scores as S
from grainsift.operators import tables as J
from grainsift.plans.registry import query
from grainsift.session import table
from grainsift.sources import connectors as C
from grainsift.sources import files as IO


@query("s3_many_files", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def s3_many_files(spark, sf):
    root = IO.scratch(spark, "many")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    for lang in ("en", "fr", "de", "es"):
        IO.write_jsonl(d.where(F.col("lang") == lang), f"{root}/part_{lang}")
    return IO.read_jsonl(spark, f"{root}/part_[fd][re]", "doc_id long, lang string").unionByName(IO.read_jsonl(spark, f"{root}/part_es", "doc_id long, lang string")).groupBy("lang").agg(F.count("*").alias("n"))


def stored_pages(query_text: str, cursor: str | None) -> tuple[str | None, str | None]:
    """Three stored pages per query, then an empty one: the offline fetch of the paged source."""
    page = int(cursor or 0)
    return (f"{query_text}:{page}", str(page + 1)) if page < 3 else (None, None)


@query("s15_paged_source", "SELECT r_name AS query, i AS page, r_name || ':' || i AS payload FROM region, (VALUES (0), (1), (2)) v(i)")
def s15_paged_source(spark, sf):
    names = [r.r_name for r in table(spark, sf, "region").select("r_name").collect()]  # the list of queries is the driver's
    return C.read_pages(spark, "grainsift.plans.rest_q.stored_pages", names)


@query("s16_first_seen_pages", "SELECT r_name AS payload FROM region")
def s16_first_seen_pages(spark, sf):
    """Pages of overlapping queries; the first page of each payload counts."""
    names = [r.r_name for r in table(spark, sf, "region").select("r_name").collect()]
    pages = C.read_pages(spark, "grainsift.plans.rest_q.stored_pages", names).withColumn("id", F.substring_index("payload", ":", 1))
    return pages.groupBy("id").agg(F.min("page").alias("p")).select(F.col("id").alias("payload"))


@query("r1_resumed_crawl", "SELECT r_name AS query, count(*) AS pages FROM region, (VALUES (0), (1), (2)) v(i) WHERE r_regionkey > 1 GROUP BY 1")
def r1_resumed_crawl(spark, sf):
    regions = table(spark, sf, "region")
    done = regions.where("r_regionkey <= 1").select(F.col("r_name").alias("query"))
    names = [r.r_name for r in regions.select("r_name").collect()]
    return C.read_pages(spark, "grainsift.plans.rest_q.stored_pages", names, done=done).groupBy("query").agg(F.count("*").alias("pages"))


@query("k1_overwrite", "SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def k1_overwrite(spark, sf):
    path = IO.scratch(spark, "over")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    IO.write_jsonl(d, path)
    IO.write_jsonl(d.where("lang = 'de'"), path)
    return IO.read_jsonl(spark, path, "doc_id long, lang string")


@query("k6_result_set", "SELECT 'per_task' AS part, count(*) AS n FROM documents UNION ALL SELECT 'aggregated', count(DISTINCT lang) FROM documents UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'traces', count(*) FROM documents")
def k6_result_set(spark, sf):
    folder = IO.scratch(spark, "results")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    IO.result_set(d, d.agg(F.count("*").alias("n")), d.groupBy("lang").count(), d, folder)
    parts = [spark.read.option("header", True).csv(f"{folder}/{p}") if p in ("per_task", "aggregated") else spark.read.text(f"{folder}/{p}") for p in ("per_task", "aggregated", "summary", "traces")]
    tagged = [p.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, p in zip(("per_task", "aggregated", "summary", "traces"), parts, strict=True)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])


@query("f11_substantive_claims", r"SELECT count(*) AS n FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 12 AND len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 8")
def f11_substantive_claims(spark, sf):
    return table(spark, sf, "conversations").where(X.is_substantive(F.col("text"))).agg(F.count("*").alias("n"))


@query("f13_bail_phrases", f"SELECT conv_id, turn, len(list_filter([{', '.join(chr(39) + p + chr(39) for p in X.BAIL_PHRASES)}], lambda p: contains(lower(text || CASE WHEN turn % 4 = 1 THEN ' search TOOLS say' ELSE '' END), p))) > 0 AS bail FROM conversations")
def f13_bail_phrases(spark, sf):
    """Whole turns, every fourth with a phrase put behind it."""
    said = F.concat("text", F.when(F.col("turn") % 4 == 1, " search TOOLS say").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.contains_any(said, X.BAIL_PHRASES).alias("bail"))


@query("j7_criteria_by_verdict", "SELECT c.doc_id, count(*) AS matched FROM (SELECT doc_id, unnest([1, 2, 3]) AS k FROM documents) c JOIN (SELECT doc_id, unnest([2, 3, 4]) AS k FROM labels) v ON c.doc_id = v.doc_id AND c.k = v.k GROUP BY 1")
def j7_criteria_by_verdict(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    v = table(spark, sf, "labels").select("doc_id", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("k"))
    return c.join(v, ["doc_id", "k"]).groupBy("doc_id").agg(F.count("*").alias("matched"))


@query("w4_first_and_last", "SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def w4_first_and_last(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", "event_id").alias("first_id"), F.max_by("event_id", "event_id").alias("last_id"))


@query("w8_percent_of_total", "SELECT o_orderstatus, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM orders GROUP BY 1")
def w8_percent_of_total(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.select("o_orderstatus", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))  # one row per status


@query("l4_shuffled_head")
def l4_shuffled_head(spark, sf):
    return J.seeded_sample(table(spark, sf, "labels"), 25, "doc_id", seed=13)


@query("l7_ordered_head", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 40")
def l7_ordered_head(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(40).select("event_id")


@query("d3_distinct_citations", "SELECT event_id, 2 AS n FROM events")
def d3_distinct_citations(spark, sf):
    ident = (F.col("event_id") + 10000).cast("string")
    said = F.concat(F.lit("As PMID: "), ident, F.lit(" shows, and PMID "), ident, F.lit(" again, NCT12345678."))
    rows = CI.citations(table(spark, sf, "events").select("event_id", said.alias("a")), ["event_id"], "a")
    return rows.groupBy("event_id").agg(F.count("*").cast("int").alias("n"))



@query("x12_labels_and_versions", "SELECT event_id, 'b:' || user_id AS rest, 'p' || event_id AS base FROM events")
def x12_labels_and_versions(spark, sf):
    labelled = F.concat(F.lit("a:b:"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", X.after_label(labelled).alias("rest"), X.base_version(F.concat(F.lit("p"), F.col("event_id").cast("string"), F.lit("v3"))).alias("base"))


@query("x14_string_predicates", r"SELECT doc_id, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends, contains(text, 'the') AS has, regexp_matches(text, '^\p{Ll}') AS lower_first, length(text) - length(replace(text, 'e', '')) AS es, length(rtrim(text, '.')) AS n FROM documents")
def x14_string_predicates(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", t.startswith("The").alias("starts"), t.endswith(".").alias("ends"), t.contains("the").alias("has"), t.rlike(r"^\p{Ll}").alias("lower_first"),
        (F.length(t) - F.length(F.replace(t, F.lit("e"), F.lit("")))).cast("long").alias("es"), F.length(F.rtrim(t, F.lit("."))).cast("long").alias("n"),
    )


@query("x15_rounding_inputs", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * 10 + 0.5) / 10 AS r FROM lineitem")
def x15_rounding_inputs(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.floor(F.col("l_extendedprice") * 10 + 0.5) / 10).alias("r"))



@query("x16_array_functions", "SELECT doc_id, list_contains([1, 2, 3], doc_id % 5) AS has, len(list_intersect([1, 2, 3], [doc_id % 5, 3])) AS common, len(list_distinct([doc_id % 2, 1, 1])) AS kinds FROM documents")
def x16_array_functions(spark, sf):
    one = F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>")
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.array_contains(one, d % 5).alias("has"), F.size(F.array_intersect(one, F.array(d % 5, F.lit(3).cast("long")))).cast("long").alias("common"),
        F.size(F.array_distinct(F.array(d % 2, F.lit(1).cast("long"), F.lit(1).cast("long")))).cast("long").alias("kinds"),
    )


@query("x17_map_functions", "SELECT event_id, CASE WHEN event_type = 'click' THEN user_id ELSE -1 END AS clicked, user_id / 2.0 + 0.5 AS mean FROM events")
def x17_map_functions(spark, sf):
    m = F.create_map(F.col("event_type"), F.col("user_id"))
    two = F.create_map(F.lit("a"), F.col("user_id").cast("double"), F.lit("b"), F.lit(1.0))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("click")), F.lit(-1)).alias("clicked"), (F.aggregate(F.map_values(two), F.lit(0.0), lambda a, x: a + x) / 2).alias("mean"))


@query("x18_look_back", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 3 YEAR")
def x18_look_back(spark, sf):
    """Rows of the three years before a given date; the date is a parameter, never the clock."""
    return table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz") - F.expr("INTERVAL 3 YEARS")).select("o_orderkey")


@query("x19_math", "SELECT p_partkey, sqrt(p_size) AS root, ln(p_size + 1) AS log, exp(-p_size) AS e, abs(p_size - 25)::INT AS d FROM part")
def x19_math(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.sqrt(s).alias("root"), F.ln(s + 1).alias("log"), F.exp(-s).alias("e"), F.abs(s - 25).alias("d"))


@query("m4_type_token_ratio", "SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS kinds, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM benchmark")
def m4_type_token_ratio(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.size(F.array_distinct(t)).cast("long").alias("kinds"), F.size(t).cast("long").alias("words"))


@query("r11_replay_with_fallback", "SELECT event_type AS tool, count(*) FILTER (event_id % 2 = 1) AS misses FROM events GROUP BY 1")
def r11_replay_with_fallback(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("tool"), F.col("event_id").cast("string").alias("args"))
    cache = calls.where("cast(args as long) % 2 = 0").withColumn("response", F.lit("stored"))
    got = P.replayed(calls, cache, lambda: lambda tool, args: f"live {tool} {args}")
    return got.groupBy("tool").agg(F.count_if(~F.col("hit") & F.col("response").startswith("live")).alias("misses"))



@query("r12_bounded_tasks", "SELECT count(*) AS n FROM documents")
def r12_bounded_tasks(spark, sf):
    """Concurrency of client calls is the number of partitions, four here."""
    d = table(spark, sf, "documents").select("doc_id", "lang").repartition(4)
    return P.with_answers(d, "lang", P.table_client({k: k for k in ("en", "fr", "de", "es")})).agg(F.count_if(F.col("answer_state") == "ok").alias("n"))


@query("a10_common_tasks", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def a10_common_tasks(spark, sf):
    common = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus").join(common, "l_orderkey", "left_semi").groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("a16_verdict_values", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1")
def a16_verdict_values(spark, sf):
    v = F.when(F.col("l_returnflag") == "A", "Met").when(F.col("l_returnflag") == "N", "partial").otherwise("NO")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", S.verdict_value(v).alias("value")).agg(F.count("*").alias("n"))
