"""Further queries: connectors on generated payloads, judge comparison, caches, prompts, stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.functions import stats as T
from grainsift.functions import text as X
from grainsift.operators import citations as CI
from grainsift.operators import plugs as P
from grainsift.operators import rules as R
from grainsift.operators import tables as J
from grainsift.operators import tools as TO
from grainsift.operators.dag import Pipeline, Stage
from grainsift.plans.io_q import event_stream
from grainsift.plans.registry import query
from grainsift.session import table
from grainsift.sources import connectors as C
from grainsift.sources import files as IO
from grainsift.streaming import events as E


def tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


@query("s8_json_document", "SELECT count(*) AS regions, CAST(max(r_regionkey) AS BIGINT) AS top FROM region")
def s8_json_document(spark, sf):
    path = IO.scratch(spark, "config")
    one = table(spark, sf, "region").agg(F.to_json(F.struct(F.count("*").alias("regions"), F.max("r_regionkey").alias("top"))).alias("value"))
    one.coalesce(1).write.text(path)
    return IO.read_json_document(spark, path, "regions long, top long")


@query("s10_choice_items", "SELECT 'indexed-' || p_partkey AS id, substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) AS answer, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name ELSE 'none' END AS answer_text FROM part")
def s10_choice_items(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("question"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.col("p_name").alias("c"), F.lit("none").alias("d"), (F.col("p_size") % 4).alias("cop"))
    return C.choice_items({"indexed": p}).select("id", "answer", "answer_text")


@query("s11_pubmed_articles", "SELECT 'PMID:' || n_nationkey AS source_id, n_name AS title, 'AIM: ' || n_name || chr(10) || 'rest' AS abstract, '2020-May' AS publication_date FROM nation")
def s11_pubmed_articles(spark, sf):
    name = F.col("n_name")
    abstract = F.concat(F.lit('<AbstractText Label="AIM">'), name, F.lit("</AbstractText><AbstractText>rest</AbstractText>"))
    article = F.concat(tag("ArticleTitle", name), tag("Abstract", abstract), F.lit("<Journal><JournalIssue><PubDate><Year>2020</Year><Month>May</Month></PubDate></JournalIssue></Journal>"))
    xml = tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", F.col("n_nationkey").cast("string")), tag("Article", article))))
    return C.pubmed_articles(table(spark, sf, "nation").select(xml.alias("xml"))).select("source_id", "title", "abstract", "publication_date")


@query("s15a_arxiv_entries", "SELECT '2401.' || lpad('' || n_nationkey, 5, '0') AS source_id, n_name AS title, '2024-01-02' AS publication_date FROM nation")
def s15a_arxiv_entries(spark, sf):
    ident = F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad(F.col("n_nationkey").cast("string"), 5, "0"))
    xml = tag("entry", F.concat(tag("id", ident), tag("title", F.col("n_name")), tag("summary", F.lit("s")), tag("published", F.lit("2024-01-02T00:00:00Z"))))
    return C.arxiv_entries(table(spark, sf, "nation").select(xml.alias("xml"))).select("source_id", "title", "publication_date")


@query("s15c_clinical_trials", "SELECT 'NCT' || o_orderkey AS source_id, o_orderpriority AS title, o_orderstatus AS status FROM orders")
def s15c_clinical_trials(spark, sf):
    ident = F.struct(F.concat(F.lit("NCT"), F.col("o_orderkey").cast("string")).alias("nctId"), F.col("o_orderpriority").alias("briefTitle"))
    study = F.struct(F.struct(ident.alias("identificationModule"), F.struct(F.col("o_orderstatus").alias("overallStatus")).alias("statusModule")).alias("protocolSection"))
    page = table(spark, sf, "orders").select(F.to_json(F.struct(F.array(study).alias("studies"))).alias("json"))
    return C.clinical_trials(page).select("source_id", "title", F.col("metadata")["status"].alias("status"))


@query("s15b_preprints", """SELECT server AS source, '10.1/' || doc_id AS source_id, 'https://doi.org/10.1/' || doc_id AS url FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY page, doc_id) AS rn
 FROM (SELECT doc_id, 'server' || doc_id % 2 AS server, doc_id // 100 AS page, title FROM (SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN ' an Unmet Need' ELSE '' END AS title FROM documents)) WHERE contains(lower(title), 'unmet need')) WHERE rn <= 20""")
def s15b_preprints(spark, sf):
    """Pages of two servers, a hundred ids each; every third article marks an open question; 40 are wanted in all."""
    title = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, " an Unmet Need").otherwise(""))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("server"), (F.col("doc_id") % 2).cast("string")).alias("server"), F.expr("doc_id div 100").alias("page"), title.alias("title"))
    article = F.struct("doc_id", F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), "title", F.lit("an abstract").alias("abstract"))
    pages = d.groupBy("server", "page").agg(F.to_json(F.struct(F.array_sort(F.collect_list(article)).alias("collection"))).alias("json"))
    return C.preprints(pages, 40).select("source", "source_id", "url")


@query("s15e_target_diseases", """SELECT 'EFO_' || n_nationkey AS source_id, n_name || ' Known drugs: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 0 END || ', unique targets: 0, therapeutic areas: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'area ' || n_regionkey ELSE '' END || '.' AS abstract FROM nation""")
def s15e_target_diseases(spark, sf):
    even, area = F.col("n_nationkey") % 2 == 0, F.struct(F.concat(F.lit("area "), F.col("n_regionkey").cast("string")).alias("name"))
    disease = F.struct("n_name", F.col("n_name").alias("description"), F.when(even, F.struct(F.col("n_regionkey").alias("count"))).alias("knownDrugs"), F.when(even, F.array(area)).alias("therapeuticAreas"))
    page = table(spark, sf, "nation").select(F.concat(F.lit("EFO_"), F.col("n_nationkey").cast("string")).alias("efo_id"), F.to_json(F.struct(F.struct(disease.alias("disease")).alias("data"))).alias("json"))
    return C.target_diseases(page).select("source_id", "abstract")


@query("s15g_proteins", """SELECT '' || s_suppkey AS source_id, 'UniProt: ' || s_name || ' (G' || s_nationkey || ')' AS title, 'Protein: ' || s_name || '. Genes: G' || s_nationkey || '. Function: ' || left(repeat(s_name, 60), 500) || '. Associated diseases: '
 || array_to_string(list_transform(range(least(5, s_suppkey % 7 + 1)), lambda i: 'D' || i || ': ' || s_name), '; ') || '.' AS abstract FROM supplier""")
def s15g_proteins(spark, sf):
    """Entries with comments of three types, functions of over 500 characters, one to seven diseases."""
    value = lambda c: F.struct(c.alias("value"))
    text = F.array(value(F.repeat("s_name", 60)))
    none, no_texts = F.lit(None).cast("struct<diseaseId:string,description:string>"), F.lit(None).cast("array<struct<value:string>>")
    comment = lambda kind, texts, disease: F.struct(F.lit(kind).alias("commentType"), texts.alias("texts"), disease.alias("disease"))
    disease = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 7).cast("int")), lambda i: comment("DISEASE", no_texts, F.struct(F.concat(F.lit("D"), i.cast("string")).alias("diseaseId"), F.col("s_name").alias("description"))))
    comments = F.concat(F.array(comment("CAUTION", F.array(value(F.lit("x"))), none), comment("FUNCTION", text, none)), disease)
    entry = F.struct(
        F.col("s_suppkey").cast("string").alias("primaryAccession"), F.struct(F.struct(value(F.col("s_name")).alias("fullName")).alias("recommendedName")).alias("proteinDescription"),
        F.array(F.struct(value(F.concat(F.lit("G"), F.col("s_nationkey").cast("string"))).alias("geneName"))).alias("genes"), comments.alias("comments"),
    )
    return C.proteins(table(spark, sf, "supplier").select(F.to_json(F.struct(F.array(entry).alias("results"))).alias("json"))).select("source_id", "title", "abstract")


@query("s15h_compounds", """SELECT CAST(p_partkey * 10 + i AS VARCHAR) AS source_id, 'PubChem: ' || CASE WHEN i % 2 = 0 THEN p_name ELSE 'CID:' || (p_partkey * 10 + i) END AS title, CASE WHEN i % 2 = 0 THEN left(repeat(p_type, 200), 2000) ELSE '' END AS abstract FROM part, range(5) r(i)""")
def s15h_compounds(spark, sf):
    """Searches that find seven ids, of which five count; details of every second."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).withColumn("cid", F.col("p_partkey") * 10 + F.col("i"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("i", "cid"))), lambda x: x["cid"])
    searches = p.groupBy("p_partkey", F.col("p_name").alias("query")).agg(F.to_json(F.struct(F.struct(ids.alias("CID")).alias("IdentifierList"))).alias("json"))
    info = F.struct(F.col("p_name").alias("Title"), F.repeat("p_type", 200).alias("Description"))
    details = p.where("i % 2 = 0").select("cid", F.to_json(F.struct(F.struct(F.array(info).alias("Information")).alias("InformationList"))).alias("json"))
    return C.compounds(searches, details).select("source_id", "title", "abstract")


@query("plug_tool_results", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[{"pmid":"' || user_id || '","title":"' || event_type || '","abstract":""}]' WHEN 1 THEN '[{"id":"a","description":"' || user_id || '"},{"raw":"no tab"}]'
 WHEN 2 THEN '{"n":' || user_id || '}' ELSE '{"error":"Unknown tool: teleport"}' END AS result FROM events""")
def plug_tool_results(spark, sf):
    """Calls of a search, a line service, a query service and an unknown tool."""
    pick = lambda *c: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c]), (F.col("event_id") % 4 + 1).cast("int"))
    user = F.col("user_id").cast("string")
    found = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("").alias("pmid"), user.alias("id"), F.col("event_type").alias("title"))).alias("result")).alias("resultList")))
    payload = pick(found, F.concat(F.lit("a\t"), user, F.lit("\tmore\nno tab\n")), F.concat(F.lit('{"data":{"n":'), user, F.lit("}}")), "{}")
    calls = table(spark, sf, "events").select("event_id", pick("pubmed", "kegg", "opentargets", "teleport").alias("tool"), pick("", "find", "", "").alias("operation"), payload.alias("payload"))
    return TO.tool_results(calls).select("event_id", "result")


@query("s15i_genes", "SELECT '' || s_suppkey AS source_id, 'Gene ' || s_name || ' (' || s_name || '): d' AS abstract FROM supplier")
def s15i_genes(spark, sf):
    gene = F.struct(F.struct(F.col("s_suppkey").cast("string").alias("gene_id"), F.col("s_name").alias("symbol"), F.col("s_name").alias("full_name"), F.lit("d").alias("description")).alias("gene"))
    page = table(spark, sf, "supplier").select(F.to_json(F.struct(F.array(gene).alias("genes"))).alias("json"))
    return C.genes(page).select("source_id", "abstract")


@query("s15j_forum_questions", "SELECT '' || page_id AS source_id, url FROM pages")
def s15j_forum_questions(spark, sf):
    q = F.struct(F.col("page_id").cast("string").alias("question_id"), F.col("url").alias("link"), F.col("html").alias("body"))
    page = table(spark, sf, "pages").select(F.lit("s").alias("site"), F.to_json(F.struct(F.array(q).alias("items"))).alias("json"))
    return C.forum_questions(page).select("source_id", "url")


@query("s15j_encyclopedia_pages", "SELECT 'wiki:' || p_partkey AS source_id, p_name AS title, 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS url, left(repeat(p_type || ' ', 200), 3000) AS abstract FROM part WHERE p_partkey % 3 > 0")
def s15j_encyclopedia_pages(spark, sf):
    """A page for each part, of which every third is not found; extracts of over 3000 characters."""
    ident = F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).otherwise("-1")
    pages = F.create_map(ident, F.struct(F.col("p_name").alias("title"), F.repeat(F.concat("p_type", F.lit(" ")), 200).alias("extract")))
    payload = table(spark, sf, "part").select(F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query"))).alias("json"))
    return C.encyclopedia_pages(payload).select("source_id", "title", "url", "abstract")


@query("j11_merge_back", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'unknown' END AS label FROM documents")
def j11_merge_back(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    back = d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("label"))
    return J.left_with_defaults(d.select("doc_id"), back, "doc_id", {"label": "unknown"})


@query("j13_two_runs", "SELECT a.user_id, a.v AS v1, b.v AS v2 FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.user_id = b.user_id")
def j13_two_runs(spark, sf):
    run = lambda kind, name: table(spark, sf, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias(name))
    return run("click", "v1").join(run("view", "v2"), "user_id")


@query("j14_annotations_with_key", "SELECT d.doc_id, quality, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IN (0, 1) AND lang IN ('en', 'fr')")
def j14_annotations_with_key(spark, sf):
    key = table(spark, sf, "documents").select("doc_id", "lang").where(F.col("lang").isin("en", "fr"))
    return table(spark, sf, "labels").where(F.col("quality").isin(0, 1)).select("doc_id", "quality").join(key, "doc_id")


@query("j15_span_in_answer", "SELECT conv_id, turn, instr(text, 'e') AS at FROM conversations WHERE role = 'assistant'")
def j15_span_in_answer(spark, sf):
    c = table(spark, sf, "conversations")
    keys = c.where("role = 'assistant'").select("conv_id", "turn")
    return keys.join(c.select("conv_id", "turn", "text"), ["conv_id", "turn"], "left").select("conv_id", "turn", F.instr("text", "e").cast("long").alias("at"))


@query("t4_binary_kappa", """WITH r AS (SELECT lang = 'en' AS a, source IN ('src1', 'src2', 'src3') AS b FROM documents), t AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE AS o, sum(a::INT)::DOUBLE * sum(b::INT) + (count(*) - sum(a::INT))::DOUBLE * (count(*) - sum(b::INT)) AS e FROM r)
SELECT n::BIGINT AS n, CASE WHEN e = n * n THEN 1.0 ELSE (o * n - e) / (n * n - e) END AS kappa FROM t""")
def t4_binary_kappa(spark, sf):
    d = table(spark, sf, "documents").select((F.col("lang") == "en").alias("a"), F.col("source").isin("src1", "src2", "src3").alias("b"))
    return T.kappa(d, "a", "b").select("n", "kappa")


@query("k9_frozen_ids", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def k9_frozen_ids(spark, sf):
    path = IO.scratch(spark, "frozen")
    IO.write_jsonl(table(spark, sf, "documents").where("lang = 'fr'").select("doc_id").sort("doc_id"), path)
    return IO.read_jsonl(spark, path, "doc_id long")


@query("k2_idempotent_append", "SELECT doc_id, lang FROM documents")
def k2_idempotent_append(spark, sf):
    path = IO.scratch(spark, "append")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    IO.write_jsonl(d.where("doc_id % 2 = 0"), path, append_new_by="doc_id")
    IO.write_jsonl(d, path, append_new_by="doc_id")  # the repeated half is not written again
    return spark.read.schema("doc_id long, lang string").json(path)


@query("l2_sorted_export", "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey")
def l2_sorted_export(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority", "o_orderkey").sort("o_orderpriority", "o_orderkey")



@query("x8_judge_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x8_judge_json(spark, sf):
    answer = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(P.judged_json(answer), "$.k").cast("long").alias("k"))


@query("x20_prompt_block", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def x20_prompt_block(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    return c.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("prompt"))



@query("m6_hashed_embedding")
def m6_hashed_embedding(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", P.hashed_embedding(F.col("text"), 16).alias("v"))


@query("r4_evidence_cache", "SELECT count(*) AS calls, count(*) FILTER (hit) AS hits FROM (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS hit FROM orders)")
def r4_evidence_cache(spark, sf):
    cache = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.lit("evidence").alias("tool"), F.col("c_custkey").cast("string").alias("args"), F.lit("stored").alias("response"))
    calls = table(spark, sf, "orders").select(F.lit("evidence").alias("tool"), F.col("o_custkey").cast("string").alias("args"))
    return P.replayed(calls, cache).agg(F.count("*").alias("calls"), F.count_if("hit").alias("hits"))


@query("r6_client_states", "SELECT CASE WHEN lang = 'en' THEN 'ok' WHEN lang = 'fr' THEN 'empty' ELSE 'error' END AS state, count(*) AS n FROM documents GROUP BY 1")
def r6_client_states(spark, sf):
    df = P.with_answers(table(spark, sf, "documents").select("doc_id", "lang"), "lang", P.table_client({"en": "yes", "fr": ""}), tries=1)
    return df.groupBy(F.col("answer_state").alias("state")).agg(F.count("*").alias("n"))


@query("r9_dag_run", "SELECT 'good' AS stage, 'done' AS state UNION ALL SELECT 'bad', 'failed'")
def r9_dag_run(spark, sf):
    docs = lambda s: table(s, sf, "documents").select("doc_id", "lang")
    stages = [
        Stage("good", docs, IO.scratch(spark, "stage"), checks={"rows": F.count("*") > 10, "langs": F.count_distinct("lang") <= 4}),
        Stage("bad", docs, IO.scratch(spark, "stage"), ("good",), checks={"langs": F.count_distinct("lang") > 99}),
        Stage("never", docs, IO.scratch(spark, "stage"), ("bad",)),
    ]
    return spark.createDataFrame(list(Pipeline(spark, stages).run().items()), "stage string, state string")


@query("plug_extracted_questions", "SELECT doc_id, lang || i AS q FROM documents, (VALUES (1), (2)) v(i) WHERE doc_id % 2 = 0")
def plug_extracted_questions(spark, sf):
    item = lambda i: F.struct(F.concat("lang", F.lit(i)).alias("q"))
    answer = F.to_json(F.struct(F.array(item("1"), item("2")).alias("questions")))
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, answer).otherwise(F.lit('{"none": 1}')).alias("payload"))
    return P.extracted(d, "payload", "q string").select("doc_id", "q")


@query("a35_drop_waterfall", "SELECT CASE WHEN length(text) < 300 THEN 'short' WHEN lang = 'es' THEN 'language' WHEN doc_id % 10 = 0 THEN 'held' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def a35_drop_waterfall(spark, sf):
    reason = R.first_match([("short", F.length("text") < 300), ("language", F.col("lang") == "es"), ("held", F.col("doc_id") % 10 == 0)])
    return R.with_reason_counts(table(spark, sf, "documents"), reason)


@query("a21_corrected_mode", "SELECT event_id, (event_id % 3 = 1)::INT AS loose, (event_id % 3 > 0)::INT AS published FROM events")
def a21_corrected_mode(spark, sf):
    """Cited ids that a result shows plainly, in JSON form or not at all: only the corrected mode reads the JSON form."""
    ident = (F.col("user_id") + 10000).cast("string")
    kind = F.col("event_id") % 3
    seen = F.when(kind == 0, F.concat(F.lit("PMID:"), ident)).when(kind == 1, "nothing").otherwise(F.concat(F.lit('{"pmid": "'), ident, F.lit('"}')))
    said = F.concat(F.lit("PMID:"), ident)
    return table(spark, sf, "events").select("event_id", F.size(CI.ungrounded(said, seen, mode="corrected")).alias("loose"), F.size(CI.ungrounded(said, seen)).alias("published"))


@query("x2_alpha_set", r"SELECT item_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_matches(w, '^\p{L}+$')))) AS n FROM benchmark")
def x2_alpha_set(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(F.array_distinct(X.alpha_tokens(F.col("text")))).cast("long").alias("n"))


@query("r8_spend_alerts", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(sum(value) / 200) AS BIGINT) AS times FROM events GROUP BY user_id HAVING floor(sum(value) / 200) >= 1")
def r8_spend_alerts(spark, sf):
    """Running spend in keyed state; the last alert of a key counts."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = E.drained(E.spend_alerts(event_stream(spark, sf), "user_id", 200.0), "spend")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return out.groupBy("key").agg(F.max("times").alias("times"))
