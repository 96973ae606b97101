"""Queries for filters, rules and scalar functions (F, X) on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.functions import text as X
from grainsift.operators import rules as R
from grainsift.plans.registry import query
from grainsift.session import table


def docs(spark, sf, *cols):
    return table(spark, sf, "documents").select(*cols)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_any(text: str, phrases) -> str:
    return f"len(list_filter({sql_list(phrases)}, lambda p: contains(lower({text}), p))) > 0"


# Test texts hold no question mark, so the rule query asks them as questions: text || '?'.
@query(
    "f1_quality_reason",
    rf"""
WITH q AS (SELECT doc_id, text || '?' AS q, source FROM documents)
SELECT doc_id, CASE WHEN length(q) < 30 THEN 'short'
  WHEN starts_with(q, 'How can we better understand') THEN 'vague_prefix'
  WHEN {sql_any("q", R.META_PHRASES)} THEN 'meta_question' WHEN {sql_any("q", R.REVIEW_FRAGMENTS)} THEN 'review_fragment'
  WHEN {sql_any("q", R.GENERIC_QUESTIONS)} THEN 'generic_template' WHEN regexp_matches(q, '^\p{{Ll}}') THEN 'lowercase_start'
  WHEN ends_with(regexp_replace(regexp_replace(q, '\?+$', ''), '\s+$', ''), '.') THEN 'title_in_question'
  WHEN {sql_any("q", R.GARBLED_PHRASES)} THEN 'garbled'
  WHEN length(q) < 60 AND (len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) < 6
       OR length(q) - length(replace(q, '?', '')) > 1) THEN 'short_broken' END AS reason
FROM q
""",
)
def f1_quality_reason(spark, sf):
    return docs(spark, sf, "doc_id", R.quality_reason(F.concat("text", F.lit("?"))).alias("reason"))



@query(
    "f2_short_document_guard",
    """SELECT doc_id, length(CASE WHEN length(text) > 15000 THEN left(text, 15000) || chr(10) || '[truncated]' ELSE text END) AS n
FROM documents WHERE length(trim(text)) >= 100""",
)
def f2_short_document_guard(spark, sf):
    kept = docs(spark, sf, "doc_id", R.content(F.lit(None).cast("string"), F.col("text")).alias("c")).where("c IS NOT NULL")
    return kept.select("doc_id", F.length("c").cast("long").alias("n"))


@query("f3_open_question_signals", f"""SELECT doc_id, {sql_any("text", X.OPEN_QUESTION_SIGNALS)} AS open_question, {sql_any("text", X.EVIDENCE_GAP_SIGNALS)} AS evidence_gap FROM documents""")
def f3_open_question_signals(spark, sf):
    t = F.col("text")
    return docs(spark, sf, "doc_id", X.contains_any(t, X.OPEN_QUESTION_SIGNALS).alias("open_question"), X.contains_any(t, X.EVIDENCE_GAP_SIGNALS).alias("evidence_gap"))


@query(
    "f4_task_filter",
    """SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_totalprice BETWEEN 50000 AND 200000 AND o_orderstatus = 'O'""",
)
def f4_task_filter(spark, sf):
    keep = R.task_filter(
        l1=F.col("o_orderpriority"), difficulty=F.col("o_totalprice"), status=F.col("o_orderstatus"), tools=F.array(F.col("o_orderpriority")), want_l1="HIGH", low=50000, high=200000, want_status="O",
    )
    return table(spark, sf, "orders").where(keep).select("o_orderkey")


@query("f5_coalesced_keys", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS key FROM documents")
def f5_coalesced_keys(spark, sf):
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return docs(spark, sf, "doc_id", F.coalesce(R.coalesced(first, F.col("source")), F.lit("none")).alias("key"))


@query(
    "f6_difficulty_bucket",
    """SELECT CASE WHEN x >= 1.0 AND x < 2.5 THEN 'easy' WHEN x >= 2.5 AND x < 3.5 THEN 'medium' ELSE 'hard' END AS bucket, count(*) AS n
FROM (SELECT p_size / 10.0 AS x FROM part) GROUP BY 1""",
)
def f6_difficulty_bucket(spark, sf):
    return table(spark, sf, "part").groupBy(R.difficulty_bucket(F.col("p_size") / 10.0).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "f7_structural_issues",
    """SELECT doc_id, concat_ws(',', CASE WHEN length(text) NOT BETWEEN 30 AND 1000 THEN 'length' END, CASE WHEN lang NOT IN ('en','fr') THEN 'vocabulary' END,
 CASE WHEN NOT (n_chars % 7 BETWEEN 1 AND 5) THEN 'difficulty' END) AS issues FROM documents""",
)
def f7_structural_issues(spark, sf):
    found = R.issues([("length", F.length("text").between(30, 1000)), ("vocabulary", F.col("lang").isin("en", "fr")), ("difficulty", (F.col("n_chars") % 7).between(1, 5))])
    return docs(spark, sf, "doc_id", F.array_join(found, ",").alias("issues"))


@query(
    "f8_completeness",
    """WITH d AS (SELECT doc_id, text, left(text, 120) AS u, n_chars % 5 AS c, n_chars % 2 AS t, (n_chars % 13) / 10.0 AS s FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 200 THEN 'current_knowledge' END, CASE WHEN length(u) < 100 THEN 'unknown_aspects' END, CASE WHEN length(text) < 200 THEN 'answer_summary' END,
 CASE WHEN c < 2 THEN 'citations' END, CASE WHEN t < 1 THEN 'tools' END, CASE WHEN NOT s BETWEEN 0 AND 1 THEN 'self_score' END) AS failures FROM d""",
)
def f8_completeness(spark, sf):
    n = F.col("n_chars")
    found = R.completeness_failures(F.col("text"), F.left("text", F.lit(120)), F.col("text"), n % 5, n % 2, (n % 13) / 10.0)
    return docs(spark, sf, "doc_id", F.array_join(found, ",").alias("failures"))


STOP = sql_list(X.QUERY_STOPWORDS)


@query(
    "f9_semantic_warnings",
    f"""WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS q, max(CASE WHEN turn = 1 THEN text END) AS a FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, regexp_extract_all(lower(a), '[a-z0-9]+') AS ws, list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w))) AS es FROM c WHERE a IS NOT NULL AND q IS NOT NULL)
SELECT conv_id, concat_ws(',', CASE WHEN len(ws) > 0 AND len(list_distinct(ws)) / len(ws) < 0.3 THEN 'type_token_ratio' END,
 CASE WHEN len(es) > 0 AND len(list_intersect(es, list_distinct(ws))) / len(es) < 0.2 THEN 'entity_overlap' END) AS warnings FROM t""",
)
def f9_semantic_warnings(spark, sf):
    c = table(spark, sf, "conversations").where("turn < 2").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("a"))
    found = R.semantic_warnings(F.col("q"), F.col("a"), F.array().cast("array<string>"))
    return c.where("a IS NOT NULL AND q IS NOT NULL").select("conv_id", F.array_join(found, ",").alias("warnings"))


@query(
    "f10_claim_predicates",
    r"""WITH t AS (SELECT doc_id, text AS c, text FROM documents)
SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(trim(c), '[^a-zA-Z ]', ' ', 'g'), '\s+'), lambda w: w <> '')) < 6
   OR regexp_matches(trim(c), '(?i)^[\s,.;:\)\(*#\]]*((19|20)\d\d|PMID|NCT|et al|doi|Source)') AS fragment,
 len(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> '')) >= 12 AND len(regexp_extract_all(c, '[A-Za-z]{3,}')) >= 8 AS substantive FROM t""",
)
def f10_claim_predicates(spark, sf):
    c = F.col("text")
    return docs(spark, sf, "doc_id", X.is_fragment(c).alias("fragment"), X.is_substantive(c).alias("substantive"))



REFUSAL_SQL = X.REFUSAL.replace("'", "''")


@query(
    "f12_answer_state",
    f"""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 20 THEN 'empty' WHEN regexp_matches(text, '{REFUSAL_SQL}') THEN 'refusal' ELSE 'attempt' END AS state
FROM conversations WHERE role = 'assistant'""",
)
def f12_answer_state(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.answer_state(F.col("text")).alias("state"))


@query(
    "f14_trajectory_waterfall",
    f"""WITH t AS (SELECT event_id, 'note ' || event_type || ' PMID:' || (user_id % 50) || ' and more text here' AS a, ['' || (user_id % 50), '' || (event_id % 50)] AS r0, value, event_id FROM events),
u AS (SELECT a, CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 3 = 0 THEN [r0[2]] ELSE r0 END AS r, value, event_id FROM t)
SELECT CASE WHEN event_id % 11 = 0 THEN 'no_question' WHEN len(r) = 0 THEN 'bail'
  WHEN len(list_filter(regexp_extract_all(a, '(?i)\\bPM(?:ID|C)[:\\s]?(\\d+)\\b', 1), lambda x: NOT list_contains(r, x))) > 0 THEN 'ungrounded' WHEN NOT value >= 20 THEN 'low_score' ELSE 'kept' END AS reason, count(*) AS n FROM u GROUP BY 1""".replace("\\\\", "\\"),
)
def f14_trajectory_waterfall(spark, sf):
    e = table(spark, sf, "events")
    user, ev = (F.col("user_id") % 50).cast("string"), (F.col("event_id") % 50).cast("string")
    answer = F.concat(F.lit("note "), "event_type", F.lit(" PMID:"), user, F.lit(" and more text here"))
    retrieved = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 3 == 0, F.array(ev)).otherwise(F.array(user, ev))
    return R.with_reason_counts(e, R.trajectory_reason(answer, retrieved, F.col("value"), F.col("event_id") % 11 != 0, 20.0))


IDS = "CASE doc_id % 6 WHEN 0 THEN 'PMID:' || doc_id WHEN 1 THEN 'NCT:NCT0000' || doc_id WHEN 2 THEN '2401.' || lpad('' || doc_id, 5, '0') WHEN 3 THEN 'hsa0' || doc_id WHEN 4 THEN 'Q9Y6K9' ELSE 'x' || doc_id END"


def sid():
    d = F.col("doc_id").cast("string")
    return F.expr(IDS.replace("'' || doc_id", "cast(doc_id as string)")) if d is not None else None


@query(
    "f15_source_type",
    f"""SELECT doc_id, CASE WHEN starts_with(s, 'PMID') THEN 'pubmed' WHEN starts_with(s, 'NCT') THEN 'trial' WHEN regexp_matches(s, '^\\d{{4}}\\.\\d{{4,5}}') THEN 'arxiv'
 WHEN starts_with(s, 'hsa') OR regexp_matches(s, '^[OPQ][0-9][A-Z0-9]{{3}}[0-9]') OR starts_with(s, 'map') THEN 'synthetic' ELSE 'unknown' END AS kind FROM (SELECT doc_id, {IDS} AS s FROM documents)""",
)
def f15_source_type(spark, sf):
    return docs(spark, sf, "doc_id", R.source_type(sid()).alias("kind"))


@query("f16_source_of", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jla' WHEN 1 THEN 'nice' WHEN 2 THEN 'preprint' ELSE source END AS origin FROM documents")
def f16_source_of(spark, sf):
    s = F.expr("CASE doc_id % 4 WHEN 0 THEN 'JLA:a#1' WHEN 1 THEN 'NICE:NG1/2' WHEN 2 THEN '10.1101/x' ELSE 'PMID:1' END")
    return docs(spark, sf, "doc_id", R.source_of(s, F.col("source")).alias("origin"))


SCREEN = """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'trial' WHEN 1 THEN 'pubmed' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'synthetic' ELSE 'unknown' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RECRUITING' ELSE 'WITHDRAWN' END AS status, o_custkey % 2 = 0 AS results,
  CASE WHEN o_custkey % 3 = 0 THEN 'open' ELSE 'answered' END AS label, o_custkey % 7 AS followups FROM orders),
f AS (SELECT o_orderkey, results, CASE kind WHEN 'synthetic' THEN 'synthetic_template' WHEN 'trial' THEN CASE WHEN status = 'WITHDRAWN' THEN 'trial_dead'
   WHEN status = 'COMPLETED' AND results AND label = 'open' THEN 'trial_resolved_but_open' WHEN status = 'COMPLETED' THEN 'trial_completed' ELSE 'ok' END
 WHEN 'pubmed' THEN CASE WHEN followups >= 5 THEN 'heavy_followup_recheck' WHEN followups = 0 THEN 'no_followup_evidence' ELSE 'ok' END
 WHEN 'arxiv' THEN 'arxiv_citation_check_needed' ELSE 'unverifiable_source' END AS flag FROM s) """


def screened(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.element_at(F.lit(["trial", "pubmed", "arxiv", "synthetic", "unknown"]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RECRUITING").otherwise("WITHDRAWN")
    results = F.col("o_custkey") % 2 == 0
    label = F.when(F.col("o_custkey") % 3 == 0, "open").otherwise("answered")
    return o.select("o_orderkey", results.alias("results"), R.screen_flag(kind, status, results, label, F.col("o_custkey") % 7, 5).alias("flag"))


@query("f17_contamination_screen", SCREEN + "SELECT o_orderkey, flag FROM f")
def f17_contamination_screen(spark, sf):
    return screened(spark, sf).select("o_orderkey", "flag")


@query(
    "f18_still_open_severity",
    SCREEN + """SELECT o_orderkey, CASE flag WHEN 'trial_completed' THEN CASE WHEN results THEN 'high_risk' ELSE 'recheck' END WHEN 'unverifiable_source' THEN 'unverifiable'
 WHEN 'arxiv_citation_check_needed' THEN 'unverifiable' WHEN 'heavy_followup_recheck' THEN 'none' WHEN 'ok' THEN 'none' ELSE 'recheck' END AS severity FROM f""",
)
def f18_still_open_severity(spark, sf):
    detail = F.concat(F.lit("COMPLETED; results="), F.initcap(F.col("results").cast("string")))
    return screened(spark, sf).select("o_orderkey", R.severity(F.col("flag"), detail).alias("severity"))


@query(
    "f19_status_normaliser",
    "SELECT s, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'open' WHEN 2 THEN 'partially_answered' ELSE 'unknown' END AS s FROM orders) GROUP BY s",
)
def f19_status_normaliser(spark, sf):
    raw = F.element_at(F.lit([" Closed ", "PARTIALLY_OPEN", "partially resolved", "???"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").groupBy(R.normal_status(raw).alias("s")).agg(F.count("*").alias("n"))


@query(
    "f20_remediation",
    SCREEN + """SELECT action, count(*) AS n FROM (SELECT CASE WHEN flag IN ('synthetic_template', 'trial_dead') THEN 'remove' WHEN flag = 'trial_resolved_but_open' THEN 'relabel'
 WHEN flag = 'trial_completed' THEN 'flag' ELSE 'keep' END AS action FROM f) GROUP BY action""",
)
def f20_remediation(spark, sf):
    return screened(spark, sf).groupBy(R.remediation(F.col("flag")).alias("action")).agg(F.count("*").alias("n"))


@query(
    "f21_domain_normaliser",
    """SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 'Alloys' WHEN contains(p_type, 'STEEL') THEN 'Iron' WHEN contains(p_type, 'COPPER') THEN 'Pure' ELSE 'Other' END AS domain FROM part""",
)
def f21_domain_normaliser(spark, sf):
    exact = spark.createDataFrame([("anodized nothing", "Nothing")], "name string, canonical string")
    keywords = spark.createDataFrame([(0, "brass", "Alloys"), (1, "steel", "Iron"), (2, "copper", "Pure")], "ord int, keyword string, canonical string")
    return R.normal_domain(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", exact, keywords).select("p_partkey", "domain")


@query(
    "f22_citation_guardrail",
    """WITH e AS (SELECT event_id, ['' || user_id % 5, '' || event_id % 5] AS cited, ['' || user_id % 5, '1'] AS valid, event_id % 4 AS n, event_id % 9 <> 0 AS ok FROM events),
w AS (SELECT *, len(list_filter(list_distinct(cited), lambda x: NOT list_contains(valid, x))) AS wrong FROM e)
SELECT event_id, CASE WHEN n = 0 THEN 'unknown' WHEN NOT ok THEN 'open' WHEN wrong > 0 THEN 'unknown' ELSE 'answered' END AS status,
 CASE WHEN n = 0 THEN 'no_evidence' WHEN NOT ok THEN 'llm_fail' WHEN wrong > 0 THEN 'hallucinated:' || wrong ELSE 'ok' END AS guardrail FROM w""",
)
def f22_citation_guardrail(spark, sf):
    s = lambda c: (F.col(c) % 5).cast("string")
    status, guard = R.guarded_verdict(F.lit("answered"), F.array(s("user_id"), s("event_id")), F.array(s("user_id"), F.lit("1")), F.col("event_id") % 4, F.lit("open"), F.col("event_id") % 9 != 0)
    return table(spark, sf, "events").select("event_id", status.alias("status"), guard.alias("guardrail"))


def redact_sql(text: str) -> str:
    for pattern, put in X.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


@query("f23_redaction", f"SELECT doc_id, md5({redact_sql('text')}) AS digest, regexp_matches({redact_sql('text')}, '{'|'.join(f'(?:{p})' for p in X.SURVIVORS)}') AS leaks FROM documents")
def f23_redaction(spark, sf):
    clean = X.redacted(F.col("text"))
    return docs(spark, sf, "doc_id", F.md5(clean).alias("digest"), X.leaks(clean).alias("leaks"))


@query(
    "f24_choice_letter",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'D' WHEN event_id % 3 = 1 THEN 'B' END AS letter FROM events""",
)
def f24_choice_letter(spark, sf):
    said = F.element_at(F.lit(["Answer: A. On reflection, Answer: (D) but E", "Maybe C, or B. Not E", "none of these"]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", X.choice_letter(said, F.lit(4)).alias("letter"))


@query("f25_unwrapped_arguments", "SELECT event_id, user_id AS q, replace(event_type, '-', '_') AS tool FROM events")
def f25_unwrapped_arguments(spark, sf):
    inner = F.to_json(F.struct(F.col("user_id").alias("q")))
    once = F.to_json(F.struct(inner.alias("arguments")))
    twice = F.to_json(F.struct(once.alias("arguments"), F.col("event_type").alias("name")))
    wrapped = F.when(F.col("event_id") % 3 == 0, inner).when(F.col("event_id") % 3 == 1, once).otherwise(twice)
    return table(spark, sf, "events").select("event_id", F.get_json_object(X.unwrapped_arguments(wrapped), "$.q").cast("long").alias("q"), X.tool_name(F.col("event_type")).alias("tool"))


@query(
    "f26_truncation",
    "SELECT doc_id, length(CASE WHEN length(text) > 800 THEN left(text, 800) || chr(10) || '... [truncated]' ELSE text END) AS n, length(text) > 800 AS cut FROM documents",
)
def f26_truncation(spark, sf):
    text, cut = X.truncated(F.col("text"), 800)
    return docs(spark, sf, "doc_id", F.length(text).cast("long").alias("n"), cut.alias("cut"))


@query("x1_normal_key", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents")
def x1_normal_key(spark, sf):
    return docs(spark, sf, "doc_id", F.md5(X.normal_key(F.col("text"))).alias("key"))


@query("x2_token_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_matches(w, '^\p{L}+$'))) AS n_alpha FROM documents")
def x2_token_counts(spark, sf):
    t = X.tokens(F.col("text"))
    return docs(spark, sf, "doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(X.alpha_tokens(F.col("text"))).cast("long").alias("n_alpha"))


@query("x3_keyword_query", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z\\-]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z\\-]{{3,}}'), 1) AS i FROM documents),
f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE NOT list_contains({STOP}, w) GROUP BY doc_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
SELECT d.doc_id, coalesce(string_agg(w, ' AND ' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND rn <= 6 GROUP BY d.doc_id""")
def x3_keyword_query(spark, sf):
    return docs(spark, sf, "doc_id", X.keyword_query(F.col("text")).alias("keywords"))


@query("x4_identifiers", r"""WITH t AS (SELECT event_id, 'see PMID: ' || (10000 + user_id) || ', pmc' || event_id || ' and NCT' || lpad('' || event_id, 8, '0') AS s FROM events)
SELECT event_id, array_to_string(regexp_extract_all(s, '(?i)PMID[:\s#]*(\d{5,9})', 1), ',') AS strict, array_to_string(regexp_extract_all(s, '(?i)\bPM(?:ID|C)[:\s]?(\d+)\b', 1), ',') AS loose, array_to_string(regexp_extract_all(s, '(NCT\d{8})', 1), ',') AS trials FROM t""")
def x4_identifiers(spark, sf):
    s = F.concat(F.lit("see PMID: "), (F.col("user_id") + 10000).cast("string"), F.lit(", pmc"), F.col("event_id").cast("string"), F.lit(" and NCT"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    return table(spark, sf, "events").select("event_id", F.array_join(X.cited_pmids(s), ",").alias("strict"), F.array_join(X.mentioned_pmids(s), ",").alias("loose"), F.array_join(X.cited_trials(s), ",").alias("trials"))


TAGS = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&#039;', ''''), '&quot;', '\"'), '&nbsp;', ' '), '&gt;', '>'), '&lt;', '<'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query("x6_strip_tags", f"SELECT page_id, md5({TAGS.format('html')}) AS digest FROM pages")
def x6_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@query("x7_scrub_controls", r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1f]+', ' ', 'g')) AS digest FROM documents")
def x7_scrub_controls(spark, sf):
    return docs(spark, sf, "doc_id", F.md5(X.scrub_controls(F.col("text"))).alias("digest"))


@query("x8_first_json_object", r"SELECT event_id, nullif(regexp_extract('note ' || props || ' end', '(?s)\{.*\}', 0), '') AS obj FROM events")
def x8_first_json_object(spark, sf):
    return table(spark, sf, "events").select("event_id", X.first_json_object(F.concat(F.lit("note "), "props", F.lit(" end"))).alias("obj"))


@query("x9_clamped_score", "SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE '' || (user_id % 4) || '.5' END AS DOUBLE), 0) - 1 + 1)) AS score FROM events")
def x9_clamped_score(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.concat((F.col("user_id") % 4).cast("string"), F.lit(".5")))
    return table(spark, sf, "events").select("event_id", X.clamped_score(raw).alias("score"))


@query("x11_parts_of_ids", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, 'x' || o_orderkey AS after, '2401.' || o_custkey AS base FROM orders")
def x11_parts_of_ids(spark, sf):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", X.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), X.after_label(F.concat(F.lit("PMID:x"), key)).alias("after"), X.base_version(F.concat(F.lit("2401."), cust, F.lit("v2"))).alias("base"),
    )


@query("x10_id_urls", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || event_id || '/' WHEN event_id % 3 = 1 THEN 'https://clinicaltrials.gov/study/' || event_id END AS url FROM events")
def x10_id_urls(spark, sf):
    kind = F.element_at(F.lit(["PMID", "NCT", "DOI"]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", X.id_url(kind, F.col("event_id").cast("string")).alias("url"))


@query("x13_canonical_args", """SELECT event_id, '{"a":"' || event_type || '","z":"' || user_id || '"}' AS args FROM events""")
def x13_canonical_args(spark, sf):
    m = F.create_map(F.lit("z"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", X.canonical_args(m).alias("args"))
