"""Rule operators: ordered classifiers, validation, status and source normalisation, screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.functions import text as X

# Phrase lists and outcomes of the question quality rules, in order of precedence.
PATHWAY_TEMPLATES = ("rate-limiting or bottleneck", "response heterogeneity to drugs targeting", "functional interactions between")
PROTOCOL_PHRASES = ("the investigators plan", "subjects will be recruited", "the study will take place", "this study is", "this trial is")
LAZY_REASONS = ("Research article", "Literature explicitly", "Explicitly identified", "Listed as unsolved")
META_PHRASES = (
    "what are the key unresolved questions regarding", "what aspects of", "what are the unresolved questions",
    "what are the open questions", "remain unsolved or unclear", "this manuscript provides",
)
REVIEW_FRAGMENTS = (
    "insufficient evidence", "no evidence that", "no evidence on the potential", "uncertain whether", "unclear or high",
    "findings of this review", "need to be evaluated in further", "scientific study design was poor",
    "quality of studies evaluating", "there is evidence that topical", "to assess the evidence for", "to evaluate acupuncture",
    "to examine the efficacy", "to assess the effects of",
)
GENERIC_QUESTIONS = (
    "what treatments are needed to address", "why significant work to identify", "why treatment resistance a leading",
    "why outcomes are generally poor", "why although", "why the treatment of", "what remains remains",
    "what are the main challenges in this area", "what needs to be resolved", "can this intervention prevent disease",
    "how can we improve diagnostic accuracy and speed for this condition",
    "what are the comparative safety and efficacy profiles of the treatment groups",
    "is the intervention safe and efficacious in the target population",
    "what are the specific mechanisms of action and biological pathways involved",
    "what is the diagnostic accuracy and clinical utility of the diagnostic approach",
    "what is the optimal treatment protocol, dosage, or intervention approach",
    "what is the true effectiveness and is it clinically meaningful", "which approach is superior for patient outcomes",
    "are short-term benefits sustained over months or years",
    "what is the frequency, severity, and clinical significance of harms",
    "what dosing regimen and treatment duration produce best outcomes",
    "what are the biological or physiological pathways involved",
    "what is the complete safety profile and adverse event incidence", "which intervention or approach is most effective",
    "what is the optimal dose, intensity, duration, and frequency",
    "what are standardized outcome measures for assessing effectiveness",
    "what are the long-term clinical outcomes and durability",
    "which patient populations benefit most from available interventions",
    "what is the impact on patient quality of life and functional outcomes",
    "what are the biological and pharmacological mechanisms of action",
    "can oral stimulation interventions shorten hospital stays", "can exercise interventions enhance quality of life outcomes",
)
GARBLED_PHRASES = (
    "in the context of", "what are the barriers to effective",
    "what is the clinical effectiveness and efficacy of treatments for", "cochrane reviews", "an overview of cochrane",
)
# Observed status strings and their canonical labels; severities of audit flags.
STATUS_LABELS = {
    "open": "open", "partially_open": "open", "partially_answered": "partially_answered",
    "partially_resolved": "partially_answered", "partially resolved": "partially_answered",
    "partially_addressed": "partially_answered", "mostly_resolved": "partially_answered",
    "largely_resolved": "partially_answered", "answered": "answered", "resolved": "answered", "closed": "answered",
}
FLAG_SEVERITY = {
    "no_followup_evidence": "recheck", "unverifiable_source": "unverifiable", "arxiv_citation_check_needed": "unverifiable",
    "heavy_followup_recheck": "none", "ok": "none",
}


def quality_reason(
    question: Column, *, source_id: Column | None = None, url: Column | None = None, why: Column | None = None, difficulty: Column | None = None,
) -> Column:
    """the first rule that rejects a question, or null. Missing fields count as empty, missing difficulty as 0."""
    q = F.coalesce(question, F.lit(""))
    sid, link, reason = (F.coalesce(c, F.lit("")) if c is not None else F.lit("") for c in (source_id, url, why))
    level = F.coalesce(difficulty, F.lit(0)) if difficulty is not None else F.lit(0)
    length, asks = F.length(q), F.contains(q, F.lit("?"))
    any_of = lambda phrases: X.contains_any(q, phrases)
    unasked = F.regexp_replace(F.regexp_replace(q, r"\?+$", ""), r"\s+$", "")
    marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    rules = [
        ("short", length < 30),
        ("adverse_event", sid.startswith("fda_")),
        ("pathway_template", sid.startswith("hsa") & any_of(PATHWAY_TEMPLATES)),
        ("pathway_easy", sid.startswith("hsa") & (level == 1)),
        ("trial_easy", sid.startswith("NCT") & (level <= 2)),
        ("trial_protocol", sid.startswith("NCT") & any_of(PROTOCOL_PHRASES)),
        ("forum", F.contains(link, F.lit("stackexchange"))),
        ("fragment", ~asks & (length < 80)),
        ("no_question_mark", ~asks),
        ("vague_prefix", q.startswith("How can we better understand")),
        ("lazy_extraction", F.exists(F.lit(list(LAZY_REASONS)), lambda p: F.startswith(reason, p))),
        ("meta_question", any_of(META_PHRASES)),
        ("review_fragment", any_of(REVIEW_FRAGMENTS)),
        ("generic_template", any_of(GENERIC_QUESTIONS)),
        ("lowercase_start", q.rlike(r"^\p{Ll}")),
        ("title_in_question", unasked.endswith(".")),
        ("garbled", any_of(GARBLED_PHRASES)),
        ("short_broken", (length < 60) & ((F.size(X.blank_tokens(q)) < 6) | (marks > 1))),
    ]
    return first_match(rules)


def first_match(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null: one CASE, so later rules are not evaluated."""
    out = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(rule, name)
    return out


def content(full_text: Column, abstract: Column, least: int = 100, most: int = 15000, mark: str = "\n[truncated]") -> Column:
    """full text or else abstract, cut with a mark; null under `least` stripped characters."""
    body = F.coalesce(F.nullif(full_text, F.lit("")), abstract)
    kept = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit(mark))).otherwise(body)
    return F.when(F.length(F.trim(body)) >= least, kept)


def task_filter(*, l1: Column, difficulty: Column, status: Column, tools: Column, want_l1: str | None = None, low: float | None = None, high: float | None = None, want_status: str | None = None, need: Sequence[str] = ()) -> Column:
    """category substring, difficulty range (inclusive), exact status, required tools all present."""
    out = F.lit(True)
    if want_l1:
        out &= F.contains(F.lower(l1), F.lit(want_l1.lower()))
    if low is not None:
        out &= difficulty >= low
    if high is not None:
        out &= difficulty <= high
    if want_status:
        out &= status == want_status
    if need:
        out &= F.size(F.array_except(F.lit(list(need)), tools)) == 0
    return F.coalesce(out, F.lit(False))


def coalesced(*cols: Column) -> Column:
    """the first alternative that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def difficulty_bucket(level: Column) -> Column:
    """easy [1, 2.5), medium [2.5, 3.5), hard otherwise; a missing level counts as 3."""
    x = F.coalesce(level, F.lit(3.0))
    return F.when((x >= 1.0) & (x < 2.5), "easy").when((x >= 2.5) & (x < 3.5), "medium").otherwise("hard")


def mean_level(levels: Column) -> Column:
    """mean of the values of a map of levels; 3.0 for an empty or null map."""
    v = F.filter(F.map_values(levels), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(F.lit(3.0))


def issues(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of all checks that fail, in order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))


def completeness_failures(known: Column, unknown: Column, summary: Column, n_citations: Column, n_tools: Column, score: Column) -> Column:
    """F8: which of the six completeness criteria an answer misses."""
    at_least = lambda c, n: F.length(F.coalesce(c, F.lit(""))) >= n
    return issues([
        ("current_knowledge", at_least(known, 200)), ("unknown_aspects", at_least(unknown, 100)), ("answer_summary", at_least(summary, 200)),
        ("citations", n_citations >= 2), ("tools", n_tools >= 1), ("self_score", score.between(0.0, 1.0)),
    ])


def semantic_warnings(question: Column, answer: Column, relevance: Column, stop: Sequence[str] = X.QUERY_STOPWORDS) -> Column:
    """low type-token ratio (< 0.3), entity overlap (< 0.2) or citation alignment (< 0.5); relevance is an array of texts."""
    words = F.array_distinct(X.tokens(answer))
    ratio = F.size(words) / F.size(X.tokens(answer))
    entities = F.array_distinct(F.filter(X.tokens(question), lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))
    overlap = F.size(F.array_intersect(entities, words)) / F.size(entities)

    def aligned(t: Column) -> Column:
        keys = F.filter(X.tokens(t), lambda w: (F.length(w) >= 5) & ~w.isin(*stop))
        return (F.size(keys) == 0) | F.arrays_overlap(keys, words)

    fit = F.size(F.filter(relevance, aligned)) / F.size(relevance)
    low = lambda n, x, limit: (n == 0) | ~(x < limit)
    return issues([
        ("type_token_ratio", low(F.size(words), ratio, 0.3)), ("entity_overlap", low(F.size(entities), overlap, 0.2)), ("citation_alignment", low(F.size(relevance), fit, 0.5)),
    ])


def trajectory_reason(answer: Column, retrieved: Column, score: Column, has_question: Column, least: float) -> Column:
    """why a trajectory is dropped, or null: no question, bail-out, ungrounded citation, low score."""
    bail = X.contains_any(F.coalesce(answer, F.lit("")), X.BAIL_PHRASES) | (F.size(retrieved) == 0)
    loose = F.size(F.array_except(X.mentioned_pmids(answer), retrieved)) > 0
    return first_match([
        ("no_question", ~F.coalesce(has_question, F.lit(False))), ("non_attempt", X.answer_state(answer) != "attempt"), ("bail", bail),
        ("ungrounded", loose), ("low_score", ~F.coalesce(score >= least, F.lit(False))),
    ])


def source_type(sid: Column) -> Column:
    """kind of source by the form of its id."""
    return (
        F.when(sid.startswith("PMID"), "pubmed").when(sid.startswith("NCT"), "trial").when(sid.rlike(r"^\d{4}\.\d{4,5}"), "arxiv")
        .when(sid.startswith("hsa") | sid.rlike("^[OPQ][0-9][A-Z0-9]{3}[0-9]") | sid.startswith("map"), "synthetic").otherwise("unknown")
    )


def source_of(sid: Column, default: Column) -> Column:
    """F16: curated collections and preprints by id prefix, else the given source."""
    return F.when(sid.startswith("JLA:"), "jla").when(sid.startswith("NICE:"), "nice").when(sid.startswith("10."), "preprint").otherwise(default)


def screen_flag(kind: Column, status: Column, has_results: Column, label: Column, followups: Column, top_k: int) -> Column:
    """contamination flag from evidence: registry status and results, follow-up counts."""
    done = status == "COMPLETED"
    trial = (
        F.when(status.isin("TERMINATED", "WITHDRAWN", "SUSPENDED"), "trial_dead")
        .when(done & has_results & (label == "open"), "trial_resolved_but_open").when(done, "trial_completed").otherwise("ok")
    )
    pubmed = F.when(followups >= top_k, "heavy_followup_recheck").when(followups == 0, "no_followup_evidence").otherwise("ok")
    return (
        F.when(kind == "synthetic", "synthetic_template").when(kind == "trial", trial).when(kind == "pubmed", pubmed)
        .when(kind == "arxiv", "arxiv_citation_check_needed").otherwise("unverifiable_source")
    )


def mapped(c: Column, table: dict[str, str], default: str) -> Column:
    """A small fixed mapping as a literal map; null and unlisted values give the default."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def severity(flag: Column, detail: Column) -> Column:
    """still-open severity; a completed trial is high risk if results are posted."""
    posted = F.contains(F.coalesce(detail, F.lit("")), F.lit("results=True"))
    return F.when(flag == "trial_completed", F.when(posted, "high_risk").otherwise("recheck")).otherwise(mapped(flag, FLAG_SEVERITY, "recheck"))


def normal_status(c: Column) -> Column:
    """canonical status, 'unknown' for anything else."""
    return mapped(F.lower(F.trim(F.coalesce(c, F.lit("")))), STATUS_LABELS, "unknown")


def remediation(flag: Column) -> Column:
    """what to do with a row: remove, relabel, flag or keep."""
    return (
        F.when(flag.isin("synthetic_template", "trial_dead"), "remove").when(flag == "trial_resolved_but_open", "relabel")
        .when(flag == "trial_completed", "flag").otherwise("keep")
    )


def guarded_verdict(new: Column, cited: Column, valid: Column, n_evidence: Column, old: Column, answered: Column) -> tuple[Column, Column]:
    """(status, guardrail): no evidence gives unknown; a failed judge keeps the old status; citations outside the
    evidence are counted, and withdraw a claim of resolution."""
    wrong = F.size(F.array_except(F.coalesce(cited, F.array().cast("array<string>")), F.coalesce(valid, F.array().cast("array<string>"))))
    guard = F.when(n_evidence == 0, "no_evidence").when(~answered, "llm_fail").when(wrong > 0, F.concat(F.lit("hallucinated:"), wrong.cast("string"))).otherwise("ok")
    status = F.when(n_evidence == 0, "unknown").when(~answered, old).when((wrong > 0) & new.isin("answered", "partially_answered"), "unknown").otherwise(new)
    return status, guard


def normal_domain(df: DataFrame, column: str, exact: DataFrame, keywords: DataFrame, *, out: str = "domain", default: str = "Other") -> DataFrame:
    """canonical domain of free-text labels.

    exact has (name, canonical); keywords has (ord, keyword, canonical), order deciding. A label is looked up as a whole; else,
    for each separator in it (" / ", "/", ", ", ","): first part exactly, first part by keyword, any part exactly, any part by
    keyword; else the whole by keyword. Only distinct labels are resolved; both tables are broadcast if Spark finds them small.
    Null and blank labels get the default.
    """
    raw = df.select(F.col(column).alias("_raw")).where(F.trim(column) != "").distinct()
    whole = F.replace(F.trim("_raw"), F.lit("_"), F.lit(" "))
    pieces = [F.struct(F.lit(0).alias("step"), F.lit(0).alias("pos"), F.lower(F.trim(whole)).alias("part"), F.lit(True).alias("exact"), F.lit(True).alias("key_only_last"))]
    rows = raw.withColumn("_w", whole)
    candidates = F.array(*pieces)
    for i, sep in enumerate((" / ", "/", ", ", ",")):
        parts = F.filter(F.transform(F.split("_w", sep), lambda p: F.lower(F.trim(p))), lambda p: p != "")
        listed = F.transform(parts, lambda p, j: F.struct(F.lit(i + 1).alias("step"), j.alias("pos"), p.alias("part"), F.lit(True).alias("exact"), F.lit(False).alias("key_only_last")))
        candidates = F.concat(candidates, F.when(F.contains("_w", F.lit(sep)), listed).otherwise(F.array().cast("array<struct<step:int,pos:int,part:string,exact:boolean,key_only_last:boolean>>")))
    parts = rows.select("_raw", F.explode(candidates).alias("c")).select("_raw", "c.step", "c.pos", "c.part")
    hit = lambda step, kind, pos, ord_: F.struct(step.alias("step"), F.lit(kind).alias("kind"), pos.alias("pos"), ord_.alias("ord"), F.col("canonical").alias("canonical"))
    direct = parts.join(exact.select(F.col("name").alias("part"), "canonical"), "part")
    direct = direct.select("_raw", F.explode(F.when(F.col("step") == 0, F.array(hit(F.lit(0), 0, F.col("pos"), F.lit(0)))).when(F.col("pos") == 0, F.array(hit(F.col("step"), 0, F.col("pos"), F.lit(0)))).otherwise(F.array(hit(F.col("step"), 2, F.col("pos"), F.lit(0))))).alias("h"))
    keyed = parts.join(keywords.select("ord", "keyword", "canonical"), F.contains("part", F.col("keyword")))
    keyed = keyed.select("_raw", F.when(F.col("step") == 0, hit(F.lit(9), 9, F.col("pos"), F.col("ord"))).when(F.col("pos") == 0, hit(F.col("step"), 1, F.col("pos"), F.col("ord"))).otherwise(hit(F.col("step"), 3, F.col("pos"), F.col("ord"))).alias("h"))
    best = direct.unionByName(keyed).groupBy("_raw").agg(F.min("h").alias("h")).select("_raw", F.col("h.canonical").alias("_c"))
    return df.join(best, F.col(column) == F.col("_raw"), "left").drop("_raw").withColumn(out, F.coalesce("_c", F.lit(default))).drop("_c")


def with_reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    """Rows dropped for each reason, and kept."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def within_budget(df: DataFrame, cost: str, order: Sequence[str], budget: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose running cost, in order, stays within the budget, and the running cost as `spent`.

    Running sums are formed for each group of `by`; give one (day, shard, run) so that no task holds all rows.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
