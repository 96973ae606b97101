"""Column functions over text: keys, tokens, identifiers, clean-up, predicates. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose exact form decides which identifiers are found.
PMID_CITED = r"(?i)PMID[:\s#]*(\d{5,9})"
PMID_SEEN = r"PMID[:\s]*\d{5,9}|\b\d{8}\b"
PMID_OR_PMC = r"(?i)\bPM(?:ID|C)[:\s]?(\d+)\b"
NCT = r"(NCT\d{8})"
REFUSAL = (
    r"(?i)\b(too complex|cannot (?:answer|provide|determine)|unable to|i (?:do not|don't) have"
    r"|beyond (?:my|the scope)|consult (?:a|your) (?:doctor|physician|healthcare)"
    r"|insufficient (?:information|data) to|not enough (?:information|data))\b"
)
FRAGMENT_START = r"(?i)^[\s,.;:\)\(*#\]]*((19|20)\d\d|PMID|NCT|et al|doi|Source)"
BAIL_PHRASES = (
    "not returning", "returning empty", "tools are not", "training knowledge",
    "unable to retrieve", "relying on my training", "no published", "search tools",
)
QUERY_STOPWORDS = (
    "what", "which", "how", "does", "the", "and", "for", "are", "with", "can", "of", "in", "to", "is", "be", "that",
    "this", "remain", "open", "question", "patients", "disease", "such", "why", "underpinning", "mechanistic",
)
ENTITIES = (("&amp;", "&"), ("&#039;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&gt;", ">"), ("&lt;", "<"))
OPEN_QUESTION_SIGNALS = (
    "open question", "unsolved", "unresolved", "knowledge gap", "unanswered", "future direction", "remains unclear",
    "poorly understood", "unknown mechanism", "no consensus", "limited understanding", "insufficient evidence",
    "understudied", "underexplored", "grand challenge", "critical gap", "research priority", "unmet need",
)
EVIDENCE_GAP_SIGNALS = (
    "insufficient evidence", "no clear evidence", "uncertain", "low-quality evidence", "very low-quality", "further research",
    "more research needed", "evidence is limited", "evidence gap", "inconclusive", "no firm conclusions", "unable to draw",
    "cannot determine", "lack of evidence", "paucity of evidence",
)
REDACTIONS = (
    (r"sk-or-v1-[A-Za-z0-9]{20,}", "[REDACTED_KEY]"),
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_KEY]"),
    (r"AIza[A-Za-z0-9_\-]{35}", "[REDACTED_KEY]"),
    (r"https?://\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?", "[REDACTED_URL]"),
    (r"https?://[a-zA-Z0-9.\-]*:\d{2,5}(?:/v1)?", "[REDACTED_URL]"),
    (r"/home/[a-zA-Z0-9_\-]+", "[PATH]"),
)
SURVIVORS = (r"sk-[A-Za-z0-9]{20,}", r"sk-or-", r"AIza[A-Za-z0-9_\-]{35}", r"\d{1,3}(?:\.\d{1,3}){3}:\d+", r"/home/[a-z]")


def normal_key(c: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Lower-cased tokens of a pattern."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)


def blank_tokens(c: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def alpha_tokens(c: Column) -> Column:
    """White-space pieces made of letters only, lower-cased."""
    return F.filter(blank_tokens(F.lower(c)), lambda w: w.rlike(r"^\p{L}+$"))


def keyword_query(c: Column, k: int = 6, stop: Sequence[str] = QUERY_STOPWORDS) -> Column:
    """The first k distinct words of four letters or more that are no stop words, joined by AND."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z][A-Za-z\-]{3,}"), 0)
    kept = F.filter(words, lambda w: ~w.isin(*stop))
    return F.array_join(F.slice(F.array_distinct(kept), 1, k), " AND ")


def cited_pmids(c: Column) -> Column:
    """Ids of strict PMID citations, in order."""
    return F.regexp_extract_all(c, F.lit(PMID_CITED), 1)


def mentioned_pmids(c: Column) -> Column:
    """Distinct ids in PMID or PMC form."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PMID_OR_PMC), 1))


def cited_trials(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NCT), 1)


def has_citation(c: Column) -> Column:
    return c.rlike(PMID_SEEN) | c.rlike(NCT)


def strip_tags(c: Column) -> Column:
    """Tags to blanks, six entities (in order), white space collapsed."""
    out = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def scrub_controls(c: Column) -> Column:
    """Runs of control characters to one blank."""
    return F.regexp_replace(c, r"[\x00-\x1f]+", " ")


def first_json_object(c: Column) -> Column:
    """From the first brace to the last; null without."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def clamped_score(c: Column) -> Column:
    """Number in [0, 1]; 0 for anything else."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def year_of(c: Column) -> Column:
    """X11: first four digits in a row, or empty."""
    return F.regexp_extract(c, r"(\d{4})", 1)


def after_label(c: Column) -> Column:
    """What follows the first colon, or all of it."""
    return F.when(F.instr(c, ":") > 0, F.regexp_replace(c, r"^[^:]*:", "")).otherwise(c)


def base_version(c: Column) -> Column:
    """A preprint id without its version."""
    return F.substring_index(c, "v", 1)


def id_url(kind: Column, ident: Column) -> Column:
    """Public page of an identifier."""
    return F.when(kind == "PMID", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), ident, F.lit("/"))).when(
        kind == "NCT", F.concat(F.lit("https://clinicaltrials.gov/study/"), ident)
    )


def canonical_args(c: Column) -> Column:
    """A string map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """whether any phrase occurs in the lower-cased text."""
    return F.exists(F.lit(list(phrases)), lambda p: F.contains(F.lower(c), p))


def is_fragment(c: Column) -> Column:
    """a bare citation rather than a claim: under six alphabetic words, or a leading reference."""
    claim = F.trim(F.coalesce(c, F.lit("")))
    return (F.size(blank_tokens(F.regexp_replace(claim, "[^a-zA-Z ]", " "))) < 6) | claim.rlike(FRAGMENT_START)


def is_substantive(c: Column) -> Column:
    """at least 12 words, of which eight have three letters or more in a row."""
    return (F.size(blank_tokens(c)) >= 12) & (F.regexp_count(c, F.lit("[A-Za-z]{3,}")) >= 8)


def answer_state(c: Column) -> Column:
    """empty (under 20 characters), refusal or attempt."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) < 20, "empty").when(F.coalesce(c, F.lit("")).rlike(REFUSAL), "refusal").otherwise("attempt")


def truncated(c: Column, limit: int = 12000, mark: str = "\n... [truncated]") -> tuple[Column, Column]:
    """(text cut to the limit with a mark, whether it was cut)."""
    cut = F.length(c) > limit
    return F.when(cut, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c), cut


def redacted(c: Column, extra: Sequence[tuple[str, str]] = ()) -> Column:
    """ordered redaction of keys, private addresses and paths; extra patterns come last."""
    for pattern, put in (*REDACTIONS, *extra):
        c = F.regexp_replace(c, pattern, put)
    return c


def leaks(c: Column, extra: Sequence[str] = ()) -> Column:
    """whether anything that must not be released is left."""
    return c.rlike("|".join(f"(?:{p})" for p in (*SURVIVORS, *extra)))


def choice_letter(c: Column, n_choices: Column) -> Column:
    """the last valid 'Answer: X', else the last standalone letter, among the first n choices."""
    valid = lambda x: F.instr(F.substring(F.lit("ABCDE"), F.lit(1), n_choices), x) > 0
    stated = F.filter(F.regexp_extract_all(c, F.lit(r"[Aa]nswer\s*[:\-]?\s*\(?([A-E])\b"), 1), valid)
    alone = F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-E])\b"), 1), valid)
    return F.coalesce(F.try_element_at(stated, F.lit(-1)), F.try_element_at(alone, F.lit(-1)))


def tool_name(c: Column) -> Column:
    """hyphens and underscores mean the same."""
    return F.replace(c, F.lit("-"), F.lit("_"))


def unwrapped_arguments(c: Column, levels: int = 6) -> Column:
    """a JSON object out of {"arguments": ...} wrappers, objects or strings, up to six levels; '{}' otherwise."""
    out = c
    for _ in range(levels):
        inner = F.get_json_object(out, "$.arguments")
        keys = F.json_object_keys(out)
        wrapped = inner.isNotNull() & (F.size(F.array_except(keys, F.lit(["arguments", "name"]))) == 0)
        out = F.when(F.coalesce(wrapped, F.lit(False)), inner).otherwise(out)
    return F.when(F.json_object_keys(out).isNotNull(), out).otherwise(F.lit("{}"))
