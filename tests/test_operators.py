"""Operators against small fresh Python versions and edge cases."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from grainsift.functions import stats as T
from grainsift.functions import text as X
from grainsift.operators import citations, dedup, plugs, rules, scores, tables
from grainsift.operators.dag import Pipeline, Stage
from grainsift.sources import connectors as C
from grainsift.sources import files as IO
from grainsift.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- rules --------------------------------------------------------------------------------------------------
REASONS = [
    ("short", dict(q="Too short?")),
    ("adverse_event", dict(q="What is the adverse event profile of this?", sid="fda_x", url="stackexchange")),
    ("pathway_template", dict(q="What are functional interactions between A and B in it?", sid="hsa1", d=1)),
    ("pathway_easy", dict(q="What is the role of A in the pathway here?", sid="hsa1", d=1)),
    ("trial_easy", dict(q="Does this trial show that A is better than B?", sid="NCT1", d=2)),
    ("trial_protocol", dict(q="The investigators plan to test if A is better than B?", sid="NCT1", d=3)),
    ("forum", dict(q="Does anyone know whether A is better than B?", url="https://x.stackexchange.com/q")),
    ("fragment", dict(q="A statement of more than thirty characters.")),
    ("no_question_mark", dict(q="A statement of more than thirty characters that goes on and on until it is above eighty.")),
    ("vague_prefix", dict(q="How can we better understand the mechanisms of A and of B?")),
    ("lazy_extraction", dict(q="Which mechanisms of A lead to B in most of the patients?", why="Research article")),
    ("meta_question", dict(q="What aspects of disease A are relevant to the outcome B?")),
    ("review_fragment", dict(q="Is there insufficient evidence for A in the treatment of B?")),
    ("generic_template", dict(q="Which approach is superior for patient outcomes in this area?")),
    ("lowercase_start", dict(q="which mechanisms of A lead to B in most of the patients?")),
    ("title_in_question", dict(q="A long title of a paper that was turned into one. ?")),
    ("garbled", dict(q="Which drugs act in the context of A and B and which do not?")),
    ("short_broken", dict(q="Mechanisms leading to B-deficiency??")),
    (None, dict(q="Which mechanisms of A lead to B in most of the patients?", d=3)),
]


def test_quality_rules_fire_in_order(spark):
    rows = [(w, c["q"], c.get("sid"), c.get("url"), c.get("why"), c.get("d")) for w, c in REASONS]
    df = spark.createDataFrame(rows, "want string, q string, sid string, url string, why string, d int")
    got = df.select("want", rules.quality_reason(F.col("q"), source_id=F.col("sid"), url=F.col("url"), why=F.col("why"), difficulty=F.col("d")).alias("got")).collect()
    assert [(r.want, r.got) for r in got] == [(r.want, r.want) for r in got]


def test_source_types_of_known_ids(spark):
    ids = {"PMID:1": "pubmed", "NCT:NCT00000001": "trial", "2401.01234": "arxiv", "Q9Y6K9X": "synthetic", "hsa04110": "synthetic", "map1": "synthetic", "": "unknown", "x2401.01234": "unknown"}
    df = spark.createDataFrame(list(ids.items()), "sid string, want string").select("want", rules.source_type(F.col("sid")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_status_aliases(spark):
    df = spark.createDataFrame([(f" {k.upper()} ", v) for k, v in rules.STATUS_LABELS.items()] + [("maybe", "unknown"), (None, "unknown")], "s string, want string")
    assert all(r.want == r.got for r in df.select("want", rules.normal_status(F.col("s")).alias("got")).collect())


def test_domain_normaliser_separators(spark):
    exact = spark.createDataFrame([("cardiology", "Heart"), ("oncology", "Cancer")], "name string, canonical string")
    keys = spark.createDataFrame([(0, "neuro", "Brain"), (1, "cardi", "Heart2")], "ord int, keyword string, canonical string")
    want = {"Cardiology": "Heart", "cardio_x / oncology": "Heart2", "foo, oncology": "Cancer", "foo/bar": "Other", "Neuro-cardiac": "Brain", "": "Other", None: "Other", "foo / neurology": "Brain", "x, y/oncology": "Cancer"}
    got = rules.normal_domain(spark.createDataFrame([(k,) for k in want], "d string"), "d", exact, keys).collect()
    assert {r.d: r.domain for r in got} == want


def test_unwrapping_levels(spark):
    def wrap(n):
        s = json.dumps({"q": "x"})
        for _ in range(n):
            s = json.dumps({"arguments": s})
        return s

    got = [one(spark, X.unwrapped_arguments(F.lit(wrap(n)))) for n in (0, 1, 3, 6)]
    assert all(json.loads(g) == {"q": "x"} for g in got)
    assert one(spark, X.unwrapped_arguments(F.lit("not json"))) == "{}"


def test_redaction_and_survivors(spark):
    dirty = "key sk-" + "a" * 24 + " at http://10.0.0.1:8080/v1 in /home/someone/x"
    clean = one(spark, X.redacted(F.lit(dirty)))
    assert clean == "key [REDACTED_KEY] at [REDACTED_URL]/v1 in [PATH]/x"
    assert one(spark, X.leaks(F.lit(dirty))) and not one(spark, X.leaks(F.lit(clean)))


def test_no_break_space_is_white_space_in_keys(spark):
    assert one(spark, X.normal_key(F.lit(" A  b\n\nC "))) == "a b c"


# -- statistics ---------------------------------------------------------------------------------------------
def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (5, 5)], "k int, n int")
    rows = df.select(*[c.alias(x) for x, c in zip("plh", T.wilson(F.col("k"), F.col("n")), strict=True)]).collect()
    assert tuple(rows[0]) == (0.0, 0.0, 0.0) and rows[1].l == 0.0 and rows[2].h == 100.0
    assert 0 < rows[1].h < 100


def test_kappa_against_python(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.choice("abc")) for _ in range(200)] + [(None, "a")]
    n = 200
    po = sum(a == b for a, b in rows[:200]) / n
    pe = sum((sum(a == c for a, _ in rows[:200]) / n) * (sum(b == c for _, b in rows[:200]) / n) for c in "abc")
    got = T.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert got.n == 200 and math.isclose(got.kappa, (po - pe) / (1 - pe))
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert T.kappa(same, "a", "b").first().kappa == 1.0
    assert T.kappa(same, "a", "b", degenerate=None).first().kappa is None


def test_spearman_edges(spark):
    df = spark.createDataFrame([("two", 1.0, 2.0), ("two", 2.0, 1.0)] + [("flat", 1.0, float(i)) for i in range(4)] + [("up", float(i), float(i * i)) for i in range(4)], "g string, x double, y double")
    got = {r.g: r.rho for r in T.spearman(df, "x", "y", ["g"]).collect()}
    assert got["two"] is None and got["flat"] is None and math.isclose(got["up"], 1.0)


def test_risk_and_odds_zero_cells(spark):
    df = spark.createDataFrame([(0, 5, 3, 2), (2, 3, 4, 1)], "a int, b int, c int, d int")
    r = df.select(*[c.alias(n) for n, c in T.risk_and_odds(*map(F.col, "abcd")).items()]).collect()
    assert r[0].risk_ratio is None and math.isclose(r[0].odds_ratio, (0.5 * 2.5) / (5.5 * 3.5))
    assert math.isclose(r[1].risk_ratio, (2 / 5) / (4 / 5))


def test_bootstrap_is_bit_reproducible(spark):
    flags = [i % 3 != 0 for i in range(17)]
    means = []
    for b in range(2000):
        seed, acc = (b * 2654435761) & 0xFFFFFFFF, 0
        for _ in flags:
            seed = (1103515245 * seed + 12345) & 0x7FFFFFFF
            acc += flags[seed % len(flags)]
        means.append(100 * acc / len(flags))
    means.sort()
    df = spark.createDataFrame([(i, int(f)) for i, f in enumerate(flags)], "i int, f int")
    r = T.bootstrap_interval(df, "f", "i").first()
    assert (r.n, r.low, r.high) == (17, means[50], means[1950])
    assert T.bootstrap_interval(df.where("i < 0"), "f", "i").count() == 0


# -- dedup --------------------------------------------------------------------------------------------------
def edges_of(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return {k: sorted(v) for k, v in near.items()}


def brute(variant, n, near, prio, known):
    """The three rules applied to all items at once, without components."""
    live = [True] * n
    if variant == "authority":
        for i in range(n):
            if live[i]:
                for j in range(i + 1, n):
                    if live[j] and j in near.get(i, ()):
                        if prio[j] > prio[i]:
                            live[i] = False
                            break
                        live[j] = False
        return live
    if variant == "incremental":
        kept = []
        for i in range(n):
            ok = not known[i] and not any(k in near.get(i, ()) for k in kept)
            live[i] = ok
            kept += [i] if ok else []
        return live
    dead = set()
    for j, k in itertools.combinations(range(n), 2):
        if j not in dead and k in near.get(j, ()):
            dead.add(k)
    return [not known[i] and i not in dead for i in range(n)]


@pytest.mark.parametrize("variant", ["authority", "incremental", "batch"])
def test_greedy_rules_by_component(variant):
    rnd = random.Random(11)
    for _ in range(300):
        n = rnd.randint(1, 9)
        near = edges_of([p for p in itertools.combinations(range(n), 2) if rnd.random() < 0.3])
        prio, known = [rnd.randint(0, 2) for _ in range(n)], [rnd.random() < 0.2 for _ in range(n)]
        rule = {"authority": lambda: dedup.authority_greedy(n, near, prio), "incremental": lambda: dedup.keep_first_greedy(n, near, known), "batch": lambda: dedup.batch_greedy(n, near, known)}
        assert rule[variant]() == brute(variant, n, near, prio, known)


@pytest.mark.parametrize("variant", ["authority", "incremental", "batch"])
def test_semantic_dedup_on_vectors(spark, variant):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]

    def near(v):
        w = [x + rnd.gauss(0, 0.12) for x in v]
        n = math.sqrt(sum(x * x for x in w))
        return [x / n for x in w]

    vecs = [near(rnd.choice(base)) for _ in range(40)]
    olds = [near(base[0]) for _ in range(3)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    edges = edges_of([(i, j) for i, j in itertools.combinations(range(40), 2) if dot(vecs[i], vecs[j]) >= 0.9])
    prio = [i % 3 for i in range(40)]
    known = [variant != "authority" and any(dot(v, o) >= 0.9 for o in olds) for v in vecs]
    df = spark.createDataFrame([(i, v, float(p)) for i, (v, p) in enumerate(zip(vecs, prio, strict=True))], "vec_id long, embedding array<double>, p double")
    old = spark.createDataFrame([(i, v) for i, v in enumerate(olds)], "vec_id long, embedding array<double>") if variant != "authority" else None
    got = dedup.semantic_dedup(df, 0.9, variant=variant, prio=F.col("p"), existing=old).orderBy("vec_id").collect()
    assert [r.kept for r in got] == brute(variant, 40, edges, prio, known)


def test_similar_pairs_in_blocks(spark):
    rnd = random.Random(2)
    vecs = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    vecs = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vecs]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if sum(a * b for a, b in zip(vecs[i], vecs[j], strict=True)) >= 0.8}
    for rows in (1000, 13):
        assert {(r.a, r.b) for r in dedup.similar_pairs(df, 0.8, rows_per_block=rows).collect()} == want


def test_priority_union_counts(spark):
    a = spark.createDataFrame([(1, "A b"), (2, " ")], "i int, q string")
    b = spark.createDataFrame([(3, "a  B", 9), (4, "c", 9), (5, None, 9)], "i int, q string, extra int")
    kept, counts = dedup.priority_union([a, b], X.normal_key(F.col("q")), "i")
    assert sorted(r.i for r in kept.collect()) == [1, 4]
    assert tuple(counts.first()) == (5, 2, 2, 1)


def test_longest_common_run(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", "b"], ["x", "a", "b", "c"]), ([], ["a"]), (["q"], ["r"])], "a array<string>, b array<string>")
    assert [r.run for r in dedup.longest_common_runs(df, "a", "b").collect()] == [3, 0, 0]


# -- citations, tables, scores ------------------------------------------------------------------------------
def test_claims_around_citations(spark):
    text = "Drug A lowers the risk of stroke in adults, PMID: 12345678. Short (PMID: 99999). NCT01234567 again PMID 12345678."
    rows = citations.citations(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k int, a string"), ["k"], "a").orderBy("place").collect()
    assert [(r.id_type, r.id) for r in rows] == [("PMID", "12345678"), ("PMID", "99999"), ("NCT", "01234567"[:0] + "NCT01234567")]
    assert rows[0].claim.startswith("Drug A lowers") and "Drug A" in rows[1].claim


def test_ungrounded_modes(spark):
    answer, seen = F.lit("see PMID:111 and PMC222"), F.lit('{"pmid": "111"}')
    assert sorted(one(spark, citations.ungrounded(answer, seen))) == ["111", "222"]
    assert one(spark, citations.ungrounded(answer, seen, mode="corrected")) == ["222"]


def test_messages_keep_numeric_order(spark):
    df = spark.createDataFrame([([("2", "tool", "b"), ("forced_final", "x", "z"), ("10", "tool", "c"), ("1", "assistant", "a")],)], "t array<struct<round:string,role:string,content:string>>")
    got = df.select(citations.messages(F.lit("q"), F.col("t"), F.lit("f"), "s").alias("m")).first().m
    assert [m.content for m in got] == ["s", "q", "a", "b", "c", "z", "f"]


def test_checklist_without_match_is_zero(spark):
    c = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 1.0)], "t int, c int, w double")
    v = spark.createDataFrame([(1, 1, "met"), (1, 2, "partial"), (1, 9, "met")], "t int, c int, v string")
    got = {r.t: (r.score, r.n_criteria) for r in scores.checklist_scores(c, v, "t", "c", "w", "v").collect()}
    assert math.isclose(got[1][0], 2.5 / 3) and got[2] == (0.0, 1)


def test_buckets_at_the_threshold(spark):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 0.4), ("b", "y", 0.6), ("c", "x", 0.1)], "t string, m string, s double")
    assert {r.t: r.bucket for r in scores.model_buckets(df, "t", "m", "s", ["x", "y"]).collect()} == {"a": "all_pass", "b": "split"}


def test_merge_versions_only_bad_by_good(spark):
    old = spark.createDataFrame([(1, "good"), (2, ""), (3, "")], "k int, a string")
    new = spark.createDataFrame([(1, "new"), (2, "fixed"), (3, ""), (4, "stray")], "k int, a string")
    got = {r.k: (r.a, r.replaced) for r in tables.merge_versions(old, new, ["k"], F.col("a") != "").collect()}
    assert got == {1: ("good", False), 2: ("fixed", True), 3: ("", False)}


def test_plugged_client_states_and_extraction(spark):
    client = plugs.table_client({"p": '{"questions": [{"q": "x"}, {"q": "y"}]}', "e": "", "a": '[{"q": "z"}]', "d": '{"other": 1}'})
    df = plugs.with_answers(spark.createDataFrame([("p",), ("e",), ("a",), ("d",), ("?",)], "prompt string"), "prompt", client)
    states = {r.prompt: r.answer_state for r in df.collect()}
    assert states == {"p": "ok", "e": "empty", "a": "ok", "d": "ok", "?": "error"}
    got = plugs.extracted(df.select("prompt", "answer"), "answer", "q string")
    assert sorted((r.prompt, r.q) for r in got.collect()) == [("a", "z"), ("p", "x"), ("p", "y")]


def test_replay_of_own_calls_hits_all(spark):
    calls = spark.createDataFrame([("t", "{}", 1), ("u", '{"a":"1"}', 2)], "tool string, args string, n int")
    cache = calls.select("tool", "args", F.lit("r").alias("response"))
    assert all(r.hit for r in plugs.replayed(calls, cache).collect())
    live = plugs.replayed(calls, cache.where("tool = 't'"), lambda: lambda t, a: "live").collect()
    assert {r.tool: (r.response, r.hit) for r in live} == {"t": ("r", True), "u": ("live", False)}


# -- sources ------------------------------------------------------------------------------------------------
def test_pubmed_article(spark):
    xml = """<PubmedArticle><MedlineCitation><PMID>42</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract>
    <AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList>
    <Journal><JournalIssue><PubDate><Year>2020</Year><Month>May</Month></PubDate></JournalIssue></Journal><PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Letter</PublicationType></PublicationTypeList></Article>
    <MeshHeadingList><MeshHeading><DescriptorName>M</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>k</Keyword></KeywordList></MedlineCitation></PubmedArticle>"""
    r = C.pubmed_articles(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.source_id, r.title, r.abstract, r.authors, r.publication_date, r.document_type, r.keywords) == ("PMID:42", "T", "AIM: a\nb", ["Jo Doe"], "2020-May", "Review; Letter", ["M", "k"])


def test_arxiv_entry(spark):
    xml = """<entry><id>http://arxiv.org/abs/2401.01234v2</id><title>A
title</title><summary> s </summary><published>2024-01-02T00:00:00Z</published><author><name>N</name></author><primary_category term="q-bio"/><category term="q-bio"/><category term="cs"/><link title="pdf" href="http://p"/></entry>"""
    r = C.arxiv_entries(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.source_id, r.title, r.publication_date, r.keywords, r.url) == ("2401.01234v2", "A title", "2024-01-02", ["q-bio", "cs"], "http://p")


def test_json_connectors(spark):
    f = lambda obj, **kw: spark.createDataFrame([(json.dumps(obj), *kw.values())], ["json", *kw])
    trial = C.clinical_trials(f({"studies": [{"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "t"}, "conditionsModule": {"conditions": ["c"]}}}]})).first()
    assert (trial.source_id, trial.abstract, trial.keywords) == ("NCT1", "", ["c"])
    fda = C.adverse_events(f({"results": [{"term": f"t{i}"} for i in range(12)]}, drug="d")).first()
    assert fda.abstract.endswith("Total unique reaction types: 12.") and len(fda.keywords) == 10
    assert C.adverse_events(f({"results": []}, drug="d")).count() == 0
    ot = C.target_diseases(f({"data": {"disease": {"name": "n", "description": "x", "knownDrugs": None, "therapeuticAreas": [{"name": "a"}]}}}, efo_id="E")).first()
    assert "Known drugs: 0" in ot.abstract and ot.title == "Open Targets: n"
    assert C.target_diseases(f({"data": {"disease": None}}, efo_id="E")).count() == 0
    prot = C.proteins(f({"results": [{"primaryAccession": "P1", "genes": [{"geneName": {"value": "G"}}], "comments": [{"commentType": "FUNCTION", "texts": [{"value": "f" * 600}]}, {"commentType": "DISEASE", "disease": {"diseaseId": "D", "description": "d"}}]}]})).first()
    assert "Function: " + "f" * 500 + ". " in prot.abstract and "D: d" in prot.abstract and prot.keywords == ["G", ""]
    gene = C.genes(f({"genes": [{"gene": {"gene_id": "7", "symbol": "S", "description": "d", "full_name": "F"}}, {"gene": {"symbol": "no id"}}]})).collect()
    assert [g.source_id for g in gene] == ["7"]
    wiki = C.encyclopedia_pages(f({"query": {"pages": {"-1": {"title": "none"}, "5": {"title": "A b", "extract": "e"}}}})).collect()
    assert [(w.source_id, w.url) for w in wiki] == [("wiki:5", "https://en.wikipedia.org/wiki/A_b")]
    forum = C.forum_questions(f({"items": [{"question_id": "9", "title": "t", "body": "<p>x &amp; y</p>", "tags": ["a"], "score": 3}]}, site="s")).first()
    assert (forum.source, forum.abstract, forum.metadata["score"]) == ("stackexchange/s", "x & y", "3")
    searches = spark.createDataFrame([("q", json.dumps({"IdentifierList": {"CID": list(range(8))}}))], "query string, json string")
    details = spark.createDataFrame([(1, json.dumps({"InformationList": {"Information": [{"Title": "One", "Description": "d" * 3000}]}}))], "cid long, json string")
    got = {r.source_id: (r.title, len(r.abstract)) for r in C.compounds(searches, details).collect()}
    assert len(got) == 5 and got["1"] == ("PubChem: One", 2000) and got["0"] == ("PubChem: CID:0", 0)


def test_choice_items(spark):
    a = spark.createDataFrame([(0, "q", {"A": "x", "B": "y"}, "B")], "i int, question string, options map<string,string>, answer_idx string")
    b = spark.createDataFrame([(0, "q", ["c1", "c2"], "maybe")], "i int, question string, contexts array<string>, final_decision string")
    c = spark.createDataFrame([(0, "q", "w", "x", "y", "z", 3)], "i int, question string, a string, b string, c string, d string, cop int")
    got = {r.id: (r.answer, r.answer_text, r.choices) for r in C.choice_items({"lettered": a, "verdict": b, "indexed": c}).collect()}
    assert got == {"lettered-0": ("B", "y", ["x", "y"]), "verdict-0": ("C", "maybe", ["yes", "no", "maybe"]), "indexed-0": ("D", "z", ["w", "x", "y", "z"])}


def test_paged_source_resumes(spark):
    got = C.read_pages(spark, "fixture_pages.fetch", ["a", "b"])
    assert sorted((r.query, r.page, r.payload) for r in got.collect()) == [("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("b", 1, "b1")]
    rest = C.read_pages(spark, "fixture_pages.fetch", ["a", "b"], done=got.where("query = 'a'"))
    assert {r.query for r in rest.collect()} == {"b"}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        IO.write_jsonl(df, str(tmp_path / "out"), append_new_by="k")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_result_set_parts(spark, tmp_path):
    t = spark.createDataFrame([(1, "x")], "k int, v string")
    IO.result_set(t, t, t, t, str(tmp_path / "set"))
    assert {p.name for p in (tmp_path / "set").iterdir()} == {"summary", "per_task", "aggregated", "traces"}


# -- operations ---------------------------------------------------------------------------------------------
def test_dag_runs_once_and_failures_are_terminal(spark, tmp_path):
    ran = []

    def make(name, rows, fail=False):
        def run(s):
            ran.append(name)
            if fail:
                raise RuntimeError("no")
            return s.range(rows)

        return run

    stages = [
        Stage("a", make("a", 5), str(tmp_path / "a"), checks={"enough": F.count("*") >= 5}),
        Stage("b", make("b", 1), str(tmp_path / "b"), ("a",), checks={"enough": F.count("*") >= 5}),
        Stage("c", make("c", 1, True), str(tmp_path / "c"), ("a",)),
        Stage("d", make("d", 1), str(tmp_path / "d"), ("b",)),
        Stage("e", make("e", 1), str(tmp_path / "e"), ("a",), cost=10),
    ]
    assert Pipeline(spark, stages, budget=5).run() == {"a": "done", "b": "failed", "c": "failed"}
    assert ran == ["a", "b", "c"]
    again = Pipeline(spark, stages, budget=5)
    again.reconcile()
    assert again.state == {"a": "done"}


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    days = sorted(r[0] for r in e.select(F.to_date("ts")).distinct().collect())
    for i in range(3):  # one file after another: a file stream reads them in order of modification time
        third = days[len(days) * i // 3 : len(days) * (i + 1) // 3]
        e.where(F.to_date("ts").isin(third)).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(str(tmp_path / "e"))
    stream = E.stream_of(spark, str(tmp_path / "e"), e.schema, 1)
    utc = e.withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda rows: sorted(map(str, rows))
    assert key(E.drained(E.windowed_counts(stream, "1 day", "12 hours", late="90 days"), "t", "complete").collect()) == key(E.windowed_counts(utc, "1 day", "12 hours").collect())
    # In append mode only windows behind the watermark are out; all that are out equal the batch.
    out = {(r.start, r.event_type): r.n for r in E.drained(E.windowed_counts(stream, "1 day", late="1 hour"), "t2").collect()}
    batch = {(r.start, r.event_type): r.n for r in E.windowed_counts(utc, "1 day").collect()}
    assert out and all(batch[k] == n for k, n in out.items())
