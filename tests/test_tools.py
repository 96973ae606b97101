"""Tool projections on payloads in the services' layouts, and claims against a plain version."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from grainsift.functions import text as X
from grainsift.operators import citations, dedup, tables, tools

CASES = [
    ("pubmed", "", {"resultList": {"result": [{"pmid": "1", "title": "T", "abstractText": "a" * 1500}, {"id": "PPR9", "title": None}, {"pmid": "3"}]}}, [{"pmid": "1", "title": "T", "abstract": "a" * 1000}, {"pmid": "PPR9", "title": "", "abstract": ""}]),
    ("clinicaltrialsgov", "", {"studies": [{"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "B"}, "conditionsModule": {"conditions": ["c"]}, "armsInterventionsModule": {"interventions": [{"name": "x"}, {}]}}}]},
     [{"nct_id": "NCT1", "title": "B", "status": "", "conditions": ["c"], "interventions": ["x", ""]}]),
    ("openfda", "", {"results": [{"term": "nausea", "count": 3}]}, [{"term": "nausea", "count": 3}]),
    ("openfda", "", {"error": 1}, []),
    ("opentargets", "", {"data": {"target": {"id": "E"}}}, {"target": {"id": "E"}}),
    ("chembl", "molecule", {"molecules": [{"id": 1}]}, [{"id": 1}]),
    ("chembl", "get", {"molecule_chembl_id": "C1"}, {"molecule_chembl_id": "C1"}),
    ("uniprot", "", {"results": [{"primaryAccession": "P1", "genes": [{"geneName": {"value": "G"}}, {}], "sequence": {"length": 7}}]}, [{"accession": "P1", "id": "", "protein_name": "", "gene_names": ["G", ""], "organism": "", "length": 7}]),
    ("pubchem", "", {"PropertyTable": {"Properties": [{"CID": 5}]}}, [{"CID": 5}]),
    ("kegg", "find", "a\tb\tc\n\nplain", [{"id": "a", "description": "b"}, {"raw": "plain"}]),
    ("kegg", "get", "ENTRY x", {"entry": "ENTRY x"}),
    ("kegg", "list", "x", {"error": "Unknown operation: list"}),
    ("ncbi-datasets", "gene", {"genes": [{"gene": {"gene_id": "1", "symbol": "S", "chromosomes": ["X"]}}] * 7}, [{"gene_id": "1", "symbol": "S", "description": "", "type": "", "chromosomes": ["X"]}] * 5),
    ("ncbi_datasets", "genome", {"reports": [{"accession": "A", "organism": {"organism_name": "O"}, "assembly_info": {"assembly_level": "L"}}]}, [{"accession": "A", "organism": "O", "assembly_level": "L", "assembly_name": ""}]),
    ("ncbi_datasets", "virus", {}, {"error": "Unknown query_type: virus"}),
    ("biomcp", "", {"pubmed": {"resultList": {"result": [{"pmid": str(i)} for i in range(5)]}}, "clinical_trials": {"studies": []}}, {"pubmed": [{"pmid": str(i), "title": "", "abstract": ""} for i in range(3)], "clinical_trials": []}),
    ("none", "", {}, {"error": "Unknown tool: none"}),
]


def test_tool_results(spark):
    rows = [(i, t, o, p if isinstance(p, str) else json.dumps(p)) for i, (t, o, p, _) in enumerate(CASES)]
    rows += [(100, "pubmed", "", None), (101, "kegg", "get", "x" * 20_000), (102, "pubmed", "", "no json")]
    df = tools.tool_results(spark.createDataFrame(rows, "i int, tool string, operation string, payload string"), asked=2)
    got = {r.i: r for r in df.collect()}
    for i, (t, _, _, want) in enumerate(CASES):
        assert json.loads(got[i].result) == want and not got[i].truncated, t
    assert json.loads(got[100].result) == {"error": "Request failed"} and json.loads(got[102].result) == []
    cut = json.loads(got[101].result)
    assert got[101].truncated and cut["note"] == tools.TOO_LONG and len(cut["truncated_text"]) == tools.MAX_RESULT


def plain_claim(text, start, end):
    ends = [i + 1 for i, c in enumerate(text) if c in ".!?"]
    spans = list(zip([0, *ends], ends))
    own = [text[a:b].strip() for a, b in spans if a <= start < b]
    short = lambda s: len(re.sub("[^a-zA-Z ]", " ", s).split()) < 6 or re.match(X.FRAGMENT_START, s)
    if own and not short(own[0]):
        return own[0][:400]
    window = text[max(0, start - 360) : end].strip()
    stops = [i + 1 for i, c in enumerate(window) if c in ".!?"]
    last = "".join(window[a:b] for a, b in list(zip([0, *stops], stops))[-3:]).strip()
    return (last or window)[-400:]


def test_claims_against_a_plain_version(spark):
    rnd = random.Random(3)
    bits = ["the drug lowers the risk of stroke", "PMID: 1234567", "PMID:7654321", "NCT01234567", ". ", "! ", "?", " ", "in adults é", "x" * 300, "2019 data"]
    texts = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(300)]
    got = citations.citations(spark.createDataFrame(texts, "k int, a string"), ["k"], "a").collect()
    want = []
    for k, t in texts:
        seen = {}
        for kind, pattern in (("PMID", X.PMID_CITED), ("NCT", X.NCT)):
            for m in re.finditer(pattern, t):
                seen.setdefault((kind, m.group(1)), plain_claim(t, *m.span()))
        want += [(k, i, *key, claim) for i, (key, claim) in enumerate(seen.items())]
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_common_run_against_a_plain_version(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        x, y = ([rnd.choice("abc") for _ in range(rnd.randint(0, 30))] for _ in range(2))
        want = max((n for n in range(31) for i in range(len(x) - n + 1) if any(x[i : i + n] == y[j : j + n] for j in range(len(y) - n + 1))), default=0)
        assert dedup.common_run(x, y) == want, (x, y)


def test_priority_union_of_repeated_rows_and_hot_keys(spark):
    a = spark.createDataFrame([(1, "hot")] * 3 + [(i, "HOT ") for i in range(2, 200)] + [(300, None), (301, "")], "i int, q string")
    kept, counts = dedup.priority_union([a, a.where("i < 5")], X.normal_key(F.col("q")), "i")
    assert [r.i for r in kept.collect()] == [1] and tuple(counts.first()) == (209, 1, 2, 206)


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_similar_token_sets_against_all_pairs(spark, least):
    rnd = random.Random(6)
    make = lambda n: [(i, sorted({rnd.choice("abcdefghijkl") * rnd.choice((1, 1, 2)) for _ in range(rnd.randint(0, 9))})) for i in range(n)]
    a, b = make(120), make(40)
    got = tables.similar_token_sets(spark.createDataFrame(a, "i long, x array<string>"), spark.createDataFrame(b, "j long, y array<string>"), "i", "x", "j", "y", least).collect()
    want = [(i, j) for i, x in a for j, y in b if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least]
    assert len(want) > 3 and sorted((r.i, r.j) for r in got) == sorted(want)


def test_redaction_of_names_that_the_caller_gives(spark):
    said = F.lit("see db7.corp.example and /srv/private/x, key sk-abcdefghijklmnopqrstuvwx")
    extra = [(r"[a-z0-9]+\.corp\.example", "[HOST]"), (r"/srv/private", "[PATH]")]
    got = spark.range(1).select(X.redacted(said, extra).alias("r")).first().r
    assert got == "see [HOST] and [PATH]/x, key [REDACTED_KEY]"
