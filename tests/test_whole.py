"""Every benchmark item and every row is compared: checks beside the SQL of queries over whole texts and whole tables."""

import random
import re

from test_oracles import ORACLES, QUERIES

CUT = re.compile(r"left\(text, (60|200|300|20)\)|_id % (50|20|40) |< 400|orderkey % 50|turn < 3")


def test_sql_is_over_whole_texts_and_tables():
    names = ["f1_quality_reason", "f10_claim_predicates", "a26_citation_relevance", "t12_similarity_summary", "x20_prompt_block", "l2_sorted_export", "x15_rounding_inputs", "d3_distinct_citations", "r11_replay_with_fallback", "j4_join_on_normal_text"]
    assert not [n for n in names if CUT.search(ORACLES[n])]
    assert not [n for n in QUERIES if n.endswith("_whole")]


def test_sorted_export_is_in_order(spark, sf):
    got = [tuple(r) for r in QUERIES["l2_sorted_export"](spark, sf).collect()]
    assert got == sorted(got)


def test_all_benchmark_items_are_compared(spark, tmp_path):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    items, rows = [(i, text(8)) for i in range(50)], [(i, text(200)) for i in range(130)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def run(a, b):
        a, b = a.split(), b.split()
        return max(n for n in range(9) if any(a[i : i + n] == b[j : j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1)))

    got = QUERIES["m2_longest_common_run"](spark, str(tmp_path)).collect()
    want = [(i, i % 50, run(t, items[i % 50][1])) for i, t in rows]
    assert sorted((r.doc_id, r.item_id, r.run) for r in got) == want
    shares = QUERIES["m3_run_shares"](spark, str(tmp_path)).first()
    assert tuple(shares) == (130, sum(r <= 5 for _, _, r in want), sum(2 * r >= 8 for _, _, r in want))
    got = {r.item_id: (r.n, round(r.mean_jaccard, 9)) for r in QUERIES["a26_citation_relevance"](spark, str(tmp_path)).collect()}
    similar = lambda a, b: len(a & b) / len(a | b)
    words = lambda t: set(re.findall("[a-z0-9]+", t))
    for i, t in items:
        mine = [similar(words(u), words(t)) for d, u in rows if d % 50 == i]
        assert got[i] == (len(mine), round(sum(mine) / len(mine), 9))
    assert len(got) == 50
