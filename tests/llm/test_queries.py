"""The registered queries over whole tables against brute force, models against plain versions, long texts, every stage on odd input."""

import itertools
import math
import random
import resource
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import brute_groups, brute_repeats, edit_distance_within, shingle_set
from tokenizers import Tokenizer

from grainsift.llm import catalog, decontaminate, features, language_id, mixing, near_dedup, quality, token_counts, url_filter


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(name, spark, sf):
    return catalog.queries()[name](spark, sf)


# -- whole queries ------------------------------------------------------------------------------------------
def edf(weights, blocks):
    """Slots of blocks by earliest deadline first with exact weights, one slot at a time."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    done, out, slot = Counter(), {}, 0
    while any(done[s] < blocks[s] for s in weights):
        ready = [(math.ceil((done[s] + 1) / w), s) for s, w in exact.items() if done[s] < blocks[s] and done[s] / w < slot + 1 and math.floor(done[s] / w) <= slot]
        if ready:
            deadline, s = min(ready)
            out[s, done[s]] = (slot, math.floor(done[s] / exact[s]), deadline)
            done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("block", [mixing.BLOCK, 4000])
def test_op2_against_brute_force(spark, sf, documents, monkeypatch, block):
    monkeypatch.setattr(mixing.mix_order, "__kwdefaults__", mixing.mix_order.__kwdefaults__ | {"block": block})
    got = {r.doc_id: r for r in run("op2_mix_sources", spark, sf).collect()}
    place = {r.doc_id: r.h % (1 << 64) for r in spark.createDataFrame([(i,) for i in documents], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("h")).collect()}
    size = lambda r: len((r.text or "").encode()) + 1
    sources = defaultdict(list)
    for i, r in documents.items():
        sources[r.source if r.source is not None else mixing.NULL_SOURCE].append(i)
    total = {s: sum(size(documents[i]) for i in ids) for s, ids in sources.items()}
    slots = edf({s: n**0.5 for s, n in total.items()}, {s: -(-n // block) for s, n in total.items()})
    assert set(got) == set(documents)
    for s, ids in sources.items():
        offset = 0
        for i in sorted(ids, key=lambda i: (place[i], i)):
            r = got[i]
            assert (r.mix_block, r.mix_offset) == (offset // block, offset % block)
            assert (r.mix_slot, r.mix_release, r.mix_deadline) == slots[s, offset // block]
            offset += size(documents[i])


def test_op3_against_the_library(spark, sf, documents):
    lib, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i in sorted(documents):
        ids = [*lib.encode(documents[i].text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run("op3_token_shards", spark, sf).collect()) == want


def test_op5_against_brute_force(spark, sf, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op5_substring_dedup", spark, sf).collect()}
    assert got == brute_repeats([(i, r.text) for i, r in documents.items()])


def test_op6_against_brute_force(spark, sf, documents):
    want = brute_groups([(i, r.text) for i, r in documents.items()])
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run("op6_near_dedup", spark, sf).collect()) == sorted((i, len(shingle_set(documents[i].text)), c, c == i) for i, c in want.items())


def test_op8_against_the_library(spark, sf, documents):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    want = sorted((i, len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for i, r in documents.items())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run("op8_token_counts", spark, sf).collect()) == want


def test_op9_against_brute_force(spark, sf, documents):
    """Pieces found to the letter by string search are all found; what is found lies within the budget of some piece."""
    plain = lambda t: "".join(map(chr, decontaminate.normal_form(t or "")))
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {i: plain(r.text) for i, r in documents.items()}
    cuts = {k: [t[a : a + 128] for a in ([0] if len(t) <= 128 else sorted({*range(0, len(t) - 128, 64), len(t) - 128}))] for k, t in items.items() if len(t) >= 8}
    copies = {(i, k) for i, t in texts.items() for k, pieces in cuts.items() if any(p in t for p in pieces)}
    got = {(r.doc_id, r.item_id): r for r in run("op9_decontaminate", spark, sf).collect()}
    assert copies and copies <= set(got) and {k for k, r in got.items() if r.min_edits == 0} == copies
    for i, k in set(got) - copies:
        assert min(edit_distance_within(p, texts[i]) for p in cuts[k]) == got[i, k].min_edits
    for i, k in itertools.islice(sorted({(i, k) for i in texts for k in cuts if len(texts[i]) < 2500} - set(got)), 0, None, 997):
        assert all(edit_distance_within(p, texts[i]) > min(len(p) // 10, len(p) // 8 - 1) for p in cuts[k])


# -- models -------------------------------------------------------------------------------------------------
def gram_buckets(text, orders, bits):
    return Counter(int(features.buckets(features.codes_of(text[i : i + n]), n, bits)[-1]) for n in range(1, orders + 1) for i in range(len(text) - n + 1))


def test_language_model_against_a_plain_version(documents):
    rows = [r for r in documents.values() if r.lang and r.text][:60]
    langs = sorted({r.lang for r in rows})
    letters = lambda t: " " + " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in t).split()) + " "
    grams = [gram_buckets(letters(r.text[:300]), language_id.ORDERS, language_id.BITS) for r in rows]
    df = Counter(b for g in grams for b in g)
    idf = {b: math.log((1 + len(rows)) / (1 + n)) + 1 for b, n in df.items()}
    table = np.full(1 << language_id.BITS, math.log(1 + len(rows)) + 1)
    for b, x in idf.items():
        table[b] = x
    vectors = []
    for r, g in zip(rows, grams, strict=True):
        x = {b: (1 + math.log(n)) * idf[b] for b, n in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        x = {b: v / norm for b, v in x.items()}
        at, values = language_id.tfidf(r.text[:300], table)
        assert at.tolist() == sorted(x) and np.allclose(values, [x[b] for b in sorted(x)], atol=1e-6)
        vectors.append((langs.index(r.lang), x))
    size, bias = 1 << language_id.BITS, 1 << language_id.BITS
    z, n = defaultdict(float), defaultdict(float)

    def weight(b, k):
        v = z[b, k]
        if abs(v) <= language_id.L1:
            return 0.0
        return -(v - math.copysign(language_id.L1, v)) / ((language_id.BETA + math.sqrt(n[b, k])) / language_id.ALPHA + language_id.L2)

    for _ in range(2):
        for y, x in vectors:
            x = x | {bias: 0.1}
            w = {(b, k): weight(b, k) for b in x for k in range(len(langs))}
            logits = [sum(v * w[b, k] for b, v in x.items()) for k in range(len(langs))]
            e = [math.exp(v - max(logits)) for v in logits]
            for k in range(len(langs)):
                error = e[k] / sum(e) - (k == y)
                for b, v in x.items():
                    g = error * v
                    z[b, k] += g - (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / language_id.ALPHA * w[b, k]
                    n[b, k] += g * g
    rows = [(y, np.array(sorted(x)), np.array([x[b] for b in sorted(x)])) for y, x in vectors]
    weights, shift = language_id.ftrl(rows, len(langs), size, 2)
    assert all(abs(weights[b, k] - weight(b, k)) < 1e-9 for b in df for k in range(len(langs)))
    assert all(abs(shift[k] - 0.1 * weight(bias, k)) < 1e-9 for k in range(len(langs)))


def test_dual_descent_reaches_the_optimum():
    """The gap between primal and dual objective closes, and plain descent on the same rows ends there too."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(80):
        at = np.sort(rng.choice(30, 6, replace=False))
        x = rng.normal(size=6)
        rows.append((1 if x.sum() + 0.3 * rng.normal() > 0 else -1, at, x))
    cost = {1: 1.0, -1: 0.5}
    w, b = quality.dual_descent(rows, 30, cost, rounds=3000)
    full = np.append(w, b)
    dense = np.zeros((80, 31))
    for i, (_, at, x) in enumerate(rows):
        dense[i, at], dense[i, 30] = x, 1.0
    y, c = np.array([r[0] for r in rows]), np.array([cost[r[0]] for r in rows])
    primal = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (dense @ v))).sum()
    dual = np.zeros(80)
    v = np.zeros(31)
    for _ in range(3000):
        for i in range(80):
            new = min(max(dual[i] - (y[i] * (dense[i] @ v) - 1) / (dense[i] @ dense[i]), 0), c[i])
            v += (new - dual[i]) * y[i] * dense[i]
            dual[i] = new
    assert primal(v) - (dual.sum() - 0.5 * v @ v) < 1e-6  # the plain version is at the optimum
    assert primal(full) - primal(v) < 1e-2 * primal(v)


def test_quality_features_and_ratio_against_a_plain_version():
    for text in ("a a a b", "", "Hello hello, HELLO hello", "é\n\té", "go " * 20):
        words, longest, run_ = text.split(), 0, 0
        for a, b in itertools.pairwise(words):
            run_ = run_ + 1 if a == b else 0
            longest = max(longest, run_)
        want = {max(b, quality.REPEATS) for b in gram_buckets(text, quality.ORDERS, quality.BITS)} | set(range(min(longest, quality.REPEATS)))
        assert set(quality.present(text).tolist()) == want


def test_quality_learns_from_labels_of_its_documents(spark):
    """Thousands of labels of other documents don't push out those that can be learnt from; a rare class is learnt too."""
    rows = [(i, ("good words here " if i % 20 else "%%% !!! ||| ") * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 > 0)) for i in range(400)] + [(10_000 + i, i % 2) for i in range(6000)], "doc_id long, quality int")
    model = quality.fit_quality_model(docs, labels, rows=40)
    score = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    assert min(v for k, v in score.items() if k % 20) > max(v for k, v in score.items() if k % 20 == 0)


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the cat and the dog went to the house " * 2, "en") for i in range(900)] + [(1000 + i, "żółw źdźbło gęś ćma łąka " * 2, "pl") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, F.lit(True), rows=80)
    assert model.predict(["gęś i żółw", "the house"])[0] == ["pl", "en"]


@pytest.mark.parametrize("counts", [{0: 5, 1: 7}, {0: 10_000, 1: 3}, {0: 10**6, 1: 10**6, 2: 10**3}, {k: 50 for k in range(100)}])
def test_quotas_stay_within_the_bound(counts):
    for rows in (10, 100, 4000):
        got = features.class_quotas(counts, rows)
        assert all(1 <= got[k] <= counts[k] for k in counts) and sum(got.values()) <= max(rows, len(counts))


@pytest.mark.parametrize(("module", "name", "value"), [(quality, "BROADCAST_LABELS", 0), (near_dedup, "BROADCAST_ROWS", 0)])
def test_shuffled_ways_give_the_same(spark, sf, monkeypatch, module, name, value):
    query = {quality: "op7_quality", near_dedup: "op6_near_dedup"}[module]
    near = run(query, spark, sf).collect()
    monkeypatch.setattr(module, name, value)
    assert sorted(map(str, run(query, spark, sf).collect())) == sorted(map(str, near))


def test_large_rule_lists(spark, monkeypatch):
    """Hundreds of rules of many shapes, by broadcast and by shuffle, against a plain version; columns with the operator's own names."""
    rnd = random.Random(12)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))
    rules = sorted({(host(), rnd.choice(["", "/" + "x" * rnd.randint(0, 9)])) for _ in range(300)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{host()}/{'x' * rnd.randint(0, 12)}" for _ in range(500)] + ["http://a.b/x"] * 200 + [None] * 50
    pages = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in enumerate(urls)], "page_id long, url string, _url int, _hit int, _key int")

    def judge(u):
        h, _, p = (u or "://").split("://")[1].partition("/")
        fits = [(len(a + b), a + b, v) for a, b, v in rules if u and (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        return (max(fits)[1], max(fits)[2]) if fits else (None, "allow")

    want = [(i, *judge(u)) for i, u in enumerate(urls)]
    for blocks, listed in ((1 << 16, 100_000), (0, 0)):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_BLOCKS", blocks)
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", listed)
        got = url_filter.url_verdicts(pages, url_filter.rule_table(spark, rules))
        assert {"_url", "_hit", "_key"} <= set(got.columns)
        assert sorted((r.page_id, r.rule, r.verdict) for r in got.collect()) == want


# -- long texts ---------------------------------------------------------------------------------------------
def test_state_maps_of_pieces(monkeypatch):
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(7)
    word = "".join(rnd.choice(["the", "tion", "qz", "e", "internat"]) for _ in range(400))
    cuts = sorted(rnd.sample(range(1, len(word)), 3))
    a, b, c = (token_counts.PieceMap(counter.machine, word[i:j]) for i, j in itertools.pairwise([0, *cuts]))
    left, right = token_counts.JointMap(token_counts.JointMap(a, b), c), token_counts.JointMap(a, token_counts.JointMap(b, c))
    states = rnd.sample(counter.machine.content, 40)
    assert all(left.apply(s) == right.apply(s) for s in states) and (left.exit, left.total) == (right.exit, right.total)
    count = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    for piece, meet, most in ((1, 64, 10**5), (3, 1, 10**5), (50, 64, 40)):
        monkeypatch.setattr(token_counts, "PIECE", piece)
        monkeypatch.setattr(token_counts, "MEET", meet)
        monkeypatch.setattr(token_counts, "MAX_STATES", most)
        for _ in range(60):
            t = "".join(rnd.choice(["abc", "the", "é", "zq", "中", "'s", "!?", "xx", "9"]) for _ in range(rnd.randint(1, 60)))
            assert counter.count(t) == count(t), t


@pytest.mark.parametrize("kind", ["repetitive", "blank-free"])
def test_texts_of_20_mb(kind):
    text = "abc de " * 2_900_000 if kind == "repetitive" else "y" * 20_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.count(text) == (len(text) // 7 * 2 if kind == "repetitive" else 20_000_000 // 4)
    sets = near_dedup.shingles(text)
    assert len(sets) == (2 if kind == "repetitive" else 1) and len(near_dedup.signature(sets)) == near_dedup.MINIMA
    idf = np.ones(1 << language_id.BITS)
    short, x = language_id.tfidf(text[:700], idf)
    long_, _ = language_id.tfidf(text, idf)
    assert set(short.tolist()) == set(long_.tolist()) and len(x)
    assert set(quality.present(text).tolist()) >= set(quality.present(text[:700]).tolist())
    index = decontaminate.PassageIndex([(1, text[:100]), (2, "the quick brown fox jumps over the lazy dog")])
    found = index.find(text, first_only=True)
    assert [f[0] for f in found] == [1] and found[0][3] == 0
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 1 << 20  # kB


def test_every_region_is_reported():
    rnd = random.Random(5)
    piece = "".join(rnd.choice("abcdefgh ") for _ in range(100)).strip()
    noise = lambda n: "".join(rnd.choice("klmnop") for _ in range(n))
    index = decontaminate.PassageIndex([(1, piece), (2, piece)])
    text = " ".join([noise(70_000), piece, noise(40), piece[:50] + "zz" + piece[50:], noise(60_000), piece])
    got = index.find(text)
    assert Counter(f[0] for f in got) == {1: 3, 2: 3} and sorted(f[3] for f in got if f[0] == 1) == [0, 0, 2]
    assert all(text[a:b].replace("zz", "") == piece for _, a, b, _ in got)


# -- stages -------------------------------------------------------------------------------------------------
CLASH = ("score", "mix_foo", "mix_slot", "mix_s", "place", "nth", "kept", "key", "c0", "row", "file", "_text", "_id")


def odd_rows(sf, spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sound = "A clean paragraph about rivers, bridges and the towns that grew beside them over many quiet years. "
    odd = [(None, None), (None, "null id, " + sound), (5, "another text under id five: " + sound * 2), (5, "another text under id five: " + sound * 2), (7, ""), (-3, "word " * 60_000), (-4, "x" * 300_000)]
    extra = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd[:-1]] + [(*odd[-1], None, None, 0)], docs.schema)
    return docs.unionByName(extra).withColumns({c: F.lit(1) for c in CLASH})


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontamination", "mixture", "token_shards"])
def test_stage_on_odd_input(spark, sf, tmp_path, stage):
    import corpus_pipeline as P

    f, docs = dict(P.STAGES)[stage], odd_rows(sf, spark)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    out = f(spark, docs, sf)
    if stage == "token_shards":
        assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(i) for (i, _), n in before.items() for _ in range(n))
        starts = out.orderBy("start").collect()
        assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(starts))
        lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert Counter((r.doc_id, r.n_tokens) for r in starts) == sum((Counter({(i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1): n}) for (i, t), n in before.items()), Counter())
    else:
        assert out.columns == docs.columns
        after = Counter((r.doc_id, r.text) for r in out.collect())
        assert after <= before
        rest = set(before) - set(after)
        if stage == "mixture":
            assert after == before
        if stage == "near_duplicates":  # of equal rows one stays; texts without words stay; rows of one id are judged apart
            assert after[5, next(t for i, t in before if i == 5 and t.startswith("another"))] == 1
            assert after[None, None] == 1 and after[7, ""] == 1 and any(i == 5 and not t.startswith("another") for i, t in after)
        if stage == "decontamination":
            assert not {i for i, _ in rest} & {None, 7, -3, -4}
    assert f(spark, docs.where("doc_id = -99"), sf).count() == 0


def test_tokens_of_raw_files_and_of_frames(spark, sf, tmp_path):
    """Order without part numbers in file names, and of a frame that isn't read from files."""
    import corpus_pipeline as P

    raw = P.write_tokens(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).orderBy("start").collect()
    assert [r.doc_id for r in raw] == [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").coalesce(1).collect()]
    frame = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "d")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in P.write_tokens(spark, frame, sf).collect()) == ["1", "1", "None"]
    for i, name in enumerate(["part-00002", "part-00010", "part-00001"]):
        spark.createDataFrame([(i, "t")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}-x.parquet")
    files = spark.read.parquet(*[str(p) for p in tmp_path.glob("*.parquet")])
    assert [r.doc_id for r in P.write_tokens(spark, files, sf).orderBy("start").collect()] == [2, 0, 1]


def test_near_duplicate_stage_against_brute_force(spark, sf, documents):
    """All rows of the table at the stage's own threshold of 80 percent."""
    import corpus_pipeline as P

    sets = {i: shingle_set(r.text) for i, r in documents.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    kept = P.keep_one_of_near_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if find(i) == i)
