"""Training-data operators against brute force, round trips and held-out accuracy, with edge cases."""

import hashlib
import io
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainsift.llm import catalog, common, decontaminate, exact_dedup, language_id, mixing, near_dedup, quality, substring_dedup, token_counts, token_shards, url_filter
from grainsift.llm import components as components_module
from grainsift.llm.components import components

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows, parts=3):
    """rows of (doc_id, text); with columns whose names clash with the operators' own."""
    full = [(i, t, "en", "s") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts).withColumns({c: F.lit(1) for c in ("key", "range", "score", "kept", "n_bytes", "node", "h")})


def words(rnd, n, pool=400):
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


def test_catalogue_and_entry():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in catalog.queries()} == set(range(1, 11))
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


# -- 1 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_exact_dedup_brute(spark, keep, ranges):
    rnd = random.Random(ranges)
    pool = ["", "a", "b" * 5000, "same head and then x", "same head and then y", "é\x00z"]
    rows = [(i - 20, rnd.choice(pool) if rnd.random() < 0.8 else "hot") for i in range(120)] + [(500 + i, "hot") for i in range(80)] + [(1, None), (1, None), (None, "a"), (None, "only null")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup.exact_dedup(docs_of(spark, rows), keep=keep, n_ranges=ranges).collect()
    assert len(got) == len(rows)
    kept = Counter()
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = by_hash[r.text_sha256]
        ids = [i for i in groups[t] if i is not None]
        assert r.group_size == len(groups[t])
        assert r.keep_id == ((min if keep == "min" else max)(ids) if ids else None)
        kept[t] += r.kept
        if r.kept and keep == "max":
            assert r.doc_id == r.keep_id
    assert all(kept[t] == 1 for t in groups)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------
def test_pfair_stays_within_one_block():
    rnd = random.Random(4)
    for _ in range(20):
        share = mixing.shares({f"s{i}": rnd.random() + 0.01 for i in range(rnd.randint(1, 9))}, 256)
        assert sum(share.values()) == 256
        done = Counter()
        for s, i, slot in mixing.cycle_table(share):
            assert i == done[s]
            done[s] += 1
            for k, w in share.items():
                assert abs(done[k] - w * (slot + 1) / 256) < 1


def test_mix_order_keeps_all_rows_and_targets(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(0, 300), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(0, "dup", "a"), (0, "dup", "a"), (None, None, "b"), (7, "no weight", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_s", F.lit("clash"))
    weights = {"a": 2.0, "b": 1.0, "c": 1.0, mixing.NULL_SOURCE: 0.5}
    out = mixing.mix_order(df, weights, block=1000, cycle=64).collect()
    assert len(out) == len(rows)
    assert all(r.mix_slot is None and not r.mix_on_target for r in out if r.source == "z")
    placed = [r for r in out if r.mix_slot is not None]
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in placed)
    by = defaultdict(set)
    for r in placed:
        by[r.mix_slot].add(r.source)
    assert all(len(s) == 1 for s in by.values())
    assert any(r.mix_on_target for r in placed)
    share, seen = mixing.shares(weights, 64), Counter()
    end = max(r.mix_slot for r in placed if r.mix_on_target)
    slots = {r.mix_slot: r.source or mixing.NULL_SOURCE for r in placed}
    for t in range(end + 1):
        if t in slots:
            seen[slots[t]] += 1
        assert all(abs(seen[s] - k * (t + 1) / 64) < 1 + 1e-9 for s, k in share.items())
    again = {r.doc_id: r.mix_slot for r in mixing.mix_order(df.repartition(7), weights, block=1000, cycle=64).collect()}
    assert all(again[r.doc_id] == r.mix_slot for r in placed if r.doc_id not in (0, 7, None))


def test_mix_order_stays_within_one_block_of_the_weights(spark):
    weights = {"a": 1.0, "b": 1e-4, "c": 1 / 3}
    rows = [(i, "x" * 15, "a") for i in range(30_000)] + [(i, "y" * 15, "b") for i in range(40_000, 40_010)] + [(i, "z" * 15, "c") for i in range(50_000, 62_000)]
    out = mixing.mix_order(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block=16).where("mix_on_target").collect()
    order, total, done = {r.mix_slot: r.source for r in out}, sum(weights.values()), Counter()
    assert sorted(order) == list(range(len(out))) and len(out) > 35_000
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)
    for t in range(len(out)):
        done[order[t]] += 1
        assert all(abs(done[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weights.items()), t


def test_schedule_of_a_large_corpus():
    rnd = random.Random(11)
    size = {f"s{i}": rnd.randint(10**9, 4 * 10**9) for i in range(19)} | {"big": 15 * 10**9}  # bytes, 60 GB
    weights = {s: n**0.5 for s, n in size.items()}
    names, total = sorted(weights), sum(weights.values())
    share, blocks = mixing.shares(weights), [size[s] // mixing.BLOCK for s in names]
    assert max(abs(share[s] / mixing.CYCLE - w / total) for s, w in weights.items()) * sum(blocks) < 1e-3
    end = min(n * mixing.CYCLE // share[s] for s, n in zip(names, blocks, strict=True))
    done = [0] * len(names)
    exact = [weights[s] / total for s in names]
    for k, i, slot, _, _ in itertools.takewhile(lambda r: r[2] < end, mixing.schedule([share[s] for s in names], blocks, mixing.CYCLE)):
        assert i == done[k] and abs(done[k] - exact[k] * slot) < 1.01  # before its own block: neither early nor late
        done[k] += 1
        assert abs(done[k] - exact[k] * (slot + 1)) < 1.01
    assert end > 200_000


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_mix_order_of_many_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", broadcast)
    rows = [(i, "x" * (i % 40), f"s{i % 5000}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = mixing.source_totals(df)
    out = mixing.mix_order(df, mixing.temperature_weights(totals, 0.5), totals=totals, block=64).collect()
    assert len(totals) == 5000 and len(out) == 10_000 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in out)


# -- 3 ------------------------------------------------------------------------------------------------------
def test_shard_format_lookup():
    rnd = random.Random(2)
    rows = sorted([(rnd.randint(-(10**12), 10**12), rnd.randint(0, 400)) for _ in range(700)] + [(5, 3), (5, 4), (5, 70000)], key=lambda r: r[0])
    rows = [(None, 2), *rows]
    for width in (2, 4):
        f = io.BytesIO()
        w = token_shards.ShardWriter(f, width)
        data = [(k, np.arange(n, dtype=f"<u{width}")) for k, n in rows]
        for k, ids in data:
            w.add(k, ids.tobytes())
        w.close()
        r = token_shards.ShardReader(f)
        assert (r.docs, r.tokens) == (len(rows), sum(n for _, n in rows)) and len(r.index) > 3
        assert [(k, len(ids)) for k, _, ids in r] == rows
        for k in {k for k, _ in rows}:
            assert [len(x) for x in r.lookup(k)] == [n for kk, n in rows if kk == k]
        assert all(r.lookup(k) == [] for k in (10**13, -(10**13), 123456789))


def test_token_shards_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["", None, " lead", "trail ", "two  blanks", "a\nb \n c", "tab\there", "nbsp\u00a0x", "<|endoftext|> in text", "ünï 中文 🙂", "don't we'll", "x" * 30000, "line.\nNext, line"]
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts)] + [(1000 + i, words(rnd, rnd.randint(1, 60))) for i in range(50)] + [(2, "same id"), (2, "same id"), (None, "null id")]
    manifest = token_shards.write_shards(docs_of(spark, rows), str(tmp_path / "s"), "byte_bpe_50k.json", n_shards=4)
    got = token_shards.read_shards(manifest).orderBy("start").collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (str(r[0]), r[2], r[3])  # noqa: E731 - rows of one id may stand in either order
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id != 2], key=key) == sorted([r for r in want if r[0] != 2], key=key)
    assert sorted(r.n_tokens for r in got if r.doc_id == 2) == sorted(r[2] for r in want if r[0] == 2)
    assert token_shards.read_shards(token_shards.write_shards(docs_of(spark, rows).where("false"), str(tmp_path / "e"), "byte_bpe_50k.json")).count() == 0


def test_pieces_are_cut_as_the_library_cuts_them():
    rnd, lib = random.Random(11), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = [chr(c) for c in range(33, 0x2100) if re.fullmatch(f"[0-9{token_shards.LETTERS}{token_shards.MARKS}]", chr(c))]
    assert len(plain) > 500
    odd = ["\n", "\n", "\n\n\n", "'s", "'LL", "'ve", "\"'t", "ª", "²", "½", "µ", "中", "é", "🙂", "ж", "٣", "<|endoftext|>", "\u00ad", "\u200b", "_", "..."]
    texts = [f"a{c}b {c} x{c} {c}9{c} '{c} {c}'s{c}\n{c} end" for c in plain + odd] + ["", "x", "\nlead in", "trail\n", "trail\n\n", "a\n\n\nb c\n\nd", "don't I'll 'tis we'LL"]
    texts += [" ".join("".join(rnd.choice(rnd.choice((odd, plain, "abcdefgh", "ab,.'"))) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for pieces in (10**6, 500):
        encoder = token_shards.PieceEncoder("byte_bpe_50k.json", 4, pieces, 0)
        assert [g for n in range(0, len(texts), 700) for g in encoder.encode_all(texts[n : n + 700])] == want


def test_new_words_go_to_the_model_without_the_pre_tokeniser():
    class Counting:
        def __init__(self, library):
            self.library, self.seen = library, 0

        def encode(self, text, **kw):
            self.seen += len(text)
            return self.library.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            self.seen += sum(map(len, texts))
            return self.library.encode_batch_fast(texts, **kw)

    rnd, encoder = random.Random(5), token_shards.PieceEncoder("byte_bpe_50k.json", 2)
    text = "Start " + " ".join("".join(rnd.choice("abcdefghijklmnoé") for _ in range(9)) + rnd.choice(("", ",", ".\nThen", "'s", " 42")) for _ in range(4000))
    want = np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    encoder.library = Counting(encoder.library)
    assert encoder.encode_all([text]) == [want]
    assert encoder.library.seen < 100  # the first word; formerly each new piece


# -- 4, 7 ---------------------------------------------------------------------------------------------------
def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit_language_model(docs, F.lit(True))
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "x"), (4, "x"), (None, "the of and " * 20000)])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()]
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert all(g[1] in model.langs and 0 < g[2] <= 1 for g in got if g[0] in (4, None)) and len(got) == 6
    none = language_id.fit_language_model(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(odd.where("false"), model).count() == 0


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    z = np.where(rng.random(4000) < 0.8, y, 1 - y)
    logits = np.stack([10.0 * (z == 0), 10.0 * (z == 1)], 1)
    p = language_id.softmax(logits / language_id.fit_temperature(logits, y)).max(1).mean()
    assert abs(p - 0.8) < 0.03


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 60 and (got.predicted == got.quality).mean() > 0.9
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = docs_of(spark, [(i, ("good words here " if i % 2 else "%%% !!! ||| ") * 5) for i in range(60)] + [(0, "dup id"), (None, "x"), (61, None), (62, ""), (63, "long " * 50000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (2, 7), (None, 1), (999, 1)], "doc_id long, quality int")
    model = quality.fit_quality_model(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got if r.doc_id and r.doc_id < 60}
    assert min(v for k, v in score.items() if k % 2) > max(v for k, v in score.items() if not k % 2)
    one_class = quality.fit_quality_model(docs, labels.where("quality = 1"))
    assert len({r.score for r in quality.quality_scores(docs, one_class).collect()}) == 1
    assert quality.quality_scores(docs.where("false"), model, keep_columns=True).count() == 0


# -- 5 ------------------------------------------------------------------------------------------------------
def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen[w] = (i, p)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("large", [20_000, 1])
def test_substring_dedup_brute(spark, monkeypatch, large):
    monkeypatch.setattr(substring_dedup, "LARGE", large)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1024)
    rnd = random.Random(large)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([80, 99, 100, 101, 150, 400]))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 120))) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1, "a" * 350), (4, "ab" * 160), (7, None), (10, ""), (13, passages[5] * 6), (None, passages[0] + passages[1]), (16, words(rnd, 900, 5))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_substring_dedup_repeated_rows_and_empty(spark):
    t = "z" * 50 + "".join(map(chr, range(97, 123))) * 4
    got = substring_dedup.remove_repeats(docs_of(spark, [(1, t), (1, t), (2, t)]), with_kept=True).collect()
    assert Counter((r.doc_id, r.n_removed > 0) for r in got) == {(1, got[0].n_removed > 0 if got[0].doc_id == 1 else False): 2, (2, True): 1}
    assert substring_dedup.remove_repeats(docs_of(spark, [(1, t)]).where("false")).count() == 0


# -- 6 ------------------------------------------------------------------------------------------------------
def shingle_set(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingle_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [2048, 5])
def test_near_groups_brute(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CELL_EDGES", 40)
    rnd = random.Random(block)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "ünï cödé A"), (906, "ünï cödé a"), (None, "one two"), (907, "a b c d e"), (908, words(rnd, 15000, 10**6))]
    for g in range(4):
        base = words(rnd, 120, 5000).split()
        for k in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, 8)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((g * 100 + k * 2, " ".join(w)))
    rows += [(800 + i, words(rnd, 100, 10**6)) for i in range(20)]
    rows.append(rows[-1])
    got = near_dedup.near_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    assert all((r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True)) for r in got)
    size = {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.n_shingles == size[r.doc_id] for r in got)


def test_pipeline_stage_links_from_80_percent(spark):
    import corpus_pipeline as P

    def changed(base, *at):
        return " ".join(f"x{w}" if i in at else w for i, w in enumerate(base))

    rows = []
    for g in range(10):
        base = [f"g{g}w{i}" for i in range(100)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, changed(base, 30, 60)), (10 * g + 2, changed(base, 20, 40, 60, 80))]
    similar = lambda a, b: len(a & b) / len(a | b)
    sets = {i: shingle_set(t) for i, t in rows}
    assert 0.80 <= similar(sets[0], sets[1]) < 0.85 and max(similar(sets[0], sets[2]), similar(sets[1], sets[2])) < 0.80
    kept = P.keep_one_of_near_copies(spark, docs_of(spark, rows), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, _ in rows if i % 10 != 1)


def test_lowest_estimate_keeps_four_standard_errors():
    assert near_dedup.lowest_estimate(85) == 0.85 - 0.08
    for percent in (50, 70, 80, 85):
        s = percent / 100
        assert s - near_dedup.lowest_estimate(percent) >= 4 * (s * (1 - s) / near_dedup.MINIMA) ** 0.5


def test_pairs_of_a_hot_node_are_spread(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL_EDGES", 100)
    edges = [(0, i) for i in range(1, 9001)] + [(i, i + 1) for i in range(1, 3001)]
    dealt = near_dedup._dealt(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.u, r.v) for r in dealt) == sorted(edges)
    assert max(Counter((r.cell, r.part) for r in dealt).values()) <= 250 < max(Counter(r.cell for r in dealt).values())
    assert near_dedup._dealt(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_groups_empty(spark):
    assert near_dedup.near_groups(docs_of(spark, [(1, "x")]).where("false")).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 1.0):
        got = []
        for _ in range(20):
            both, each = rng.integers(0, 1 << 63, (int(1000 * share), 1)), rng.integers(0, 1 << 63, (2, (1000 - int(1000 * share)) // 2 + 1))
            a, b = (np.unique(np.concatenate([both[:, 0], e])).astype(np.uint64) for e in each)
            sig = [np.frombuffer(near_dedup.signature(x), np.uint8) for x in (a, b)]
            est = near_dedup.estimate(near_dedup.matching_bytes(sig[0].view(np.uint64), sig[1].view(np.uint64)[None, :]), near_dedup.MINIMA)[0]
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got.append(est - real)
        assert abs(np.mean(got)) < 0.02


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def part_files(folder):
    """How many files each table below a folder has, by the name of the table."""
    found = Counter(p.parent.name for p in folder.glob("*/part-*"))
    return {name: max(n for k, n in found.items() if k.startswith(name)) for name in {k.rsplit("-", 1)[0] for k in found}}


@pytest.fixture
def many_partitions(spark, tmp_path, monkeypatch):
    """64 shuffle partitions, none joined; intermediate tables go to tmp_path and stay."""
    for module in (near_dedup, components_module):
        monkeypatch.setattr(module, "discard", lambda df: None)
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield tmp_path
    for k, v in was.items():
        spark.conf.set(k, v)


def test_small_intermediate_tables_are_few_files(spark, many_partitions):
    rnd = random.Random(8)
    base = words(rnd, 150, 10_000).split()
    rows = [(i, words(rnd, 40, 10_000)) for i in range(100)]
    for i in range(100, 400):  # a group of many edit rates
        copy = list(base)
        for _ in range(rnd.randrange(6)):
            copy[rnd.randrange(150)] = f"x{rnd.random()}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_groups(docs_of(spark, rows)).collect()
    expected = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in got} == expected and len(set(expected.values())) < 350
    files = part_files(many_partitions)
    assert {"near-nodes", "near-stars", "near-wanted", "near-cross", "cc-edges", "cc-labels", "cc-hooks"} <= set(files)
    assert all(files[k] <= 2 for k in ("near-nodes", "near-members", "near-stars", "near-wanted", "cc-edges", "cc-labels", "cc-hooks")), files
    assert files["near-cross"] <= 8


def test_written_keeps_partitions_of_large_tables(spark):
    rows = spark.range(0, 1000, 1, 16)
    assert len(common.written(rows, "large", most_bytes=common.FILE_BYTES * 16).inputFiles()) == 16
    assert len(common.written(rows, "halved", most_bytes=common.FILE_BYTES * 8).inputFiles()) == 8
    few = common.written(rows, "few", most_bytes=0)
    assert len(few.inputFiles()) == 1 and few.count() == 1000 and common.written(rows.where("false"), "none", most_bytes=0).count() == 0


# -- 8 ------------------------------------------------------------------------------------------------------
def test_token_counts_against_library(monkeypatch):
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.plain
    rnd = random.Random(6)
    alphabet = "abcdefghijzABCΣσς éèüñ中文日本 \n\t'!?.,;:<|>0123ſ́İ ὠ\x1c -_🙂"
    bits = ["the", "don't", "we'll", "<|endoftext|>", "<|startoftext|>", "internationalization", "aaaaaaaaaaaaaaa", "xyzzy"]
    for _ in range(1500):
        text = "".join(rnd.choice(alphabet) if rnd.random() < 0.8 else rnd.choice(bits) for _ in range(rnd.randint(0, 50)))
        monkeypatch.setattr(token_counts, "CHUNK", rnd.choice([3, 7, 1 << 16]))
        assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids), repr(text)


def test_chunk_maps_are_associative():
    c = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(7)
    for _ in range(200):
        a, b, d = (c.chunk_map("".join(rnd.choice("ab 'x\n") for _ in range(rnd.randint(0, 9)))) for _ in range(3))
        assert c.compose(c.compose(a, b), d) == c.compose(a, c.compose(b, d))


def test_token_counts_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 3000), (5, "y" * 40000)]
    got = token_counts.token_counts(docs_of(spark, rows), "word_bpe_49k.json").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id != 5) == sorted([("1", 0, 0, False), ("2", 0, 0, False), ("3", 3, 2, False), ("3", 3, 2, False), ("None", 1, 1, False), ("4", 15000, 3000, True)])
    assert token_counts.token_counts(docs_of(spark, rows).where("false"), "word_bpe_49k.json").count() == 0


# -- 9 ------------------------------------------------------------------------------------------------------
def edit_distance_within(piece, text):
    """Least edits of piece against any substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(piece, 1):
        prev, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(prev[j - 1] + (p != t), prev[j] + 1, row[j - 1] + 1)
    return min(row)


def test_lemma_filter_finds_all_within_budget():
    rnd = random.Random(8)
    for trial in range(40):
        piece = "".join(rnd.choice("abcdefghij ") for _ in range(rnd.choice([20, 60, 100, 128])))
        index = decontaminate.PassageIndex([(1, piece)])
        if not index.pieces:
            continue
        folded = "".join(map(chr, index.pieces[0]))
        edited = list(folded)
        for _ in range(rnd.randint(0, int(index.edits[0]) + 3)):
            p = rnd.randrange(len(edited))
            edited[p : p + 1] = rnd.choice([[], ["q"], [edited[p], "q"]])
        text = "".join(rnd.choice("klmnop ") for _ in range(50)) + " " + "".join(edited) + " " + "".join(rnd.choice("klmnop ") for _ in range(50))
        plain = "".join(map(chr, decontaminate.normal_form(text)))
        best = edit_distance_within(folded, plain)
        hits = index.find(text)
        assert bool(hits) == (best <= index.edits[0]), trial
        if hits:
            assert hits[0][3] == best and 0 <= hits[0][1] < hits[0][2] <= len(text)


def test_decontaminate_edges(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion"
    rows = [(1, "before " + item + " after"), (2, item.upper().replace(" ", ",  ")), (3, item[:30] + " but otherwise this is a different text altogether"), (4, None), (5, ""), (6, "x" * 50000 + item), (6, item), (None, item), (7, "short")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "tiny"), (4, "")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = decontaminate.contaminated_regions(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (6, 1), (None, 1)} and all(r.edits == 0 for r in got)
    left = decontaminate.without_contaminated(docs_of(spark, rows), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7] and left.columns == docs_of(spark, rows).columns
    assert decontaminate.contaminated_regions(docs_of(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.contaminated_regions(docs_of(spark, rows).where("false"), bench).count() == 0


def test_passages_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    rnd = random.Random(9)
    items = [(i, words(rnd, 20, 10**6)) for i in range(5)]
    rows = [(i, "intro " + t) for i, t in items]
    got = decontaminate.contaminated_regions(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(5)}


# -- 10 -----------------------------------------------------------------------------------------------------
def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/77?x", "http://example.com/en/6", "http://xexample.com/en/7", "ftp://com/en/", "http://h.net/de/8#f", "http://h.example.net/de/81", "http://net", "http:///en/", "http://org/es", "http://a.org?/es/", "http://u@b.com:80/en/x", "http://a.com/en/" + "y" * 20000, "http://a.com/en/x", "http://a.com/en/x", "http://" + "a." * 5000 + "com/en/z", "line\n://q.org/es/1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    none = url_filter.url_verdicts(pages, url_filter.rule_table(spark, url_filter.RULES).where("false"), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == len(urls)
    assert url_filter.url_verdicts(pages.where("false"), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("k"))
    bloom = url_filter.blocked_bloom(keys.where("k like '%7'"), "k", 16)
    passed = {r.k for r in url_filter.bloom_pass(keys, "k", bloom, 16).collect()}
    listed = {f"h{i}" for i in range(3000) if i % 10 == 7}
    assert listed <= passed and len(passed) < 1500


# -- pipeline -----------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "token_shards"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = []
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        steps.append((name, docs, after))
        docs = after
    columns = steps[0][1].columns
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for name, _, after in steps[:-1]:
        assert after.columns == columns, name
    before, after = rows(steps[1][1]), rows(steps[1][2])
    groups = brute_groups(list(before.items()))
    assert set(after) == {i for i, c in groups.items() if i == c}
    before, after = rows(steps[2][1]), rows(steps[2][2])
    bench = {r.item_id: "".join(map(chr, decontaminate.normal_form(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    plain = {i: "".join(map(chr, decontaminate.normal_form(t))) for i, t in before.items()}
    assert not [i for i in after if any(b in plain[i] for b in bench.values())]
    assert {i for i in before if i not in after} <= {i for i in before if any(edit_distance_within(b[:128], plain[i]) <= 12 for b in bench.values() if b[:24] in plain[i] or b[-24:] in plain[i] or b[60:84] in plain[i])} | {i for i in before if any(b in plain[i] for b in bench.values())}
    assert rows(steps[3][1]) == rows(steps[3][2])
    out = steps[4][2].orderBy("start").collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, at = rows(steps[4][1]), 0
    for r in out:
        ids = [*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    totals = mixing.source_totals(steps[3][1])
    placed = mixing.mix_order(steps[3][1], mixing.temperature_weights(totals, mixing.ALPHA), totals=totals).orderBy("mix_slot", "mix_offset").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in placed]  # the mixture's order is the order of the tokens
    assert json.dumps(len(out))
