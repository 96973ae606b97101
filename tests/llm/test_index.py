"""The run-length index and the steps around it against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_repeats, docs_of, words

from grainsift.llm import substring_dedup as S
from grainsift.llm.run_index import RunIndex, joined, suffix_order


def texts_of(rnd, alphabet, n):
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3)]
    cut = lambda s: s[rnd.randint(0, len(s)) :]
    return [(cut(rnd.choice(base)) + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 5)))).encode() for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["ab", "abc", "abcdefgh"])
def test_index_against_brute_force(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(60):
        length = rnd.choice([3, 5, 8])
        earlier, later = texts_of(rnd, alphabet, rnd.randint(1, 9)), texts_of(rnd, alphabet, rnd.randint(1, 9))
        symbols, start = joined(earlier)
        whole = lambda i: [(int(c), 0) for c in symbols[i : i + int(np.argmin(symbols[i:]))]] + [(0, i + int(np.argmin(symbols[i:])))]  # noqa: E731, B023
        assert suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=whole)
        index, seen, want = RunIndex(earlier, length), {}, {}
        for k, t in enumerate(earlier):
            for i in range(len(t) - length + 1):
                want[int(start[k]) + i] = seen.setdefault(t[i : i + length], int(start[k]) + i)
        assert dict(zip(*(x.tolist() for x in index.first_places()), strict=True)) == want
        index.forget_order()
        found = index.long_matches(later)
        for a, t in zip(joined(later)[1].tolist(), later, strict=True):
            assert found[a : a + len(t)].tolist() == [i + length <= len(t) and t[i : i + length] in seen for i in range(len(t))]


@pytest.mark.parametrize(("buffer", "large", "batch"), [(1, 20_000, 7), (300, 20_000, 3), (1000, 2, 50), (1 << 22, 1, 1)])
def test_steps_in_small_portions(spark, monkeypatch, buffer, large, batch):
    """Groups that span Arrow batches and buffers, anchors beyond LARGE, flushes of few runs."""
    monkeypatch.setattr(S, "BUFFER", buffer)
    monkeypatch.setattr(S, "LARGE", large)
    monkeypatch.setattr(S, "FLUSH", 40)
    rnd = random.Random(batch)
    common = "".join(rnd.choice("abcdefghij") for _ in range(150))
    rows = []
    for i in range(90):
        at, n = rnd.randint(0, 60), rnd.randint(24, 90)
        rows.append((i, words(rnd, rnd.randint(0, 20)) + common[at : at + n] + words(rnd, rnd.randint(0, 30), 3)))
    rows += [(100 + i, common + "x" * i) for i in range(20)] + [(200, common * 3), (201, "ab" * 200), (202, None)]
    monkeypatch.setattr(S, "bounded_batches", lambda s, **_: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_runs_of_anchors_across_batches():
    """The rows of step 2 don't depend on how its input is cut into batches."""
    rnd = random.Random(4)
    rows = sorted((rnd.randint(0, 6), rnd.randint(0, 4), rnd.randint(0, 9), rnd.randint(0, 3) << 21 | 5 << 1 | (rnd.random() < 0.1)) for _ in range(400))

    def cut(sizes):
        out, i = [], 0
        while i < len(rows):
            part = rows[i : i + (n := rnd.choice(sizes))]
            out += [b.to_pylist() for b in S._meet_runs(iter([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["h", "g", "doc", "at"])]))] if sizes == [400] else [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["h", "g", "doc", "at"])]
            i += n
        if sizes != [400]:
            out = [b.to_pylist() for b in S._meet_runs(iter(out))]
        return sorted(tuple(r.values()) for b in out for r in b)

    whole = cut([400])
    assert whole and all(cut(s) == whole for s in ([1], [2, 3], [1, 50], [120]))


def test_rows_that_share_an_id(spark):
    """Texts of one id are told apart by their places: what stands at the same place in both is not a repeat of itself."""
    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(260)) for _ in range(2))
    rows = [(1, a), (1, a[:180] + b), (1, a), (2, "x" + a), (3, b)]
    got = S.remove_repeats(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 260, 0), (1, 260, 0), (1, 440, 0), (2, 261, 260), (3, 260, 260)]
