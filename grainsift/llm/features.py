"""Hashed character n-grams and what the classifiers share: training rows, held-out rule, corpus counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsift.llm.common import bounded_batches

MUL = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 18  # characters of a text whose n-grams are held at once
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> lower-cased letter, or a blank for anything else."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                ch = chr(c)
                if ch.isalpha():
                    table[c] = ord(ch.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letters_only(text: str) -> np.ndarray:
    """Lower-cased letters, other characters as single blanks, one blank at either end; empty without a letter."""
    codes = letter_table()[codes_of(text)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    blank = codes == 32
    codes = codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    return codes if len(codes) > 1 else codes[:0]


def buckets(codes: np.ndarray, orders: int, bits: int, new: int = 0) -> np.ndarray:
    """Bucket of every n-gram of 1..orders code points, in [0, 2 ** bits); only of those that end at place `new` or later."""
    out, h, c = [], None, codes.astype(np.uint64) + np.uint64(1)
    for n in range(1, orders + 1):
        if len(codes) < n:
            break
        h = c * MUL if h is None else (h[:-1] ^ (h[:-1] >> np.uint64(31))) * MUL + c[n - 1 :]
        fresh = h[max(0, new - n + 1) :]
        out.append(((fresh ^ (fresh >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def bucket_segments(segments: Iterator[np.ndarray], orders: int, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text given segment by segment: each n-gram once, those across a cut too."""
    tail = np.zeros(0, np.uint32)
    for codes in segments:
        joint = np.concatenate([tail, codes])
        yield buckets(joint, orders, bits, len(tail))
        tail = joint[max(0, len(joint) - orders + 1) :]


def code_segments(text: str) -> Iterator[np.ndarray]:
    """Code points of a text, SEGMENT at a time."""
    return (codes_of(text[i : i + SEGMENT]) for i in range(0, len(text), SEGMENT))


def letter_segments(text: str) -> Iterator[np.ndarray]:
    """letters_only() of a text, about SEGMENT at a time."""
    if len(text) <= SEGMENT:
        yield letters_only(text)
        return
    yield np.full(1, 32, np.uint32)
    last = letter = False  # whether the segment before ended in a letter; whether any came
    for codes in code_segments(text):
        codes = letter_table()[codes]
        blank = codes == 32
        before = np.concatenate([[not last], blank[:-1]])
        last = not blank[-1]
        codes = codes[~(blank & before)]
        letter = letter or bool(len(codes))
        yield codes
    if letter and last:
        yield np.full(1, 32, np.uint32)


def has_letter(text: str) -> bool:
    return any(bool((letter_table()[c] != 32).any()) for c in code_segments(text))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def class_quotas(counts: Mapping[int, int], rows: int) -> dict[int, int]:
    """How many of `rows` training rows each class gets: a quarter of an equal part (one row at least), the rest in proportion."""
    if sum(counts.values()) <= rows:
        return dict(counts)
    out = {k: min(n, max(1, rows // (4 * len(counts)))) for k, n in counts.items()}
    left, open_ = max(0, rows - sum(out.values())), sum(counts.values()) - sum(out.values())
    return {k: m + left * (counts[k] - m) // max(1, open_) for k, m in out.items()}


def sampled_rows(counts: Mapping[int, int], rows: int) -> Column:
    """A condition on rows (_id, _class) that lets pass somewhat more than each class's quota, by hash of the id, so the same
    rows on every run; `collected_features` cuts them to the quotas. counts are the rows of each class in the table itself."""
    share = {k: min(1.0, (1.25 * q + 30) / counts[k]) for k, q in class_quotas(counts, rows).items() if q}
    if not share:
        return F.lit(False)
    top = F.create_map(*[F.lit(x) for k, s in share.items() for x in (int(k), int(-(2**63) + s * (2**64 - 1)) if s < 1 else 2**63 - 1)])
    return F.coalesce(F.xxhash64(F.col("_id"), F.lit(11)) <= F.try_element_at(top, F.col("_class")), F.lit(False))


def bucket_counts(rows: DataFrame, present: Callable[[str], np.ndarray], classes: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows (_class int, _text): documents of each class that hold each bucket, and documents of each class.

    Each task sums its documents; the sums meet in a shuffle on the bucket. At most 2 ** bits rows reach the driver.
    """
    bounded_batches(rows.sparkSession)
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((classes, size + 1), np.int64)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table[k, present(t.as_py() or "")] += 1
                table[k, size] += 1
        for k in range(classes):
            at = np.flatnonzero(table[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(table[k, at])], ["_class", "bucket", "n"])

    sums = rows.select("_class", "_text").mapInArrow(count, "_class int, bucket int, n long").groupBy("bucket").pivot("_class", list(range(classes))).agg(F.sum("n"))
    got = sums.toPandas().fillna(0)
    out = np.zeros((classes, size + 1))
    for k in range(classes):
        out[k, got["bucket"].to_numpy()] = got[str(k)].to_numpy()
    return out[:, :size], out[:, size]


def collected_features(rows: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]], quotas: Mapping[int, int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(hash, class, buckets, values) of a bounded sample of rows (_id, _class, _text): the first of each class by hash, in hash order."""
    bounded_batches(rows.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())],
                ["h", "k", "i", "v"],
            )

    lean = rows.select(F.xxhash64("_id", F.lit(11)).alias("h"), "_class", "_text").mapInArrow(extract, "h long, k int, i binary, v binary")
    out = [(r.h, r.k, np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32)) for r in lean.toLocalIterator()]
    out.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    seen, kept = Counter(), []
    for r in out:
        seen[r[1]] += 1
        if seen[r[1]] <= quotas.get(r[1], 0):
            kept.append(r)
    return kept
