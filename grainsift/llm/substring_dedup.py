"""Removal of repeated substrings: every byte covered by a 100-byte string that also starts earlier.

A run-length index answers which strings of a text stand in the texts indexed. To index and stream only what can
repeat, texts are routed first: every 100-byte window has one anchor, the 24-byte gram in it with the smallest hash
(leftmost of equals). Equal windows have equal anchors at equal offsets, so only windows of one anchor need to meet.
Windows that follow each other under one anchor form a run, which is what travels:

1. Each task cuts its documents into runs and keeps the first of equal runs; the others are removed at once.
2. Runs meet by anchor, in order. All but the first of equal runs are removed. Where an anchor has different runs, which
   happens at the ends of copied passages, the first of each goes on.
3. Their bytes meet by anchor, in order. The earlier half of each anchor's runs is put into a run-length index (a run-compressed
   Burrows-Wheeler transform with sampled run ends), in which the least place of each window is kept; the matching
   statistics of the later half are streamed through it, and every match of 100 bytes marks a window. Runs with windows left go
   round again. Where an anchor has more than LARGE different runs, its windows travel one by one, spread by their hash.
4. The removed intervals of a document meet its text.

Step 3 compares bytes. Equal runs are told by their anchor's hash and a 64-bit xxh3 of their bytes. No step holds a group
of copies in one task: a hot passage sends one run per task and anchor, and what an anchor or window keeps in memory is its different runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm.common import bounded_batches, give_back_memory, shuffle_partitions, written
from grainsift.llm.run_index import RunIndex

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1  # grams of a window
SEGMENT = 1 << 20  # window starts handled at once
FLUSH = 2_000_000  # runs that a task gathers before it sends the first of equals
NO_ID = -(2**63)

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any substring of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def runs_of(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, start, windows) of the runs of a byte string, segment by segment."""
    for base in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[base : base + SEGMENT + LENGTH - 1]
        hashes = Hashes(part)
        gram = hashes.all_of(GRAM)
        low = np.uint64((1 << 24) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)  # hash first, then place: the leftmost of equals
        span = 1
        while span * 2 <= GRAMS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < GRAMS:
            least = np.minimum(least[: len(least) - (GRAMS - span)], least[GRAMS - span :])
        anchor = (least & low).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(start, len(anchor)))
        yield gram[anchor[start]], start + base, count


def _bytes_of(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, document and start; in that order, which rows have an equal-keyed row of smaller (document, start) before them."""
    order = np.lexsort((start, doc, *keys[::-1]))
    same = np.ones(len(order), bool)
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    if len(order):
        same[0] = False
    group = np.cumsum(~same) - 1
    head = order[np.flatnonzero(~same)][group] if len(order) else order
    later = (doc[order] != doc[head]) | (start[order] != start[head])
    return order, later


# A run's start, its windows (at most 77) and whether it is removed travel as one long, for rows are many and small.
RUN = "h long, g long, doc long, at long"
LARGE = 2_000  # different runs of one anchor; beyond, their windows travel one by one, spread over all tasks
BUFFER = 4 << 20  # bytes of runs that meet at once; an anchor's different runs are carried on


def _packed(start: np.ndarray, n: np.ndarray, flag: np.ndarray | int = 0) -> np.ndarray:
    return (start.astype(np.int64) << 21) | (n.astype(np.int64) << 1) | np.asarray(flag).astype(np.int64)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 21, (at >> 1) & 0xFFFFF, (at & 1).astype(bool)


def _joined_windows(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, packed start and number) of windows, those that follow each other as one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(doc)))
    return doc[head], _packed(start[head], n)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow column of longs as arrays, without Python integers; null is empty."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[x:y] if ok else values[:0] for x, y, ok in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _document_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, g, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, later = _later((h, g), doc, start)
        h, g, doc, start, n = (x[order] for x in (h, g, doc, start, n))
        # A removed run needs no more meeting: its key only spreads such rows evenly.
        return _batch(RUN, np.where(later, _mixed(doc.astype(np.uint64)), h), np.where(later, np.uint64(0), g), doc, _packed(start, n, later))

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = _bytes_of(t)
            raw = data.tobytes()
            for h, start, n in runs_of(data):
                cuts = zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)
                g = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in cuts), np.uint64, len(h))
                parts.append((h, g, np.full(len(h), i, np.int64), start.astype(np.int64), n))
                size += len(h)
            if size >= FLUSH:
                yield flush()
                parts.clear()
                size = 0
    if parts:
        yield flush()


def _meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, at, kind) of batches in order of (h, g, doc, at): removed runs (0), and first runs to check by window: of anchors
    with few (1) or many (2) different runs. Of one anchor LARGE rows are held at most."""
    names = "h long, doc long, at long, kind int"
    last = head = None  # (h, g) of the last live row; (doc, start) of the first row of this kind
    held: list[tuple[np.ndarray, ...]] = []  # first runs of the open anchor that are not out yet
    count, large = 0, False

    def out(rows: tuple[np.ndarray, ...], kind: int | np.ndarray) -> pa.RecordBatch:
        return _batch(names, *rows, np.broadcast_to(np.asarray(kind, np.int32), len(rows[0])))

    def release() -> Iterator[pa.RecordBatch]:
        if held and (large or count > 1):
            yield out(tuple(map(np.concatenate, zip(*held, strict=True))), 2 if large else 1)
        held.clear()

    for b in batches:
        h, g, doc, at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        gone = (at & 1).astype(bool)
        if gone.any():
            yield out((h[gone], doc[gone], at[gone] & ~1), 0)
        h, g, doc, at = (x[~gone] for x in (h, g, doc, at))
        if not len(h):
            continue
        start = at >> 21
        new = np.concatenate([[(h[0], g[0]) != last], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        head_doc, head_start = (np.where(first < 0, c, x[first]) for x, c in zip((doc, start), head or (0, 0), strict=True))
        later = ~new & ((doc != head_doc) | (start != head_start))
        if later.any():
            yield out((h[later], doc[later], at[later]), 0)
        head, before = (int(head_doc[-1]), int(head_start[-1])), last
        last = (h[-1], g[-1])
        h, doc, at = h[new], doc[new], at[new]
        if not len(h):
            continue
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(edge, len(h)))
        goes_on = before is not None and h[0] == before[0]
        if not goes_on:
            yield from release()
            count, large = 0, False
        for k in sorted({0, len(edge) - 1}):  # the anchors at either end of the batch may have more runs in other batches
            if k:
                yield from release()
                count, large = 0, False
            rows = tuple(x[edge[k] : edge[k] + size[k]] for x in (h, doc, at))
            held.append(rows)
            count += int(size[k])
            large = large or count > LARGE
            if large:
                yield from release()
        inner = np.repeat(size, size)
        inner[: size[0]] = 0
        inner[len(h) - size[-1] :] = 0
        some = inner > 1
        if some.any():
            yield out((h[some], doc[some], at[some]), np.where(inner[some] > LARGE, 2, 1).astype(np.int32))
    yield from release()


MET = "h long, w long, doc long, start long, text binary"


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, w, doc, start, text) of the runs listed with each text: the bytes of a run and w 0, or, for anchors with many
    different runs, those of each window and its hash w, which only spreads them."""
    for b in batches:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        text: list[bytes] = []
        for i, t, h, at in zip(b.column(0).to_pylist(), b.column(1), _lists(b.column(2)), _lists(b.column(3)), strict=True):
            data = _bytes_of(t)
            start, n, many = _unpacked(at)
            fits = start + n + LENGTH - 1 <= len(data)
            h, start, n, many = h[fits], start[fits], n[fits], many[fits]
            raw = data.tobytes()
            few = ~many
            rows.append((h[few], np.zeros(few.sum(), np.uint64), np.full(few.sum(), i, np.int64), start[few]))
            text += [raw[s : s + k + LENGTH - 1] for s, k in zip(start[few].tolist(), n[few].tolist(), strict=True)]
            for base in np.unique(start[many] // SEGMENT).tolist():
                mine = many & (start // SEGMENT == base)
                k = n[mine]
                hashes = Hashes(data[base * SEGMENT : (base + 1) * SEGMENT + LENGTH - 1])
                first = np.repeat(start[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                rows.append((np.repeat(h[mine], k), hashes.of(first - base * SEGMENT, LENGTH), np.full(len(first), i, np.int64), first))
                text += [raw[s : s + LENGTH] for s in first.tolist()]
        if text:
            h, w, doc, start = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(w.view(np.int64)), pa.array(doc), pa.array(start), pa.array(text, pa.binary())], ["h", "w", "doc", "start", "text"])


def repeated_windows(group: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, repeated) of every window of texts, which stand in order within each group: whether an earlier text of the
    group holds it too. No text holds a window twice, and no two groups share one."""
    windows = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
    base = np.cumsum(windows) - windows
    marked = np.zeros(int(windows.sum()), bool)

    def spread(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        """start + 0, 1, .. for each window of the rows."""
        n = windows[rows]
        return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    live = np.arange(len(texts))
    while True:
        edge = np.flatnonzero(np.concatenate([[True], group[live][1:] != group[live][:-1]])) if len(live) else live
        size = np.diff(np.append(edge, len(live)))
        n, nth = np.repeat(size, size), np.arange(len(live)) - np.repeat(edge, size)
        earlier, later = live[(n > 1) & (nth < (n + 1) // 2)], live[nth >= (n + 1) // 2]
        if not len(earlier):
            break
        index = RunIndex([texts[i] for i in earlier.tolist()], LENGTH)
        place, least = index.first_places()
        place = place[place != least]
        text = np.searchsorted(index.start, place, "right") - 1
        marked[base[earlier[text]] + place - index.start[text]] = True
        index.forget_order()
        streamed = [texts[i] for i in later.tolist()]
        size = windows[later] + LENGTH
        found = index.long_matches(streamed)[spread(later, np.cumsum(size) - size)]
        marked[spread(later, base[later])] |= found
        left = np.add.reduceat(~marked, base, dtype=np.int64)
        live = later[left[later] > 0]
    every = np.arange(len(texts))
    return np.repeat(every, windows), spread(every, np.zeros(len(texts), np.int64)), marked


def _by_table(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The same for one group whose texts overlap in a document, as rows that share an id do: a window is compared with its first
    place, and one at that very place is not repeated."""
    rows = sorted((d, s + i, k, i) for k, (d, s, t) in enumerate(zip(doc.tolist(), start.tolist(), texts, strict=True)) for i in range(len(t) - LENGTH + 1))
    first: dict[bytes, tuple[int, int]] = {}
    out = [np.zeros(len(t) - LENGTH + 1, bool) for t in texts]
    for d, s, k, i in rows:
        out[k][i] = first.setdefault(texts[k][i : i + LENGTH], (d, s)) != (d, s)
    return np.concatenate(out)


def _meet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that also occur earlier, as rows (doc, at), of batches in order of (h, w, doc, start). Of the last group of a buffer
    the texts that hold something new are carried into the next."""
    held: list[tuple] = []  # (h, w, doc, start, known) columns and texts
    size = 0

    def met(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal size
        h, w, doc, start, known = (np.concatenate(c) for c in zip(*(r[:5] for r in held), strict=True))
        text = [t for r in held for t in r[5]]
        held.clear()
        size = 0
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (w[1:] == w[:-1])])
        twin = np.concatenate([[False], same[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
        twin[twin] = [text[i] == text[i - 1] for i in np.flatnonzero(twin).tolist()]  # repeated rows share what is removed
        if twin.any():
            keep = np.flatnonzero(~twin)
            h, w, doc, start, known, text = h[keep], w[keep], doc[keep], start[keep], known[keep], [text[i] for i in keep.tolist()]
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (w[1:] == w[:-1])])
        group = np.cumsum(~same) - 1
        n = np.fromiter(map(len, text), np.int64, len(text)) - LENGTH + 1
        overlap = np.concatenate([[False], same[1:] & (doc[1:] == doc[:-1]) & (start[1:] < start[:-1] + n[:-1])])
        odd = np.isin(group, group[overlap])
        row, inside, repeated = repeated_windows(np.where(odd, -1 - np.arange(len(group)), group), text)
        for k in np.unique(group[odd]).tolist():
            mine = np.flatnonzero(group == k)
            repeated[np.isin(row, mine)] = _by_table(doc[mine], start[mine], [text[i] for i in mine.tolist()])
        out = repeated & ~known[row]
        yield _batch("doc long, at long", *_joined_windows(doc[row[out]], start[row[out]] + inside[out]))
        if not final:
            fresh = np.bincount(row, ~repeated, len(text)) > 0
            carried = np.flatnonzero((group == group[-1]) & (fresh | known))
            held.append((h[carried], w[carried], doc[carried], start[carried], np.ones(len(carried), bool), [text[i] for i in carried.tolist()]))

    for b in batches:
        if b.num_rows:
            text = b.column(4).to_pylist()
            held.append((*(c.to_numpy(zero_copy_only=False) for c in b.columns[:4]), np.zeros(b.num_rows, bool), text))
            size += sum(map(len, text))
            if size >= BUFFER:
                yield from met(False)
    if held:
        yield from met(True)
    give_back_memory()


def _removals(batches: Iterator[pa.RecordBatch], tail: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, gone in zip(b.column(1), _lists(b.column(2)), strict=True):
            data = _bytes_of(t)
            edge = np.zeros(len(data) + 1, np.int32)
            start, n, _ = _unpacked(gone)
            start, n = start[start < len(data)], n[start < len(data)]
            np.add.at(edge, start, 1)
            np.subtract.at(edge, np.minimum(start + n + LENGTH - 1, len(data)), 1)
            out = np.cumsum(edge[:-1]) > 0
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            rows.append((len(data), int(out.sum()), spans, data[~out].tobytes()))
        size, removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), *([pa.array(kept, pa.binary())] if tail else [])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if tail else [])],
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.

    A byte goes when a 100-byte string over it also starts earlier: in a document of smaller id, or further ahead in
    the same one. Strings are judged on the input. Null and empty texts and those of under 100 bytes lose nothing.
    A null id stands before all others. Rows that share an id are told apart by their starts alone: repeated rows
    leave each other alone, and what goes from one goes at the same place from the other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=10_000, mbytes=8)
    parts = shuffle_partitions(spark)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))

    runs = source.mapInArrow(_document_runs, RUN).repartition(parts, "h").sortWithinPartitions("h", "g", "doc", "at")
    met = written(runs.mapInArrow(_meet_runs, "h long, doc long, at long, kind int"), "repeat-runs")

    check = met.where("kind > 0").select("doc", "h", F.col("at").bitwiseOR((F.col("kind") == 2).cast("long")).alias("at"))
    lists = check.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("r")).select("doc", F.col("r.h").alias("h"), F.col("r.at").alias("at"))
    rows = source.join(lists, "doc").select("doc", "text", "h", "at").mapInArrow(_run_rows, MET)
    single = rows.repartition(parts, "h", "w").sortWithinPartitions("h", "w", "doc", "start").mapInArrow(_meet_rows, "doc long, at long")
    gone = met.where("kind = 0").select("doc", "at").unionByName(written(single, "repeat-windows"))

    spans = gone.groupBy("doc").agg(F.collect_list("at").alias("gone"))
    lists = source.join(spans, "doc", "left").select("doc", "text", "gone")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    out = lists.mapInArrow(lambda b: _removals(b, with_kept), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).withColumnRenamed("doc_id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: bytes covered by an earlier 100-byte string are removed from every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
