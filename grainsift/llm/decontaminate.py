"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs with at most e edits shares at least m - q + 1 - q * e of its q-grams
with the text, all on diagonals within e of each other. Shared q-grams are counted in diagonal bands of
2 e, each overlapping the next by e, so some band holds them all; bands that reach the bound are verified by
banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm.common import bounded_batches, give_back_memory

Q = 8
EDIT_RATE = 0.1
PIECE, STEP = 128, 64  # longer passages are searched in overlapping pieces
BLOCK_CHARS = 4 << 20  # passage characters indexed at once; more are searched block after block
BITS = 20
STRETCH = 1 << 16  # characters searched at once
HITS = 1 << 20  # postings expanded at once
SPAN = 1 << 20  # band numbers of one piece in a stretch

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> lower-cased letter or digit, or a blank."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalnum():
                table[c] = ord(ch.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


_NARROW: list[bytes] = []


def folded(text: str) -> np.ndarray:
    """Code points of a text folded one by one; texts within Latin-1 as bytes, which is several times faster."""
    if not _NARROW:
        _NARROW.append(bytes(int(c) if c < 256 else 32 for c in _fold()[:256]))
    try:
        return np.frombuffer(text.encode("latin-1").translate(_NARROW[0]), np.uint8)
    except UnicodeEncodeError:
        return _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def stays(codes: np.ndarray) -> np.ndarray:
    """Which folded characters the normal form keeps: all but blanks that follow a blank or stand at an end."""
    blank = codes == 32
    out = ~blank
    out[1:] |= blank[1:] & ~blank[:-1]
    if len(out):
        out[0] &= not blank[0]
        if blank[-1]:
            out[len(out) - 1 - int(np.argmin(blank[::-1])) + 1 :] = False
    return out


def normal_form(text: str) -> np.ndarray:
    codes = folded(text)
    return codes[stays(codes)]


def grams(codes: np.ndarray) -> np.ndarray:
    """32-bit hashes of all windows of Q = 8 code points; the alignment settles collisions."""
    if len(codes) < Q:
        return np.zeros(0, np.uint32)
    h = codes.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77)
    for n, m in zip((1, 2, 4), (0x9E3779B1, 0xC2B2AE3D, 0x27D4EB2F), strict=True):
        h = (h[:-n] ^ (h[:-n] >> np.uint32(15))) * np.uint32(m) + h[n:]
    return h * np.uint32(0x165667B1)


class PassageIndex:
    """q-grams of all pieces of the passages, with the lemma's bound for each piece."""

    def __init__(self, items: Sequence[tuple[int, str]], rate: float = EDIT_RATE):
        self.items, self.pieces, self.edits, hashes, owner, at = [], [], [], [], [], []
        known: dict[bytes, int] = {}  # equal pieces are searched once
        for item, text in items:
            codes = normal_form(text or "")
            if len(codes) < Q:
                continue
            last, mine = len(codes) - PIECE, set()
            for start in [0] if last <= 0 else sorted({*range(0, last, STEP), last}):
                piece = codes[start : start + PIECE]
                p = known.setdefault(piece.astype(np.uint32).tobytes(), len(self.pieces))
                if p < len(self.pieces):
                    if p not in mine:
                        self.items[p].append(item)
                    mine.add(p)
                    continue
                mine.add(p)
                g = grams(piece)
                self.items.append([item])
                self.edits.append(min(int(rate * len(piece)), (len(piece) - Q) // Q))  # so that the lemma asks for one gram at least
                hashes.append(g)
                owner.append(np.full(len(g), len(self.pieces)))
                at.append(np.arange(len(g)))
                self.pieces.append(piece)
        self.edits = np.array(self.edits, np.int64)
        self.need = np.array([len(p) - Q + 1 for p in self.pieces], np.int64) - Q * self.edits
        self.width = np.maximum(1, self.edits)
        self.reach = PIECE + 4 * int(self.edits.max(initial=0)) + Q
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.owner, self.at = (np.concatenate(x)[order] if hashes else np.zeros(0, np.int64) for x in (owner, at))
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.gate = np.zeros(1 << BITS, bool)
        self.gate[h >> np.uint32(32 - BITS)] = True

    def _crowded_bands(self, codes: np.ndarray) -> np.ndarray:
        """Numbers piece * SPAN + band of the diagonal bands of a stretch of text that hold enough q-grams, in ascending order.

        Postings are counted at most HITS at a time, so a gram that many pieces or places share takes time but no memory.
        """
        h = grams(codes)
        spots = np.flatnonzero(self.gate[h >> np.uint32(32 - BITS)])
        slot = np.searchsorted(self.keys, h[spots])
        slot[slot == len(self.keys)] = 0
        real = self.keys[slot] == h[spots]
        spots, slot = spots[real], slot[real]
        ends = np.cumsum(self.count[slot])
        keys, hits, i = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while i < len(spots):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
            n = self.count[slot[i:j]]
            post = np.repeat(self.first[slot[i:j]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            piece = self.owner[post]
            band = np.floor_divide(np.repeat(spots[i:j], n) - self.at[post], self.width[piece])
            key = piece * SPAN + (band + SPAN // 2)
            some, times = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # band b covers b * w .. (b + 2) * w
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            hits = np.bincount(back, np.concatenate([hits, times]), len(keys)).astype(np.int64)
            i = j
        return keys[hits >= self.need[keys // SPAN]] if len(keys) else keys

    def _region(self, p: int, codes: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """The best (start, end, edits) of piece p that starts on a diagonal from low to high."""
        piece, e = self.pieces[p], int(self.edits[p])
        lo, hi = max(0, low), min(len(codes), high + len(piece))
        if hi - lo >= len(piece):  # a copy to the letter
            window = np.lib.stride_tricks.sliding_window_view(codes[lo:hi], len(piece))
            starts = np.flatnonzero(window[:, 0] == piece[0])
            same = starts[(window[starts] == piece).all(axis=1)]
            if len(same):
                return lo + int(same[0]), lo + int(same[0]) + len(piece), 0
        lo, hi = max(0, low - e), min(len(codes), high + len(piece) + e)
        hit = align(piece, codes[lo:hi], low - lo, high - lo, e) if e and hi > lo else None
        return (lo + hit[0], lo + hit[1], hit[2]) if hit else None

    def find(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified regions, in characters of the text: for each piece, from left to right, all
        that don't overlap; where two bands show a place, the one with fewer edits. A long text is searched in stretches that
        overlap by more than any region."""
        plain = folded(text)
        kept = stays(plain)
        codes = plain[kept]
        found: list[tuple[int, int, int, int]] = []
        free: dict[int, int] = {}  # where the last region of a piece ends
        for a in range(0, len(codes) - Q + 1 if len(self.keys) else 0, STRETCH):
            part = codes[a : a + STRETCH + self.reach]
            bands = self._crowded_bands(part)
            listed = set(bands.tolist())
            for k in bands.tolist():
                p, w = k // SPAN, int(self.width[k // SPAN])
                d = (k % SPAN - SPAN // 2) * w
                start = free.get(p, 0) - a
                if d + 2 * w < start:
                    continue
                hit = self._region(p, part, max(d, start), d + 2 * w)
                if hit and hit[2] and k + 1 in listed:
                    other = self._region(p, part, max(d + w, start), d + 3 * w)
                    hit = other if other and other[2] < hit[2] else hit
                if hit:
                    found.append((p, a + hit[0], a + hit[1], hit[2]))
                    free[p] = a + hit[1]
                    if first_only:
                        break
            if first_only and found:
                break
        where = np.flatnonzero(kept) if found else None
        return [(item, int(where[x]), int(where[y - 1]) + 1, e) for p, x, y, e in found for item in self.items[p]]


def align(piece: np.ndarray, window: np.ndarray, d_low: int, d_high: int, budget: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of piece in window with start diagonals d_low..d_high, or None beyond the budget.

    Rows run over the piece; only the band of diagonals that the budget can reach is computed.
    """
    lo, hi = d_low - budget, d_high + budget
    width, far = hi - lo + 1, 1 << 20
    offsets = np.arange(width)
    column = lo + offsets  # window position before the next piece character, in row 0
    # Cost and start of each cell as one number, cost * FIELD + start, so that a minimum carries the start along.
    field = 1 << 32
    limit = far * field
    cell = np.where((column >= 0) & (column <= len(window)) & (column >= d_low) & (column <= d_high), column, limit)
    padded = np.concatenate([np.zeros(max(0, -lo), window.dtype), window, np.zeros(max(0, hi + len(piece) - len(window)) + 1, window.dtype)])
    shift, slide = max(0, -lo), offsets * field
    for i, ch in enumerate(piece.tolist()):
        at = lo + i + shift
        best = cell + (padded[at : at + width] != ch) * field
        np.minimum(best[:-1], cell[1:] + field, out=best[:-1])  # the piece's character is missing in the window
        edge = lo + i + 1
        if edge < 0:
            best[:-edge] = limit
        if edge + width - 1 > len(window):
            best[max(0, len(window) + 1 - edge) :] = limit
        cell = np.minimum.accumulate(best - slide) + slide  # window characters inserted: moves right along the row
        if i % 8 == 7 and cell.min() >= (budget + 1) * field:
            return None
    cost, start = cell // field, cell % field
    j = int(np.argmin(cost))
    end = lo + len(piece) + j
    return (int(start[j]), int(end), int(cost[j])) if cost[j] <= budget and end > start[j] else None


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks of at most BLOCK_CHARS characters (or one passage), streamed to the driver."""
    block, size = [], 0
    for item, text in benchmark.select(item_col, F.coalesce(text_col, F.lit(""))).toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """(id, item_id, start, end, edits): where a piece of a passage occurs in a document within the edit budget.

    Case, punctuation and blanks don't count. A passage of up to PIECE characters is one piece; longer ones are
    cut into overlapping pieces, so a copied part of PIECE + STEP characters is found too. A piece of m characters
    may differ by rate * m edits, and by m / Q - 1 at most (one less than a tenth for some passages under 32
    characters). A place where a piece occurs is one region, every further place another. Passages of under Q
    characters are never matched; null and empty texts and passages match nothing; rows that repeat an id or a
    passage are reported each for itself; equal pieces within one passage once. Empty tables give no rows. Other columns are ignored.

    Passages are broadcast in blocks of bounded size, one pass over the documents for each block; documents are
    read whole and never shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, item_id long, start long, end long, edits int"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") >= Q)
    parts = []
    for block in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(shared.value, rate)
            for b in batches:
                ids = b.column(0)
                found = [(i, *hit) for i, t in enumerate(b.column(1)) for hit in index.find(t.as_py())]
                if found:
                    at, item, start, end, edits = zip(*found, strict=True)
                    cols = [pa.array(x, pa.int64()) for x in (item, start, end)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *cols, pa.array(edits, pa.int32())], ["_id", "item_id", "start", "end", "edits"])
            del index
            give_back_memory()

        parts.append(rows.mapInArrow(search, schema))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_id", id_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs, all columns, in which no passage is found; narrow, one pass for each block of passages."""
    spark = docs.sparkSession
    bounded_batches(spark)
    place = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(shared.value, rate)
            for b in batches:
                good = [not (t.is_valid and index.find(t.as_py(), first_only=True)) for t in b.column(place)]
                yield b.filter(pa.array(good, pa.bool_()))
            del index
            give_back_memory()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents: one row for each document and passage, with regions found and fewest edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = contaminated_regions(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("regions"), F.min("edits").alias("min_edits"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
