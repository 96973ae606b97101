"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

Each document keeps the low 8 bits of 336 minima, packed in 336 bytes. 48 bands of 7 bytes give candidates at
similarity s with probability 1 - (1 - s^7)^48: all but 9e-9 of the links at 0.85. Pairs of a band are compared
on the packed bytes: equal bytes are counted by bit tricks and the estimate is corrected for the 1 in 256
accidental agreements; what falls clearly short is dropped, the rest is confirmed on whole shingle sets.

Documents with equal shingle sets are one node. In each bucket every node first meets two leaders, which settles
tight groups in linear time; only pairs of one bucket whose components still differ are then compared, in
blocks of bounded size, so no link between different texts is lost and no group is expanded into all its pairs.
Rows of a bucket's largest component are copied once for each block of its other rows, not for each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm.common import Memo, bounded_batches, discard, give_back_memory, shuffle_partitions, written
from grainsift.llm.components import components

WORDS = 5
ROWS, BANDS = 7, 48
MINIMA = ROWS * BANDS
LEAST_PERCENT = 80  # here the bands miss a link with 1.3e-5; below, more
MARGIN = 0.08  # four standard errors of the estimate at a threshold of 0.85; wider below
BLOCK = 512  # nodes of a bucket that one task compares with as many others
CELL_EDGES = 1_500
NODE_BYTES, MEMBER_BYTES, STAR_BYTES, WANTED_BYTES = MINIMA + 24, 24, 16, 24  # of a row
BROADCAST_ROWS = 1_000_000  # of (cell, part, id): up to 24 MB of values meet the texts by broadcast, more by a shuffle
_SPLIT = re.compile("[^\x20\x09-\x0d]+").findall
_WORDS = re.compile("[^\x20\x09-\x0d]+").finditer
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), 200_000)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 32, MINIMA, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, MINIMA, np.uint64).astype(np.uint32)[:, None]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of all its words if it has fewer; or nothing."""
    folded = (text or "").translate(_FOLD)
    if len(folded) <= 1 << 20:
        found = _SPLIT(folded)
        w = np.fromiter(map(_WORD.__getitem__, found), np.uint64, len(found))
    else:  # without a list of all words
        w = np.fromiter((_WORD[m.group()] for m in _WORDS(folded)), np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, 0x9E3779B97F4A7C15 + n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(sets: np.ndarray) -> bytes:
    """Low 8 bits of the minima of MINIMA hash functions over a non-empty set."""
    x = (sets >> np.uint64(16)).astype(np.uint32)[None, :]
    out = np.empty(MINIMA, np.uint32)
    for i in range(0, MINIMA, 42):
        least = None
        for j in range(0, x.shape[1], 2048):
            y = (x[:, j : j + 2048] ^ _B[i : i + 42]) * _A[i : i + 42]
            y ^= y >> np.uint32(15)
            m = y.min(axis=1)
            least = m if least is None else np.minimum(least, m)
        out[i : i + 42] = least
    return (out & 255).astype(np.uint8).tobytes()


def matching_bytes(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of the packed bytes of `one` each row of `many` shares, by counting bits."""
    low, x = np.uint64(0x7F7F7F7F7F7F7F7F), one ^ many
    differs = (((x & low) + low) | x) & ~low
    return 8 * many.shape[1] - np.bitwise_count(differs).sum(axis=1, dtype=np.int64)


def estimate(matches: np.ndarray, minima: int) -> np.ndarray:
    """Similarity from the share of equal bytes, corrected for accidental equality."""
    return (matches / minima - 1 / 256) / (1 - 1 / 256)


def lowest_estimate(percent: int) -> float:
    """Pairs whose estimate falls below this are dropped unconfirmed: four standard errors under the threshold."""
    s = percent / 100
    return s - MARGIN * max(1.0, (s * (1 - s) / (0.85 * 0.15)) ** 0.5)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _bucket_pairs(left: list, right: list | None, floor: float) -> Iterator[tuple[int, int]]:
    """Pairs of different components that the estimate keeps, in the first band that they share."""
    def unpack(rows):
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), MINIMA), rows[0][3]

    ids, comps, sig, band = unpack(left)
    ids2, comps2, sig2, _ = (ids, comps, sig, band) if right is None else unpack(right)
    packed, packed2, head = np.ascontiguousarray(sig).view(np.uint64), np.ascontiguousarray(sig2).view(np.uint64), 12
    for i in range(len(ids)):
        at = np.flatnonzero(comps2 != comps[i])
        if right is None:
            at = at[at > i]
        if len(at):
            at = at[estimate(matching_bytes(packed[i, :head], packed2[at, :head]), 8 * head) >= floor - 0.12]
        if len(at):
            at = at[estimate(matching_bytes(packed[i], packed2[at]), MINIMA) >= floor]
        if len(at):
            same = (sig[i] == sig2[at]).reshape(len(at), BANDS, ROWS).all(axis=2)
            at = at[same.argmax(axis=1) == band]
        for j in at.tolist():
            yield int(ids[i]), int(ids2[j])


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every row of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sig"],
            )
        give_back_memory()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _dealt(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) with the cell and the part of it that compares them, of CELL_EDGES pairs or so.

    Cells are dealt by the hashes of both ends. A node with a large share of all pairs fills a row of cells, so cells
    with more than twice their due are cut into parts by the hash of the pair; there are at most n / (2 * CELL_EDGES) such.
    """
    n = pairs.count()
    side = max(1, int((n / CELL_EDGES) ** 0.5) + 1)
    cell = F.pmod(F.xxhash64("u"), F.lit(side)).cast("long") * side + F.pmod(F.xxhash64("v"), F.lit(side))
    pairs = pairs.withColumn("cell", cell)
    full = pairs.groupBy("cell").count().where(F.col("count") > 2 * CELL_EDGES)
    full = full.select("cell", F.ceil(F.col("count") / CELL_EDGES).cast("long").alias("parts"))
    few = n <= BROADCAST_ROWS * 2 * CELL_EDGES
    pairs = pairs.join(F.broadcast(full) if few else full.hint("merge"), "cell", "left")
    return pairs.select("u", "v", "cell", F.pmod(F.xxhash64("u", "v", F.lit(5)), F.coalesce("parts", F.lit(1))).alias("part"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links, checked on full sets.

    Each part of a cell gets the text of a document once, however many of its pairs it is in.
    """
    n = pairs.count()
    pairs = _dealt(pairs)
    wanted = pairs.select("cell", "part", F.col("u").alias("doc_id")).union(pairs.select("cell", "part", "v")).distinct()
    wanted = written(wanted, "near-wanted", most_bytes=2 * n * WANTED_BYTES)
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if small else wanted, "doc_id").select(F.col("cell").alias("at"), F.col("part").alias("of"), "doc_id", "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {}
        for i, t in zip(right.column("doc_id").to_pylist(), right.column("text"), strict=True):
            known.setdefault(i, []).append(shingles(t.as_py()))
        u, v = left.column("u").to_pylist(), left.column("v").to_pylist()
        good = [any(linked(a, b, percent) for a in known.get(x, ()) for b in known.get(y, ())) for x, y in zip(u, v, strict=True)]
        known.clear()
        give_back_memory()
        return left.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.groupBy("cell", "part").cogroup(texts.groupBy("at", "of")).applyInArrow(check, "u long, v long")


def near_groups(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Links are pairs of documents with 100 * intersection >= percent * union of their sets of 5-word shingles.
    component_id is the smallest id reachable over links and equal sets; kept marks the row whose id it is. Null
    and empty texts and texts of blanks have the empty set and stand alone. Rows that share an id are one
    document for linking. Rows with a null id are never linked: component_id null, kept true. An
    empty table gives no rows; other columns are ignored. The bands are laid out for LEAST_PERCENT and more.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {LEAST_PERCENT} and 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = written(_sketches(source), "near-sketches")
    usable = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    nodes = written(nodes, "near-nodes", most_bytes=usable.count() * NODE_BYTES)

    # The low six bits of a bucket's key are its band.
    slot = lambda j: F.xxhash64(j, F.substring("sig", j * ROWS + 1, F.lit(ROWS))).bitwiseAND(~63).bitwiseOR(j.cast("long"))
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), slot)).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = written(bands.join(shared, "key"), "near-members", most_bytes=nodes.count() * BANDS * MEMBER_BYTES)  # the buckets of lone nodes end here
    turn = F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("id"))
    leads = member.groupBy("key").agg(F.array(F.min(turn), F.max(turn)).alias("leads")).select("key", F.col("leads.id").alias("leads"))
    stars = member.join(leads, "key").select("node", F.explode("leads").alias("lead")).where("node <> lead")
    stars = stars.select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")).distinct()
    stars = written(stars, "near-stars", most_bytes=2 * member.count() * STAR_BYTES)
    links = written(_confirmed(stars, source, percent), "near-links")
    label = components(links, most=links.count())

    placed = member.join(label.withColumnRenamed("id", "node"), "node", "left").select("key", F.col("key").bitwiseAND(63).cast("int").alias("band"), "node", "n", F.coalesce("component", "node").alias("comp"))
    placed = written(placed, "near-placed")
    # Of the members of a bucket's largest component none are compared with each other: they only meet the others' blocks.
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("top.comp").alias("main"), F.col("top.m").alias("main_n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rest, most = blocks(F.col("n") - F.col("main_n")), blocks(F.col("main_n"))
    spread = lambda parts: F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")
    in_main = F.col("comp") == F.col("main")
    rows = placed.join(open_, "key").withColumn("own", F.when(in_main, rest + spread(most)).otherwise(spread(rest)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, rest - 1).otherwise(rest + most - 1))))
    rows = rows.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), "node", "comp")
    rows = rows.join(nodes.select("node", "sig"), "node")
    floor = lowest_estimate(percent)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right, out = None, [], [], []

        def close():
            if left and (now[1] == now[2] or right):
                out.extend(_bucket_pairs(left, None if now[1] == now[2] else right, floor))

        def flush():
            u, v = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            key, band, i, j, first, node, comp, sig = (b.column(c).to_pylist() for c in ("key", "band", "i", "j", "first", "node", "comp", "sig"))
            for r in range(len(key)):
                at = (key[r], i[r], j[r])
                if at != now:
                    close()
                    now, left, right = at, [], []
                    if len(out) > 50_000:
                        yield flush()
                (left if first[r] else right).append((node[r], comp[r], sig[r], band[r]))
        if now is not None:
            close()
        if out:
            yield flush()

    dealt = rows.repartition(2 * shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    cross = dealt.mapInArrow(pairs, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # Few of the tasks that compare hold many pairs; they need not each write a file.
    cross = written(cross.repartition(-(-shuffle_partitions(spark) // 8)), "near-cross")
    more = written(_confirmed(cross, source, percent), "near-links")
    links = links.unionByName(more)
    label = components(links, most=links.count())

    classes = nodes.select("digest", "node").join(label.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    # One id may stand on several rows: its smallest component is that of all of them.
    out = sketch.join(classes, "digest", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    for old in (member, stars, placed, cross):
        discard(old)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: components over links of at least 85 percent of 5-word shingles."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
