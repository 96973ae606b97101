"""Mixing sources to target weights by Pfair scheduling.

A source with weight w owns one slot in 1/w: its i-th block (from 0) is released at slot floor(i / w) and due
by slot ceil((i + 1) / w). Giving each slot to the released block with the earliest deadline meets every
deadline as long as the weights sum to one, so after t slots every source has been given w * t blocks, short
or over by less than one.

Weights are integer shares of CYCLE = 2^40, so over t slots rounding moves a target by less than t / 2^39 blocks.
Only blocks that exist are scheduled, one step each, in one task that streams the table (source, block, slot,
release, deadline) into the shared folder: some 16,000 rows a GB of text.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.llm.common import written
from grainsift.session import reach_workers

CYCLE = 1 << 40  # weights are rounded to multiples of 1 / CYCLE
BLOCK = 1 << 16  # bytes of text
CHUNKS = 256  # pieces of a source that are summed apart; raised with its rows
ROWS_PER_CHUNK = 4096
MAX_SOURCES = 1 << 18  # (source, rows, bytes) on the driver
BROADCAST_BLOCKS = 500_000  # of the schedule, some 30 MB; beyond, rows meet it by a shuffle
BATCH = 50_000
NULL_SOURCE = "\x00null"
NEW_COLUMNS = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_offset", "mix_on_target")


def shares(weights: Mapping[str, float], cycle: int = CYCLE) -> dict[str, int]:
    """Weights as integers of sum `cycle`, each at least 1, by largest remainders."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) > cycle:
        raise ValueError(f"{len(weights)} sources; at most {cycle} fit the cycle")
    total = sum(weights.values())
    exact = {s: w / total * cycle for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    spare = cycle - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(0, spare)]:
        out[s] += 1
    while sum(out.values()) > cycle:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -cycle, s))] -= 1
    return out


def schedule(share: Sequence[int], blocks: Sequence[int], cycle: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the first blocks[k] blocks of each source k, earliest deadline first."""
    waiting = [(0, k, 0) for k, n in enumerate(blocks) if n]  # (release, source, block)
    heapq.heapify(waiting)
    ready, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * cycle // share[k]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        yield k, i, slot, release, deadline
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, ((i + 1) * cycle // share[k], k, i + 1))
        slot += 1


def cycle_table(share: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, index of the block in the cycle, slot) for one cycle."""
    names = sorted(share)
    counts = [share[s] for s in names]
    return [(names[k], i, slot) for k, i, slot, _, _ in schedule(counts, counts, sum(counts))]


def _schedule_table(spark: SparkSession, share: Sequence[int], blocks: Sequence[int], cycle: int) -> DataFrame:
    """schedule() as a table in the shared folder, streamed by one task."""
    names = ["mix_k", "mix_block", "mix_slot", "mix_release", "mix_deadline"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows = schedule(share, blocks, cycle)
            while part := list(itertools.islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names)

    reach_workers(spark)
    return written(spark.range(0, 1, 1, 1).mapInArrow(run, ", ".join(f"{c} long" for c in names)), "mix-schedule")


def source_totals(docs: DataFrame, *, source_col: str = "source", text_col: str = "text") -> dict[str, tuple[int, int]]:
    """(rows, bytes) of every source over all rows; null is a source of its own. At most MAX_SOURCES rows reach the driver."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    by = docs.groupBy(F.coalesce(source_col, F.lit(NULL_SOURCE)).alias("s")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    found = by.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    return {r.s: (r.rows, r.bytes) for r in found}


def temperature_weights(totals: Mapping[str, tuple[int, int]], alpha: float) -> dict[str, float]:
    """bytes(source) ** alpha."""
    return {s: float(n) ** alpha for s, (_, n) in totals.items()}


def mix_order(docs: DataFrame, weights: Mapping[str, float], *, totals: Mapping[str, tuple[int, int]] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, cycle: int = CYCLE, seed: int = 0) -> DataFrame:
    """docs plus mix_block, mix_slot, mix_release, mix_deadline, mix_offset and mix_on_target.

    Within its source a document's place is a seeded shuffle; its block is the one that holds its first byte
    of the source's stream of texts. Documents in order of (mix_slot, mix_offset) are the mixture. No row is
    dropped or repeated: mix_on_target tells whether the slot lies before the first source runs out; up to there
    each source is within one block of its target, later slots without a released block stay empty.

    Null sources form one source (NULL_SOURCE). Rows of a source without a weight get a null slot and false.
    A text counts its bytes and one more, so null and empty texts have a place too. Rows that repeat an id keep
    their own places. Of the columns of docs only those named like the six new ones are replaced. An empty table gives no rows.

    A hot source is cut into chunks by hash, so no task holds a whole source: chunks are summed first, the few
    sums are accumulated, and places within a chunk are added.
    """
    totals = source_totals(docs, source_col=source_col, text_col=text_col) if totals is None else totals
    share = shares(weights, cycle)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in NEW_COLUMNS]
    own = [f"mix_column_{i}" for i in range(len(kept))]  # names under which they can't clash
    by_name = {c.lower(): c for c in docs.columns}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, own, strict=True)],
        F.col(f"`{by_name[id_col.lower()]}`").alias("mix_id"),
        F.coalesce(source_col, F.lit(NULL_SOURCE)).alias("mix_s"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("mix_n"),
        F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("mix_h"),
        F.xxhash64(text_col).alias("mix_t"),
    )
    chunks = max(CHUNKS, 1 << (max((n for n, _ in totals.values()), default=1) // ROWS_PER_CHUNK).bit_length())
    bits = chunks.bit_length() - 1
    rows = rows.withColumn("mix_c", F.shiftrightunsigned("mix_h", 64 - bits).cast("int"))

    sums = rows.groupBy("mix_s", "mix_c").agg(F.sum("mix_n").alias("n"))
    before = Window.partitionBy("mix_s").orderBy("mix_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("mix_s", "mix_c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_base"))

    inside = Window.partitionBy("mix_s", "mix_c").orderBy("mix_h", "mix_id", "mix_t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_in", F.coalesce(F.sum("mix_n").over(inside), F.lit(0))).join(sums, ["mix_s", "mix_c"])
    offset = F.col("mix_base") + F.col("mix_in")
    rows = rows.withColumn("mix_block", F.floor(offset / block).cast("long")).withColumn("mix_offset", offset - F.col("mix_block") * block)

    names = sorted(share)
    blocks = [-(-totals[s][1] // block) if s in totals else 0 for s in names]
    slots = _schedule_table(spark, [share[s] for s in names], blocks, cycle)
    number = spark.createDataFrame(pa.table({"mix_s": pa.array(names, pa.string()), "mix_k": pa.array(range(len(names)), pa.int64())}))  # one row per source
    rows = rows.join(F.broadcast(number), "mix_s", "left")
    rows = rows.join(F.broadcast(slots) if sum(blocks) <= BROADCAST_BLOCKS else slots.hint("merge"), ["mix_k", "mix_block"], "left")
    # A source runs out with its last whole block; the earliest such release ends the part that is on target.
    end = min((n // block * cycle // share[s] for s, (_, n) in totals.items() if s in share), default=0)
    return rows.select(
        *[F.col(n).alias(c) for c, n in zip(kept, own, strict=True)],
        "mix_block",
        "mix_slot",
        "mix_release",
        "mix_deadline",
        "mix_offset",
        F.coalesce(F.col("mix_slot") < end, F.lit(False)).alias("mix_on_target"),
    )


ALPHA = 0.5  # production weights: square root of a source's bytes


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources, weighted by the square root of their bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    totals = source_totals(docs)
    return mix_order(docs, temperature_weights(totals, ALPHA) or {NULL_SOURCE: 1.0}, totals=totals).drop("text")
