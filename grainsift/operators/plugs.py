"""Plug points for models, judges, tools and embeddings: batch functions with clients that the caller injects.

A client factory is called once per task, so connections are made on executors; offline clients answer from a table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_answers(df: DataFrame, prompt: str, factory: Callable[[], Callable[[str], str]], *, out: str = "answer", spacing: float = 0.0, tries: int = 3) -> DataFrame:
    """Df plus the client's answer and its state: ok, empty or error (after `tries`; an error is never an answer).

    `spacing` seconds pass between calls of one task, so the rate is bounded by partitions / spacing.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string, `{out}_state` string"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, last = factory(), 0.0
        for pdf in batches:
            answers, states = [], []
            for p in pdf[prompt]:
                answer, state = None, "error"
                for _ in range(tries):
                    time.sleep(max(0.0, last + spacing - time.monotonic()))
                    last = time.monotonic()
                    try:
                        answer = client(p)
                        state = "ok" if answer else "empty"
                        break
                    except Exception:  # noqa: BLE001 - a client may fail in any way
                        continue
                answers.append(answer)
                states.append(state)
            yield pdf.assign(**{out: answers, f"{out}_state": states})

    return df.mapInPandas(call, kinds)


def extracted(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Zero to many items from a JSON answer: the array itself, or under `questions` or `items`; unreadable answers give no row."""
    j = F.col(payload)
    array = F.coalesce(F.when(F.ltrim(j).startswith("["), F.from_json(j, f"array<struct<{schema}>>")), F.from_json(F.get_json_object(j, "$.questions"), f"array<struct<{schema}>>"), F.from_json(F.get_json_object(j, "$.items"), f"array<struct<{schema}>>"))
    return df.select("*", F.explode(array).alias("item")).select(*[c for c in df.columns if c != payload], "item.*")


def judged_json(c: Column) -> Column:
    """The JSON object in a judge's answer, fenced or in prose; null if there is none that parses."""
    found = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.json_object_keys(found).isNotNull(), found)


def replayed(calls: DataFrame, cache: DataFrame, live: Callable[[], Callable[[str, str], str]] | None = None) -> DataFrame:
    """Tool calls (tool, args as canonical JSON) answered from a cache (tool, args, response), misses live if allowed: adds response and hit."""
    found = calls.join(cache.groupBy("tool", "args").agg(F.first("response").alias("response")), ["tool", "args"], "left").withColumn("hit", F.col("response").isNotNull())
    if live is None:
        return found
    misses = found.where("NOT hit").drop("response", "hit")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema) + ", response string"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = live()
        for pdf in batches:
            yield pdf.assign(response=[client(t, a) for t, a in zip(pdf.tool, pdf.args, strict=True)])

    return found.where("hit").unionByName(misses.mapInPandas(fetch, kinds).withColumn("hit", F.lit(False)))


def table_client(answers: Mapping[str, str]) -> Callable[[], Callable[[str], str]]:
    """An offline client that answers from a mapping and raises for anything else."""
    return lambda: answers.__getitem__


def hashed_embedding(c: Column, size: int = 64) -> Column:
    """M6 stand-in: unit-length hashed token counts, where no embedding model is at hand. Labelled as a stand-in: no semantics."""

    @F.pandas_udf("array<float>")
    def encode(t: pd.Series) -> pd.Series:
        import zlib

        out = []
        for s in t:
            v = np.zeros(size, np.float32)
            for w in (s or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 16 & 1 else -1
            norm = float(np.sqrt((v * v).sum()))
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out)

    return encode(c)


def flat_results(payload: str, fields: Mapping[str, str], limit: int = 12000) -> Callable[[str], str]:
    """A tool's projected result: named JSON paths of a payload, cut to a length; paths are dotted keys."""

    def project(text: str) -> str:
        data = json.loads(text)
        rows = data.get(payload, []) if isinstance(data, dict) else data

        def at(row, path):
            for k in path.split("."):
                row = row.get(k) if isinstance(row, dict) else None
            return row

        return json.dumps([{k: at(r, p) for k, p in fields.items()} for r in rows], ensure_ascii=False)[:limit]

    return project
