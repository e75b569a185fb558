"""Overlapping and gapped time intervals (problem 6).

The state per entity is a mergeable list of sorted disjoint intervals. Partial lists are built before the shuffle, one per
entity and time bucket, and are merged after it. Buckets form the leaves of a tree: only their summaries (where coverage
reaches, where the first gap lies) go up to the entity, and what came before a bucket and what comes after it goes back
down, so no task ever holds all intervals of an entity, however many it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a time bucket. Summaries per entity are bounded by its clock over this length.
BUCKET_MS = 600_000
#: Below any start and above any end.
LOW, HIGH = -(1 << 62), 1 << 62


def disjoint(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals of each group (non-negative ints); intervals that touch become one."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], end[order]
    base = e.min()
    span = int(max(e.max(), s.max()) - min(base, s.min())) + 2
    reach = np.maximum.accumulate(e - base + g * span) - g * span + base  # running maximum of ends within the group
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(g)) - 1
    return g[at], s[at], reach[last]


def _lists(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per (e, b): the merged list of all its intervals."""
    code = frame.groupby(["e", "b"], sort=False, dropna=False).ngroup().to_numpy(np.int64)
    _, first = np.unique(code, return_index=True)
    g, s, e = disjoint(code, frame["s"].to_numpy(np.int64), frame["t"].to_numpy(np.int64))
    cuts = np.searchsorted(g, np.arange(1, len(first)))
    return pd.DataFrame({"e": frame["e"].to_numpy()[first], "b": frame["b"].to_numpy()[first], "s": np.split(s, cuts), "t": np.split(e, cuts)})


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield _lists(batch)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial lists in order of (e, b) to one list each; the last group of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        n = batch["s"].map(len).to_numpy()
        flat = pd.DataFrame({"e": batch["e"].repeat(n), "b": batch["b"].repeat(n), "s": np.concatenate(batch["s"].to_numpy()), "t": np.concatenate(batch["t"].to_numpy())})
        merged = _lists(flat)
        rest = merged.iloc[-1:]
        if len(merged) > 1:
            yield merged.iloc[:-1]
    if rest is not None and len(rest):
        yield rest


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gaps and closed periods of each bucket; the period that is still open at its end is marked by a null end."""
    for batch in batches:
        if not len(batch):
            continue
        n = batch["s"].map(len).to_numpy()
        s, t = np.concatenate(batch["s"].to_numpy()), np.concatenate(batch["t"].to_numpy())
        row = np.repeat(np.arange(len(batch)), n)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        before = np.empty(len(s), np.int64)
        before[1:] = t[:-1]
        before[first] = LOW
        reach = np.maximum(before, batch["before"].to_numpy(np.int64)[row])
        new = s > reach
        at = np.flatnonzero(new)
        r, begin, came = row[at], s[at], reach[at]
        open_ = np.append(r[1:] != r[:-1], True) if len(at) else np.zeros(0, bool)
        until = np.append(came[1:], 0) if len(at) else came
        e, b = batch["e"].to_numpy(), batch["b"].to_numpy()
        yield pd.DataFrame({"e": e[r], "b": b[r], "kind": "period", "s": begin, "t": np.where(open_, LOW, until)})
        gap = came > LOW
        if gap.any():
            yield pd.DataFrame({"e": e[r[gap]], "b": b[r[gap]], "kind": "gap", "s": came[gap], "t": begin[gap]})


def periods_and_gaps(rows: DataFrame, keys: list[str], start_ms: Column, end_ms: Column, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """keys..., kind (`period` or `gap`), start_ms, end_ms: the longest covered stretches and the gaps between them.

    Rows with a null key, start or end, or an end that isn't after the start, don't count. Touching intervals are one
    period. Repeated rows, ties and nesting are no matter; an empty input gives no rows. Keys may be of any type.
    """
    entity = F.to_json(F.struct(*[F.col(k) for k in keys]))
    some = rows
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    src = some.select(entity.alias("e"), start_ms.cast("long").alias("s"), end_ms.cast("long").alias("t")).where("s IS NOT NULL AND t > s").withColumn("b", F.floor(F.col("s") / bucket_ms).cast("long")).select("e", "b", "s", "t")
    lists = "e string, b long, s array<long>, t array<long>"
    leaves = src.mapInPandas(_partial, lists).repartition("e", "b").sortWithinPartitions("e", "b").mapInPandas(_merge, lists)
    leaves = leaves.checkpoint()  # read for the summaries and again for the lists
    tops = leaves.select("e", "b", F.element_at("t", -1).alias("hi"))
    entity_window = Window.partitionBy("e").orderBy("b")
    before = tops.select("e", "b", F.coalesce(F.max("hi").over(entity_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(LOW)).alias("before"), F.max("hi").over(Window.partitionBy("e")).alias("top"))
    pieces = leaves.join(before.select("e", "b", "before"), ["e", "b"]).mapInPandas(_emit, "e string, b long, kind string, s long, t long")
    pieces = pieces.checkpoint()
    # an open period ends where the first gap of a later bucket begins, else where the entity ends
    firsts = pieces.where("kind = 'gap'").groupBy("e", "b").agg(F.min("s").alias("first_gap"))
    later = Window.partitionBy("e").orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    ends = before.join(firsts, ["e", "b"], "left").select("e", "b", F.coalesce(F.min("first_gap").over(later), F.col("top")).alias("close"))
    closed = pieces.join(ends, ["e", "b"]).withColumn("t", F.when(F.col("t") == LOW, F.col("close")).otherwise(F.col("t")))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    key = F.from_json("e", kinds)
    return closed.withColumn("key", key).select(*[F.col("key")[k].alias(k) for k in keys], "kind", F.col("s").alias("start_ms"), F.col("t").alias("end_ms"))
