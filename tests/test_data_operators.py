import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import intervals, orphans, tables

T = [datetime(2024, 1, d) for d in range(1, 29)]


def _refs(spark, jobs, notes, gone):
    c = F.col
    j = spark.createDataFrame(jobs, "id long, note long, at timestamp, made timestamp, key string, salt int")
    n = spark.createDataFrame(notes, "id long, made timestamp, key string")
    g = spark.createDataFrame(gone, "id long, at timestamp")
    return [orphans.Reference("jobs.note", j, c("note"), c("id"), c("at"), c("made"), n, c("id"), c("made"), g, c("id"), c("at"))]


def test_orphans_by_reason(spark):
    jobs = [(1, 10, T[5], T[1], "x", 1), (1, 10, T[5], T[1], "x", 1), (2, 11, T[5], T[1], None, None), (3, 12, T[5], T[1], "", 0), (4, 13, T[5], T[1], "x", 1), (5, None, T[5], T[1], "x", 1), (6, 14, None, T[1], "x", 1), (7, 15, T[5], None, "x", 1), (8, 16, T[9], T[9], "x", 1)]
    notes = [(10, T[9], "k"), (11, T[1], "k"), (12, T[1], "k"), (12, T[1], "k"), (14, T[9], "k"), (16, T[9], None)]
    rows = {(r["row_key"], r["reason"], r["period"]) for r in orphans.orphans(_refs(spark, jobs, notes, [(12, T[2]), (12, T[2]), (99, None)])).collect()}
    assert rows == {("1", "late", "2024-01"), ("3", "deleted", "2024-01"), ("4", "missing", "2024-01"), ("7", "missing", None)}


def test_orphans_of_empty_tables(spark):
    assert orphans.orphans(_refs(spark, [], [], [])).count() == 0
    assert orphans.orphans(_refs(spark, [(1, 10, T[5], T[1], "x", 1)], [], [])).first()["reason"] == "missing"
    assert orphans.orphan_report(orphans.orphans(_refs(spark, [], [(1, T[0], "k")], []))).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_ROWS", 50)
    jobs = [(i, 10 if i % 3 else i, T[5], T[1], "x", 1) for i in range(600)]
    found = orphans.orphans(_refs(spark, jobs, [(10, T[9], "k")], []), 4)
    got = {(r["row_key"], r["reason"]) for r in found.collect()}
    assert got == {(str(i), "late" if i % 3 else "missing") for i in range(600)}
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()


def brute(rows):
    by, out = {}, set()
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, spans in by.items():
        spans.sort()
        cur = list(spans[0])
        for s, t in spans[1:]:
            if s <= cur[1]:
                cur[1] = max(cur[1], t)
            else:
                out |= {(e, "period", *cur), (e, "gap", cur[1], s)}
                cur = [s, t]
        out.add((e, "period", *cur))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_intervals_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(r.choice([3, 60, 400])):
        s = r.randint(-50, 400)
        rows.append((r.choice(["a", "b", "", None]), s, s + r.choice([-3, 0, 1, 5, 5, 40, 300])))
    rows += rows[:5] + [("a", None, 4), ("a", 4, None)]
    df = spark.createDataFrame(rows, "s string, start long, t long").withColumn("kind", F.lit("clash"))
    for bucket in (10, 100_000):
        got = {(x["s"], x["kind"], x["start_ms"], x["end_ms"]) for x in intervals.periods_and_gaps(df, ["s"], F.col("start"), F.col("t"), bucket).collect()}
        assert got == brute(rows)


def test_intervals_nested_touching_and_long(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 2, 3), ("a", 30, 100_000), ("a", 31, 40), ("a", 200_000, 200_001)]
    got = intervals.periods_and_gaps(spark.createDataFrame(rows, "k string, x long, y long"), ["k"], F.col("x"), F.col("y"), 7)
    assert {(r["kind"], r["start_ms"], r["end_ms"]) for r in got.collect()} == {("period", 0, 20), ("gap", 20, 30), ("period", 30, 100_000), ("gap", 100_000, 200_000), ("period", 200_000, 200_001)}


def test_intervals_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k long, x long, y long")
    assert intervals.periods_and_gaps(df, ["k"], F.col("x"), F.col("y")).count() == 0


def test_salted_join_gives_what_a_join_gives(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i) for i in range(60)] + [(k, k) for k in range(2, 20)] + [(None, 5), (3, 99)], "k long, v long")
    other = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (40, "e"), (None, "f")], "k long, w string")
    want = sorted(map(tuple, rows.join(other, "k").collect()))
    for least in (20_000, 10, 1):
        monkeypatch.setattr(tables, "HOT_ROWS", least)
        got = tables.salted_join(rows, other, "k", ["v"])
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["k", "v", "w"]
    assert tables.salted_join(rows.limit(0), other, "k", ["v"]).count() == 0
