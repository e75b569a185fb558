from datetime import datetime, timedelta

import pytest

from scriptorium.operators import jobs as J
from scriptorium.sources.store import Store
from scriptorium.streaming import ingest

NOW = datetime(2024, 1, 1, 12)
SCHEMA = "job_id long, state string, attempts long, last_error string, claimed_by string, claimed_at timestamp, created_at timestamp"


def row(k, state="UPLOADED", attempts=0, claimed=None, created=None):
    return (k, state, attempts, None, "w" if claimed else None, claimed, created or NOW - timedelta(hours=k))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def by_id(df):
    return {r["job_id"]: r for r in df.collect()}


def test_leases_run_out(spark):
    hour, fresh = NOW - timedelta(hours=1), NOW - timedelta(seconds=5)
    got = by_id(J.reclaim_stale(table(spark, row(1, "EXTRACTING", 1, hour), row(2, "EXTRACTING", 1, fresh), row(3, "EXTRACTING", 3, hour), row(4, "EXTRACTING", 1, None), row(5)), NOW))
    assert [got[k]["state"] for k in (1, 2, 3, 4, 5)] == ["UPLOADED", "EXTRACTING", "ERROR", "EXTRACTING", "UPLOADED"]
    assert "interrupted" in got[3]["last_error"] and got[1]["claimed_at"] is None


def test_oldest_first_and_only_once(spark):
    jobs = table(spark, row(1), row(2), row(3, created=NOW - timedelta(hours=2)))
    once = J.claim(jobs, "a", NOW)
    assert by_id(once)[2]["claimed_by"] == "a" and by_id(once)[2]["attempts"] == 1
    twice = by_id(J.claim(once, "b", NOW))
    assert twice[2]["claimed_by"] == "a" and twice[3]["claimed_by"] == "b"
    assert by_id(J.claim(jobs.limit(0), "a", NOW)) == {}


def test_retry_keeps_attempts(spark):
    jobs = table(spark, row(1, "ERROR", 3), row(2, "DONE", 1))
    got = by_id(J.retry(jobs, jobs))
    assert got[1]["state"] == "UPLOADED" and got[1]["attempts"] == 3 and got[2]["state"] == "DONE"


def test_round_without_work_changes_nothing(spark):
    jobs = table(spark, row(1, "DONE"), row(2, "EXTRACTING", 1, NOW))
    assert J.changed(jobs, J.tick(jobs, "a", NOW), ["state", "attempts", "claimed_by"]).count() == 0


def test_store_swaps_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read("t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert store.commit({"t": df}, {"t": ["k"]}, {"t": ["v"]}) == {"t": 1}
    assert store.commit({"t": store.read("t").where("k = 1")}) == {"t": 2}
    assert store.read("t").count() == 1 and store.read("t", 1).count() == 2


def test_arrivals_are_added_once(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    table(spark, row(1), row(2)).write.parquet(f"{folder}/a")
    table(spark, row(2), row(3)).write.parquet(f"{folder}/b")
    for _ in range(2):
        stream = ingest.arrivals(spark, f"{folder}/*", SCHEMA, 1)
        ingest.enqueue(stream, store, str(tmp_path / "cp"), "w", lambda: NOW).awaitTermination(120)
    got = by_id(store.read("jobs"))
    assert set(got) == {1, 2, 3} and all(r["state"] == "EXTRACTING" and r["attempts"] == 1 for r in got.values())


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batch = ingest.enqueue_batch(store, "s", "w", lambda: NOW)
    waiting = table(spark, *[row(k) for k in range(1, 16)])
    batch(waiting, 0)
    once = {k: r["attempts"] for k, r in by_id(store.read("jobs")).items()}
    assert sorted(once.values()) == [0] * 5 + [1] * 10
    batch(waiting, 0)
    assert {k: r["attempts"] for k, r in by_id(store.read("jobs")).items()} == once and store.version("jobs") == 1
    batch(table(spark, row(1), row(20)), 1)
    assert sum(r["attempts"] for r in by_id(store.read("jobs")).values()) == 16 and store.mark("s") == 1
    assert store.read("jobs", 2).count() == 6  # the new job and the leases, not the whole table


def test_a_crash_between_the_steps_leaves_the_state_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    store.commit({"t": df, "u": df}, marks={"m": 4})
    df.limit(1).write.parquet(str(tmp_path / "store/t/v000002"))  # data without a manifest
    assert store.read("t").count() == 2
    (tmp_path / "store/_commits/00000002").write_bytes(b"\x00\x40{")  # a manifest that is cut short
    assert store.read("t").count() == 2 and store.version("t") == 1 and store.mark("m") == 4
    assert store.commit({"t": df.limit(1)}) == {"t": 3}
    assert store.read("t").count() == 1 and store.read("u").count() == 2


def test_changes_on_top_of_a_snapshot(spark, tmp_path, monkeypatch):
    from scriptorium.sources import store as S

    monkeypatch.setattr(S, "MOST_CHANGES", 2)
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"t": spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")})
    for n, v in enumerate("cde"):
        store.append("t", spark.createDataFrame([(2, v), (10 + n, v)], "k long, v string"), "k")
        assert {r["k"]: r["v"] for r in store.read("t").collect()}[2] == v
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == {1: "a", 2: "e", 10: "c", 11: "d", 12: "e"}
    assert store.version("t") == 5


def test_windows_with_watermark(spark, tmp_path):
    rows = [(NOW, "a"), (NOW + timedelta(hours=1), "a"), (NOW + timedelta(days=5), "b")]
    spark.createDataFrame(rows, "t timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ingest.counts_by_window(ingest.arrivals(spark, str(tmp_path / "e"), "t timestamp, k string"), "t", "k")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["n"]) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_deleted_jobs_take_their_documents_along(spark):
    from scriptorium.operators import jobs

    make = spark.createDataFrame
    left = jobs.delete_jobs(
        make([(1,), (2,), (3,)], "job_id long"), make([(1, 10, None), (2, 20, 7), (3, 30, 8), (4, 10, None), (5, 40, None)], "job_id long, doc_id long, note_id long"), make([(7, 20), (9, 10)], "note_id long, doc_id long"), make([(10, "a"), (20, "b"), (30, "c"), (40, "a")], "doc_id long, stored_path string"),
        make([(100, 10, "p"), (200, 20, "q")], "page_id long, doc_id long, image_path string"), make([(1, 10), (2, 20), (3, 30)], "span_id long, doc_id long"), make([(1, 1), (2, 2), (4, 4), (5, 5)], "extraction_id long, job_id long"),
    )
    got = {t: {r[k] for r in left[t].collect()} for t, k in {"jobs": "job_id", "documents": "doc_id", "pages": "page_id", "spans": "span_id", "extractions": "job_id", "paths": "path", "free_paths": "path"}.items()}
    assert got == {"jobs": {5}, "documents": {20, 40}, "pages": {200}, "spans": {2}, "extractions": {5}, "paths": {"a", "c", "p"}, "free_paths": {"c", "p"}}
