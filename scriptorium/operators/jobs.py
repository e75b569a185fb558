"""A queue of jobs with leases and retries, as pure functions of the table; the time is given, never taken.

Only what a queue needs as data processing is here: which leases ran out, which job comes next, changes of many rows at
once. Rules of one application (who may verify what, when a text may be published) are left out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import decode_confidence
from scriptorium.operators import tables
from scriptorium.operators.tables import number_rows

#: Seconds of a lease, attempts before a job is given up.
LEASE_S, MAX_ATTEMPTS = 120, 3


def set_fields(jobs: DataFrame, chosen: DataFrame, **values) -> DataFrame:
    """Fields of the chosen jobs (job_id) take new values."""
    flag = chosen.select("job_id").distinct().withColumn("__chosen", F.lit(True))
    joined = jobs.join(flag, "job_id", "left")
    changed = {k: F.when(F.col("__chosen"), v if hasattr(v, "_jc") else F.lit(v).cast(jobs.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()}
    return joined.withColumns(changed).select(*jobs.columns)


def reclaim_stale(jobs: DataFrame, as_of: datetime, lease_s: int = LEASE_S) -> DataFrame:
    """Jobs whose lease ran out go back to the queue, or are given up after MAX_ATTEMPTS; null leases never run out."""
    stale = (F.col("state") == "EXTRACTING") & (F.col("claimed_at") <= F.lit(as_of) - F.make_dt_interval(secs=F.lit(lease_s)))
    lost = stale & (F.col("attempts") >= MAX_ATTEMPTS)
    return jobs.withColumns(
        {
            "state": F.when(lost, "ERROR").when(stale, "UPLOADED").otherwise(F.col("state")),
            "last_error": F.when(lost, F.concat(F.lit("gave up after "), F.col("attempts").cast("string"), F.lit(" interrupted attempts"))).when(stale, F.lit(None)).otherwise(F.col("last_error")),
            "claimed_by": F.when(stale, F.lit(None)).otherwise(F.col("claimed_by")),
            "claimed_at": F.when(stale, F.lit(None)).otherwise(F.col("claimed_at")),
        }
    )


def claim(jobs: DataFrame, worker: str, as_of: datetime, most: int = 1) -> DataFrame:
    """The oldest waiting jobs, at most `most`, are leased to a worker; one writer at a time."""
    first = jobs.where("state = 'UPLOADED' AND claimed_at IS NULL").orderBy("created_at", "job_id").limit(most)
    return set_fields(jobs, first, state="EXTRACTING", claimed_by=worker, claimed_at=as_of, attempts=F.col("attempts") + 1)


def retry(jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Failed or doubtful jobs go back to the queue; attempts are kept."""
    ready = chosen.select("job_id").join(jobs.where(F.col("state").isin("ERROR", "NEEDS_REVIEW")).select("job_id"), "job_id", "left_semi")
    return set_fields(jobs, ready, state="UPLOADED", last_error=None, claimed_by=None, claimed_at=None)


def tick(jobs: DataFrame, worker: str, as_of: datetime, most: int = 10) -> DataFrame:
    """One round of a worker: leases that ran out are taken back, then the next jobs are leased."""
    return claim(reclaim_stale(jobs, as_of), worker, as_of, most)


def changed(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """job_id of rows in which any of the columns differs, nulls included."""
    b = before.select("job_id", *[F.col(x).alias(f"__{x}") for x in columns])
    differs = F.lit(False)
    for x in columns:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"__{x}"))
    return after.join(b, "job_id").where(differs).select("job_id")


def queue_places(jobs: DataFrame) -> DataFrame:
    """Place of each waiting job in the whole queue: numbered per day, plus the jobs of the days before."""
    waiting = jobs.where("state = 'UPLOADED' AND claimed_at IS NULL").withColumn("__day", F.to_date("created_at"))
    return number_rows(waiting, [], ["__day"], ["created_at", "job_id"], "place").drop("__day")


def store_results(jobs: DataFrame, extractions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and extractions after a round of readers. results: job_id, text, engine, confidence, error; a row a job.

    A job with an error keeps its extraction and gets state ERROR and the message. Else the extraction of the job is replaced;
    its confidence is the least of the reader's and of what the text's lost characters leave; marks of checks are reset.
    """
    c = F.col
    r = results.dropDuplicates(["job_id"])
    failed = r.where("error IS NOT NULL").select("job_id", c("error").alias("last_error"), F.lit("ERROR").alias("state"))
    good = r.where("error IS NULL").select("job_id", "text", "engine", F.least(F.coalesce("confidence", F.lit(1.0)), decode_confidence(c("text"))).alias("confidence"), F.lit(False).alias("verified"), F.lit(False).alias("edited"))
    return tables.update(jobs, failed, "job_id", ["last_error", "state"]), tables.update(extractions, good, "job_id", ["text", "engine", "confidence", "verified", "edited"])


def claim_order(jobs: DataFrame) -> DataFrame:
    """Place of each waiting job per day of arrival; days are small, the queue need not be."""
    waiting = jobs.where("state = 'UPLOADED' AND claimed_at IS NULL").withColumn("day", F.to_date("created_at"))
    return waiting.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("created_at", "job_id")).cast("long"))


def delete_jobs(gone: DataFrame, jobs: DataFrame, notes: DataFrame, documents: DataFrame, pages: DataFrame, spans: DataFrame, extractions: DataFrame) -> dict[str, DataFrame]:
    """The tables without the jobs of `gone` (job_id), and the paths that go with them.

    A job whose note was made and whose document is the source of a note goes alone. Else its document goes, and with it
    all its jobs, pages and spans; extractions go with their jobs. `paths` are those of the documents and page images that
    went, `free_paths` those of them that no document or page still has (uploads of the same bytes share a file).
    """
    c = F.col
    chosen = jobs.join(gone.select("job_id").distinct(), "job_id", "left_semi").where("doc_id IS NOT NULL").select("job_id", "doc_id", "note_id")
    sources = notes.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("source", F.lit(True))
    lost = chosen.join(sources, "doc_id", "left").where("note_id IS NULL OR source IS NULL").select("doc_id").distinct()
    left = {
        "jobs": jobs.join(chosen.select("job_id"), "job_id", "left_anti").join(lost, "doc_id", "left_anti"),
        "documents": documents.join(lost, "doc_id", "left_anti"), "pages": pages.join(lost, "doc_id", "left_anti"), "spans": spans.join(lost, "doc_id", "left_anti"),
    }
    gone_jobs = jobs.select("job_id").join(left["jobs"].select("job_id"), "job_id", "left_anti")
    left["extractions"] = extractions.join(gone_jobs, "job_id", "left_anti")

    def paths(d: DataFrame, p: DataFrame) -> DataFrame:
        return d.select(c("stored_path").alias("path")).unionByName(p.select(c("image_path").alias("path"))).where("path IS NOT NULL").distinct()

    left["paths"] = paths(documents.join(lost, "doc_id", "left_semi"), pages.join(lost, "doc_id", "left_semi"))
    left["free_paths"] = left["paths"].join(paths(left["documents"], left["pages"]), "path", "left_anti")
    return left
