"""Queries of what comes in and how tables change: files, readings, settings, queue; one entry per operator, with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import corpus as C
from scriptorium.operators import extraction as X
from scriptorium.operators import jobs as J
from scriptorium.operators import references as R
from scriptorium.operators import tables as M
from scriptorium.plans.study import ACTIVE
from scriptorium.plans.study_queries import _AS_OF, _RE, _RECLAIMED, _STAMP, _TURNS, _as_of, _claimed, _turns, c, query
from scriptorium.session import scratch
from scriptorium.sources import files
from scriptorium.sources.store import Store
from scriptorium.streaming import ingest

#: White space as texts are stripped by, for SQL.
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f]+"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}', ''), '{_SPACE}$', '')"


# ------------------------------------------------------------------ files


@query(f"SELECT doc_id, nullif({_strip('text')}, '') AS text, CASE WHEN {_strip('text')} <> '' THEN CAST(1.0 AS DOUBLE) END AS confidence, CASE WHEN {_strip('text')} = '' THEN 'docx without text' END AS error FROM d WHERE format = 'docx' AND text IS NOT NULL", "d")
def src_docx(s):
    """Word-processing files, written below the checkpoint folder and read back by the reader of such files."""
    folder = scratch(s.spark)
    files.stage(s.documents.where("format = 'docx' AND text IS NOT NULL"), folder, "doc_id", "text", files.docx_bytes).agg(F.sum("bytes")).collect()
    read = files.read_docx(s.spark, folder)
    return read.select(F.regexp_extract("path", "[^/]+$", 0).cast("long").alias("doc_id"), "text", "confidence", "error")


@query("SELECT page_id, CAST(octet_length(encode(image_path)) AS BIGINT) AS size, sha256(image_path) AS digest FROM pg", "pg")
def src_page_bytes(s):
    """Bytes of page images by page id: files (here with the path as content) are scanned once and joined."""
    folder = scratch(s.spark)
    files.stage(s.pages, folder, "page_id", "image_path", lambda x: x.encode()).agg(F.sum("bytes")).collect()
    got = files.read_bytes(s.spark, folder, s.pages.select("page_id", c("page_id").cast("string").alias("name")), "name")
    return got.select("page_id", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


@query("SELECT translation_id, book_osis, chapter, verse, coalesce(" + _strip("text") + ", '') AS text FROM v", "v")
def json_book(s):
    """Book payloads written as JSON, a line each, and read back; numbers stand as strings for every other translation."""
    number = lambda x: F.when(c("translation_id") % 2 == 0, F.concat(F.lit('"'), c(x), F.lit('"'))).otherwise(c(x).cast("string"))
    verse = F.concat(F.lit('{"verse":'), number("verse"), F.lit(',"text":'), F.coalesce(F.get_json_object(F.to_json(F.struct(F.array("text").alias("a"))), "$.a"), F.lit("[null]")), F.lit("}"))
    verse = F.replace(F.replace(verse, F.lit('"text":['), F.lit('"text":')), F.lit("]}"), F.lit("}"))
    chapters = s.verses.groupBy("translation_id", "book_osis", "chapter").agg(F.array_join(F.collect_list(verse), ",").alias("vs"))
    chapters = chapters.select("translation_id", "book_osis", F.concat(F.lit('{"chapter":'), number("chapter"), F.lit(',"verses":['), "vs", F.lit("]}")).alias("ch"))
    book = chapters.groupBy("translation_id", "book_osis").agg(F.array_join(F.collect_list("ch"), ",").alias("chs"))
    line = F.concat(F.lit('{"translation_id":'), "translation_id", F.lit(',"book_osis":"'), "book_osis", F.lit('","chapters":['), "chs", F.lit("]}"))
    folder = scratch(s.spark)
    book.select(line.alias("value")).write.text(folder)
    return files.read_book_lines(s.spark, folder, "translation_id long, book_osis string")


@query("SELECT abbrev AS key, name AS value FROM t WHERE abbrev <> (SELECT min(abbrev) FROM t)", "t")
def src_settings_env(s):
    """Settings written as a .env file with comments, blank lines, quotes and `export`, and read back; one key is refused."""
    refused = s.translations.agg(F.min("abbrev")).first()[0]
    quoted = F.when(c("id") % 3 == 0, F.concat(F.lit('"'), "name", F.lit('"'))).when(c("id") % 3 == 1, F.concat(F.lit("'"), "name", F.lit("'"))).otherwise(c("name"))
    lines = s.translations.select(F.explode(F.array(F.lit("# a comment = none"), F.lit("   "), F.concat(F.when(c("id") % 2 == 0, "export ").otherwise("  "), "abbrev", F.lit("= "), quoted))).alias("value"))
    folder = scratch(s.spark)
    lines.write.text(folder)
    return files.settings(s.spark.read.text(folder), "value", (refused,)).select("key", "value")


_PAGES = "p AS (SELECT pg.doc_id, pg.page_no, x.text FROM pg LEFT JOIN (SELECT page_id, string_agg(text, chr(10) ORDER BY idx, span_id) AS text FROM sp WHERE page_id IS NOT NULL GROUP BY page_id) x USING (page_id))"
_LAYER = f"WITH {_PAGES}, l AS (SELECT doc_id, string_agg(nullif({_strip('text')}, ''), chr(10) || chr(10) ORDER BY page_no) AS text, count(*) AS n FROM p GROUP BY doc_id)"


@query(_LAYER + " SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL WHEN length(text) / n >= 200 THEN 1.0 ELSE greatest(0.3, length(text) / n / 200) END AS confidence, CASE WHEN text IS NULL THEN 'no text layer' END AS error FROM l", "pg", "sp")
def src_pdf_text(s):
    """Text layers of documents by their pages; the pages of a PDF come from a reader, here their lines are those of the spans."""
    lines = s.some("spans", "page_id IS NOT NULL").groupBy("page_id").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY idx, span_id)").alias("text"))
    return X.text_layer(s.pages.select("page_id", "doc_id", "page_no").join(lines, "page_id", "left"))


@query("SELECT s.span_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY p.page_no, s.idx, s.span_id) - 1 AS BIGINT) AS position, min(coalesce(s.confidence, 0.0)) OVER (PARTITION BY s.doc_id) AS confidence FROM sp s JOIN pg p ON p.page_id = s.page_id WHERE trim(s.text) <> ''", "sp", "pg")
def src_ocr_pdf(s):
    """Recognised lines of scanned pages, blank ones left out, numbered across pages, with the least confidence of all pages."""
    lines = s.some("spans", "trim(text) <> ''").join(s.pages.select("page_id", "page_no"), "page_id")
    least = lines.groupBy("doc_id").agg(X.scan_confidence().alias("least"))
    return X.renumber(lines).join(least, "doc_id").select("span_id", "position", c("least").alias("confidence"))


def _words(table: str) -> str:
    return f"w AS (SELECT translation_id, verse_id, regexp_extract_all(text, '{_RE}') AS toks, regexp_split_to_array(text, '{_RE}') AS gaps FROM {table} WHERE text IS NOT NULL), e AS (SELECT translation_id, verse_id, toks, gaps, unnest(range(len(toks))) AS idx FROM w)"


_OFFSET = "CAST(sum(length(gaps[idx + 1]) + length(toks[idx + 1])) OVER (PARTITION BY translation_id, verse_id ORDER BY idx ROWS UNBOUNDED PRECEDING) {} AS BIGINT)"


@query(f"WITH {_words("v")} SELECT translation_id, verse_id, idx, {_OFFSET.format('- length(toks[idx + 1])')} AS char_start, {_OFFSET.format('')} AS char_end FROM e", "v")
def win_token_idx_offsets(s):
    return C.word_offsets(s.verses)


@query(
    f"""WITH src AS (SELECT DISTINCT ON (made) book_osis || '.' || chapter || '.' || verse AS made, book_osis, chapter, verse, coalesce({_strip('text')}, '') AS text FROM v WHERE translation_id = 2),
    nv AS (SELECT 1 AS translation_id, made AS verse_id, text, CAST(row_number() OVER (ORDER BY b.canonical_order, chapter, verse, made) AS BIGINT) AS canonical_order FROM src JOIN books b ON b.osis = book_osis),
    {_words("nv")}, nt AS (SELECT verse_id, idx, toks[idx + 1] AS surface FROM e)
    SELECT 'verses' AS tbl, translation_id, verse_id, CAST(NULL AS BIGINT) AS idx, text, canonical_order FROM v WHERE translation_id <> 1 UNION ALL SELECT 'verses', translation_id, verse_id, NULL, text, canonical_order FROM nv
    UNION ALL SELECT 'tokens', translation_id, verse_id, idx, surface, NULL FROM tok WHERE translation_id <> 1 UNION ALL SELECT 'tokens', 1, verse_id, idx, surface, NULL FROM nt""",
    "v", "tok", "books",
)
def snk_import_pack(s):
    """The verses of translation 2 are imported as translation 1: verses with their order, and their tokens."""
    pack = s.some("verses", "translation_id = 2").select("book_osis", "chapter", "verse", "text")
    verses, tokens = C.import_pack(s.verses, s.tokens, s.books, pack, ACTIVE)
    none = F.lit(None)
    v = verses.select(F.lit("verses").alias("tbl"), "translation_id", "verse_id", none.cast("long").alias("idx"), "text", "canonical_order")
    return v.unionByName(tokens.select(F.lit("tokens").alias("tbl"), "translation_id", "verse_id", "idx", c("surface").alias("text"), none.cast("long").alias("canonical_order")))


# ------------------------------------------------------------------ readings


_EXCLUSIVE = "ex AS (SELECT doc_id, who, ts, least(te, ts + 30) AS te FROM tn WHERE doc_id % 2 = 0 AND turn_no % 2 = 1)"


@query(f"WITH {_TURNS}, {_EXCLUSIVE} SELECT doc_id, who, ts AS turn_start, te AS turn_end FROM ex UNION ALL SELECT doc_id, who, ts, te FROM tn WHERE doc_id NOT IN (SELECT doc_id FROM ex)", "sp")
def src_diarization_turns(s):
    """Turns per recording; recordings that have exclusive turns (here the even ones) use those alone."""
    turns = _turns(s).select("doc_id", c("turn_speaker").alias("who"), "turn_start", "turn_end", "turn_no")
    exclusive = turns.where("doc_id % 2 = 0 AND turn_no % 2 = 1").withColumn("turn_end", F.least("turn_end", c("turn_start") + 30))
    return X.preferred_turns(turns, exclusive, "doc_id").select("doc_id", "who", "turn_start", "turn_end")


_READ = "m AS (SELECT doc_id, span_id, idx, doc_id % 7 <> 0 AND idx % 3 <> 0 AND trim('+ ' || text) <> '' AS read, CASE WHEN doc_id % 7 <> 0 AND idx % 3 <> 0 THEN '+ ' || text ELSE text END AS text FROM sp WHERE page_id IS NOT NULL)"


def _second_readings(s):
    """Lines of scans with their second readings: every third line, and every line of some documents, is left blank."""
    spans = s.some("spans", "page_id IS NOT NULL").select("span_id", "doc_id", "idx", "text", "confidence")
    readings = spans.select("span_id", F.when((c("doc_id") % 7 != 0) & (c("idx") % 3 != 0), F.concat(F.lit("+ "), "text")).otherwise(" ").alias("reading"))
    return X.merge_readings(spans, readings, ["span_id"])


@query(f"WITH {_READ} SELECT span_id, text, CASE WHEN read THEN NULL ELSE CAST(0.0 AS DOUBLE) END AS confidence FROM m", "sp")
def rec_cloud_merge(s):
    return _second_readings(s).select("span_id", "text", "confidence")


@query(f"WITH {_READ} SELECT doc_id, CASE WHEN bool_or(read) THEN string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) ORDER BY idx, span_id) END AS text, CASE WHEN bool_or(read) THEN 'scan+second' END AS engine, CASE WHEN NOT bool_or(read) THEN 'no line was read' END AS error FROM m GROUP BY doc_id", "sp")
def rec_cloud_text(s):
    """Texts and engines after second readings; documents without any line read have an error."""
    return X.second_reading(_second_readings(s), F.lit("scan"))


_AGAIN = "ag AS (SELECT DISTINCT doc_id FROM j WHERE state = 'ERROR'), np AS (SELECT (SELECT max(page_id) FROM pages) + row_number() OVER (ORDER BY doc_id, page_no) AS page_id, doc_id, page_no FROM (SELECT DISTINCT doc_id, page_no FROM pg WHERE doc_id IN (SELECT doc_id FROM ag)))"


@query(
    f"""WITH {_AGAIN}, ns AS (SELECT s.doc_id, n.page_id, s.idx, s.span_id AS was, 'again: ' || s.text AS text FROM sp s LEFT JOIN pg ON pg.page_id = s.page_id AND pg.doc_id = s.doc_id LEFT JOIN np n ON n.doc_id = s.doc_id AND n.page_no = pg.page_no WHERE s.doc_id IN (SELECT doc_id FROM ag))
    SELECT 'pages' AS tbl, page_id AS id, doc_id, page_no AS place, CAST(NULL AS VARCHAR) AS text FROM pg WHERE doc_id NOT IN (SELECT doc_id FROM ag) UNION ALL SELECT 'pages', page_id, doc_id, page_no, NULL FROM np
    UNION ALL SELECT 'spans', page_id, doc_id, idx, text FROM sp WHERE doc_id NOT IN (SELECT doc_id FROM ag) UNION ALL SELECT 'spans', page_id, doc_id, idx, text FROM ns""",
    "j", "pg", "sp",
)
def mut_store_extraction(s):
    """Documents of failed jobs are read again: their pages and spans are replaced, spans point to the new ids of their pages."""
    again = s.some("jobs", "state = 'ERROR'").select("doc_id").distinct()
    pages, spans = s.pages.select("page_id", "doc_id", "page_no"), s.spans.select("span_id", "doc_id", "page_id", "idx", "text")
    new_pages = pages.join(again, "doc_id", "left_semi").select("doc_id", "page_no").distinct()
    new_spans = spans.join(again, "doc_id", "left_semi").join(pages, ["doc_id", "page_id"], "left").select("doc_id", "page_no", "idx", F.concat(F.lit("again: "), "text").alias("text"))
    left_pages, left_spans = X.store_reading(pages, spans, new_pages, new_spans)
    out = left_pages.select(F.lit("pages").alias("tbl"), c("page_id").alias("id"), "doc_id", c("page_no").alias("place"), F.lit(None).cast("string").alias("text"))
    return out.unionByName(left_spans.select(F.lit("spans").alias("tbl"), c("page_id").alias("id"), "doc_id", c("idx").alias("place"), "text"))


_DECODED = "CASE WHEN length(text) = 0 THEN 0.0 ELSE greatest(0, 1 - 10 * (length(text) - length(replace(text, '�', ''))) / length(text)) END"


@query(
    f"""WITH r AS (SELECT job_id, text, confidence, job_id % 5 = 0 AS failed FROM x WHERE text IS NOT NULL AND job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY extraction_id) = 1)
    SELECT 'jobs' AS tbl, j.job_id AS id, CASE WHEN r.failed THEN 'ERROR' ELSE j.state END AS state, CASE WHEN r.failed THEN 'could not be read' ELSE j.last_error END AS note, CAST(NULL AS DOUBLE) AS confidence FROM j LEFT JOIN r USING (job_id)
    UNION ALL SELECT 'extractions', x.extraction_id, NULL, CASE WHEN r.failed = false THEN 'reader' ELSE x.engine END, CASE WHEN r.failed = false THEN least(coalesce(r.confidence, 1.0), {_DECODED.replace('text', 'r.text')}) ELSE x.confidence END FROM x LEFT JOIN r USING (job_id)""",
    "j", "x",
)
def mut_extract(s):
    """Results of a round of readers (here the stored texts; every fifth job fails) go into jobs and extractions."""
    first = s.some("extractions", "text IS NOT NULL AND job_id IS NOT NULL").groupBy("job_id").agg(F.min_by(F.struct("text", "confidence"), "extraction_id").alias("r"))
    failed = c("job_id") % 5 == 0
    results = first.select("job_id", "r.text", F.lit("reader").alias("engine"), "r.confidence", F.when(failed, "could not be read").alias("error"))
    jobs, extractions = J.store_results(s.jobs, s.extractions, results)
    none = F.lit(None)
    out = jobs.select(F.lit("jobs").alias("tbl"), c("job_id").alias("id"), "state", c("last_error").alias("note"), none.cast("double").alias("confidence"))
    return out.unionByName(extractions.select(F.lit("extractions").alias("tbl"), c("extraction_id").alias("id"), none.cast("string").alias("state"), c("engine").alias("note"), "confidence"))


# ------------------------------------------------------------------ references, queue, settings, time


@query("SELECT typed, (SELECT CASE WHEN count(DISTINCT osis) = 1 THEN min(osis) END FROM books b WHERE starts_with(lower(b.osis), q) OR starts_with(lower(b.name), q)) AS osis FROM (SELECT DISTINCT typed, lower(trim(replace(typed, '.', ''))) AS q FROM (SELECT unnest([osis, ' ' || upper(osis) || '. ', name, left(osis, 2), left(name, 9), 'zz' || osis]) AS typed FROM books)) WHERE q NOT IN (SELECT lower(osis) FROM books) AND q NOT IN (SELECT lower(name) FROM books) UNION ALL SELECT typed, osis FROM (SELECT DISTINCT typed, lower(trim(replace(typed, '.', ''))) AS q FROM (SELECT unnest([osis, ' ' || upper(osis) || '. ', name, left(osis, 2), left(name, 9), 'zz' || osis]) AS typed FROM books)) JOIN (SELECT lower(osis) AS q, osis FROM books UNION SELECT lower(name), osis FROM books) USING (q)", "books")
def join_reference_book(s):
    """Codes, names and beginnings of both, as typed: found exactly, else by a beginning that one book alone has."""
    typed = s.books.select(F.explode(F.array("osis", F.concat(F.lit(" "), F.upper("osis"), F.lit(". ")), "name", F.left("osis", F.lit(2)), F.left("name", F.lit(9)), F.concat(F.lit("zz"), "osis"))).alias("typed")).distinct()
    return R.match_books(typed, "typed", s.books).select("typed", "osis")


@query("SELECT job_id, CAST(row_number() OVER (ORDER BY created_at, job_id) AS BIGINT) AS place FROM j WHERE state = 'UPLOADED' AND claimed_at IS NULL", "j")
def win_claim_rank(s):
    """Places of all waiting jobs; the first is claimed next."""
    return J.queue_places(s.jobs).select("job_id", c("place").cast("long").alias("place"))


_SET = "SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS at FROM events WHERE {} GROUP BY user_id"


def _settings(s, which):
    """A setting per user: the last event of its kind."""
    e = s.events.where(which)
    return e.select(F.concat(F.lit("user:"), "user_id").alias("key"), c("event_type").alias("value"), c("event_id").alias("at"))


@query(f"WITH o AS ({_SET.format('event_id % 3 <> 0')}), n AS ({_SET.format('event_id % 3 = 0')}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM n)")
def set_upsert_setting(s):
    """The last writer of a setting wins, over the stored value too."""
    old = _settings(s, "event_id % 3 <> 0").groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return M.upsert_latest(old, _settings(s, "event_id % 3 = 0"), "key", ["at"])


@query(f"WITH o AS ({_SET.format('true')}), k AS (SELECT 'user:' || max(user_id) AS key FROM events UNION ALL SELECT 'absent') SELECT k.key, o.value FROM k LEFT JOIN o USING (key)")
def kv_get_setting(s):
    """Values of two keys; one that isn't there has none."""
    last = s.events.agg(F.max("user_id")).first()[0]
    rows = _settings(s, c("user_id") == last).groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return s.spark.createDataFrame([(f"user:{last}",), ("absent",)], "key string").join(rows, "key", "left")


_BEAT = f"hb AS (SELECT 'worker_heartbeat:' || claimed_by AS key, {_STAMP.format('max(claimed_at)')} AS value FROM j WHERE claimed_by IS NOT NULL AND claimed_at IS NOT NULL GROUP BY claimed_by), en AS (SELECT 'worker_engines:' || claimed_by AS key, '[' || string_agg(DISTINCT '\"' || engine_used || '\"', ',' ORDER BY '\"' || engine_used || '\"') || ']' AS value FROM j WHERE claimed_by IS NOT NULL AND engine_used IS NOT NULL GROUP BY claimed_by), un AS (SELECT 'worker_heartbeat:' || w AS key, 'none yet' AS value FROM (SELECT DISTINCT claimed_by AS w FROM j WHERE claimed_by IS NOT NULL) UNION ALL SELECT 'worker_heartbeat:idle', 'none yet')"


def _beats(s):
    """Settings after every worker reported: its last time of work and the engines it used."""
    own = s.some("jobs", "claimed_by IS NOT NULL")
    old = own.select(F.concat(F.lit("worker_heartbeat:"), "claimed_by").alias("key")).distinct().unionByName(s.spark.createDataFrame([("worker_heartbeat:idle",)], "key string")).withColumn("value", F.lit("none yet"))
    beats = own.where("claimed_at IS NOT NULL").groupBy("claimed_by").agg(F.max("claimed_at").alias("t")).select(F.concat(F.lit("worker_heartbeat:"), "claimed_by").alias("key"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("value"))
    engines = own.where("engine_used IS NOT NULL").groupBy("claimed_by").agg(F.to_json(F.sort_array(F.collect_set("engine_used"))).alias("value")).select(F.concat(F.lit("worker_engines:"), "claimed_by").alias("key"), "value")
    return M.upsert(M.upsert(old, beats, ["key"]), engines, ["key"])


@query(f"WITH {_BEAT} SELECT key, value FROM hb UNION ALL SELECT key, value FROM en UNION ALL SELECT key, value FROM un WHERE key NOT IN (SELECT key FROM hb)", "j")
def op_heartbeat(s):
    return _beats(s)


@query(f"WITH {_BEAT}, al AS (SELECT * FROM hb UNION ALL SELECT * FROM un WHERE key NOT IN (SELECT key FROM hb)) SELECT split_part(al.key, ':', 2) AS worker, al.value AS heartbeat, CAST(coalesce(len(string_split(en.value, '\",\"')), 0) AS BIGINT) AS engines FROM al LEFT JOIN en ON split_part(en.key, ':', 2) = split_part(al.key, ':', 2)", "j")
def op_worker_status(s):
    """The settings of each worker as one row; whether its process lives is not a matter of data."""
    name, kind = F.substring_index("key", ":", -1), F.substring_index("key", ":", 1)
    one = _beats(s).groupBy(name.alias("worker")).agg(F.max(F.when(kind == "worker_heartbeat", c("value"))).alias("heartbeat"), F.max(F.when(kind == "worker_engines", c("value"))).alias("e"))
    return one.select("worker", "heartbeat", F.coalesce(F.size(F.from_json("e", "array<string>")), F.lit(0)).cast("long").alias("engines"))


@query(f"SELECT job_id, CASE WHEN claimed_at IS NULL THEN {_STAMP.format(_AS_OF)} ELSE {_STAMP.format('updated_at')} END AS updated_at FROM j", "j")
def dt_now(s):
    """The time is given, never taken from the clock: rows that are touched get it as text to the second."""
    now = F.date_format(F.lit(_as_of(s)), "yyyy-MM-dd HH:mm:ss")
    return s.jobs.select("job_id", F.when(c("claimed_at").isNull(), now).otherwise(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")).alias("updated_at"))


# ------------------------------------------------------------------ streams


def _arriving(s, name: str):
    """A table as a stream of its files; the schema is that of the table, nothing is inferred while it runs."""
    return ingest.arrivals(s.spark, f"{s.folder}/{name}*.parquet", s.table(name).schema)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(s):
    """Events as they arrive, counted per day and type; the counts so far are written after every batch."""
    folder = scratch(s.spark)
    counts = ingest.counts_by_window(_arriving(s, "events").withColumn("ts", c("ts").cast("timestamp")), "ts", "event_type")
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.parquet(f"{folder}/counts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(_claimed(_RECLAIMED), "j")
def stream_enqueue(s):
    """Jobs as they arrive go into the queue of a store, each once, and the worker makes its round."""
    folder, now = scratch(s.spark), _as_of(s)
    store = Store(s.spark, f"{folder}/store")
    ingest.enqueue(_arriving(s, "jobs"), store, f"{folder}/stream", "w", lambda: now).awaitTermination()
    return store.read("jobs").select("job_id", "state", "claimed_by", "attempts")
