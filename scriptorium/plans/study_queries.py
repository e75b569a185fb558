"""Queries of the study operators with their SQL: one entry per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import annotations as A
from scriptorium.operators import corpus as C
from scriptorium.operators import extraction as X
from scriptorium.operators import jobs as J
from scriptorium.operators import references as R
from scriptorium.operators import tables as M
from scriptorium.plans.study import ACTIVE, Study, sql

c = F.col
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(select: str | None = None, *names: str):
    """Registers a function of the study tables with its SQL."""

    def add(f: Callable[[Study], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, folder: f(Study(spark, folder))
        if select is not None:
            _SQL[f.__name__] = sql(select, *names)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_BOOK = "(SELECT max(book_osis) FROM verses)"
_RE = T.WORD.replace("'", "''")
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# ------------------------------------------------------------------ sources and sinks


@query("SELECT osis, canonical_order, name, testament FROM books", "books")
def src_books_const(s):
    return s.books


@query("SELECT abbrev, name, language, license, source_type, versification FROM t", "t")
def src_registry(s):
    """The registry as JSON text, read back by an explicit schema."""
    packed = s.translations.select(F.to_json(F.struct("abbrev", "name", "language", "license", "source_type", "versification")).alias("j"))
    fields = "abbrev string, name string, language string, license string, source_type string, versification string"
    return packed.select(F.from_json("j", fields).alias("p")).select("p.*")


_BOOK_JSON = "SELECT translation_id, book_osis, chapter, verse, coalesce(regexp_replace(regexp_replace(text, '^[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+', ''), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]+$', ''), '') AS text FROM v"


@query(_BOOK_JSON, "v")
def src_book_json(s):
    """Nested payload of each book and back: numbers may be strings, texts are trimmed, a missing text is empty."""
    payload = s.verses.groupBy("translation_id", "book_osis", "chapter").agg(F.collect_list(F.struct(c("verse").cast("string").alias("verse"), "text")).alias("verses"))
    book = payload.groupBy("translation_id", "book_osis").agg(F.to_json(F.struct(F.collect_list(F.struct(c("chapter").cast("string").alias("chapter"), "verses")).alias("chapters"))).alias("j"))
    schema = "chapters array<struct<chapter: string, verses: array<struct<verse: string, text: string>>>>"
    chapters = book.select("translation_id", "book_osis", F.explode(F.from_json("j", schema)["chapters"]).alias("ch"))
    each = chapters.select("translation_id", "book_osis", c("ch.chapter").alias("chapter"), F.explode("ch.verses").alias("ve"))
    return each.select("translation_id", "book_osis", c("chapter").try_cast("long").alias("chapter"), c("ve.verse").try_cast("long").alias("verse"), F.coalesce(T.strip_space(c("ve.text")), F.lit("")).alias("text"))


@query("SELECT doc_id, 'text/utf-8' AS engine, CAST(1.0 AS DOUBLE) AS confidence, text FROM d WHERE text IS NOT NULL", "d")
def src_plain_text(s):
    """Bytes to text: strict UTF-8, else Latin-1 at a lower confidence."""
    from scriptorium.sources.files import decode_plain

    return decode_plain(s.documents.where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "engine", "confidence", "text")


@query("SELECT doc_id, idx, trim(text) AS text, confidence, start_s, end_s FROM sp WHERE start_s IS NOT NULL AND trim(text) <> ''", "sp")
def src_asr(s):
    """Segments as spans: blank ones are left out, idx keeps its holes."""
    return s.some("spans", "start_s IS NOT NULL AND trim(text) <> ''").select("doc_id", "idx", F.trim("text").alias("text"), "confidence", "start_s", "end_s")


@query(f"SELECT translation_id, verse_id, CAST(count(*) OVER (PARTITION BY translation_id ORDER BY b.canonical_order, chapter, verse, verse_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM v JOIN books b ON b.osis = book_osis", "v", "books")
def win_canonical_order(s):
    return C.canonical_order(s.verses, s.books).select("translation_id", "verse_id", c("running").cast("long").alias("running"))


@query(
    f"""WITH w AS (SELECT translation_id, verse_id, regexp_extract_all(text, '{_RE}') AS toks, regexp_split_to_array(text, '{_RE}') AS gaps FROM v WHERE text IS NOT NULL),
    e AS (SELECT translation_id, verse_id, toks, gaps, unnest(range(len(toks))) AS idx FROM w)
    SELECT translation_id, verse_id, idx, toks[idx + 1] AS surface, CAST(sum(length(gaps[idx + 1]) + length(toks[idx + 1])) OVER p - length(toks[idx + 1]) AS BIGINT) AS char_start, CAST(sum(length(gaps[idx + 1]) + length(toks[idx + 1])) OVER p AS BIGINT) AS char_end
    FROM e WINDOW p AS (PARTITION BY translation_id, verse_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
    "v",
)
def str_tokenize(s):
    return T.tokens(s.verses, ["translation_id", "verse_id"], "text")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_RE}')) AS BIGINT) AS tokens, CAST(len(regexp_split_to_array(text, '{_RE}')) AS BIGINT) AS gaps FROM d WHERE text IS NOT NULL", "d")
def str_tokenize_documents(s):
    return s.documents.where("text IS NOT NULL").select("doc_id", F.size(T.words(c("text"))).cast("long").alias("tokens"), F.size(T.gaps(c("text"))).cast("long").alias("gaps"))


@query("SELECT translation_id, verse_id, text FROM v WHERE text IS NOT NULL", "v")
def str_gap_interleave(s):
    """Gaps and words in turn, joined again: nothing is lost."""
    return s.some("verses", "text IS NOT NULL").select("translation_id", "verse_id", F.array_join(T.interleaved(c("text")), "").alias("text"))


@query("SELECT translation_id, book_osis, count(*) AS verses, CAST(sum(count(*)) OVER (PARTITION BY translation_id ORDER BY b.canonical_order) AS BIGINT) AS so_far FROM v JOIN books b ON b.osis = book_osis GROUP BY translation_id, book_osis, b.canonical_order", "v", "books")
def snk_progress(s):
    """Verses per book of an import and so far."""
    per = s.verses.select("translation_id", "book_osis").join(F.broadcast(s.books), c("book_osis") == c("osis")).groupBy("translation_id", "book_osis", "canonical_order").agg(F.count(F.lit(1)).alias("verses"))
    return per.select("translation_id", "book_osis", "verses", F.sum("verses").over(Window.partitionBy("translation_id").orderBy("canonical_order")).alias("so_far"))


@query("SELECT doc_id, sha256(text) AS digest, left(sha256(text), 12) || '-' || regexp_replace(regexp_replace(filename, '[^\\p{L}\\p{N}._\\- ]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS stored_name FROM d WHERE text IS NOT NULL AND text <> ''", "d")
def snk_store_upload(s):
    """Digest and stored name of uploads; empty ones are refused."""
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    return s.documents.where("text IS NOT NULL AND text <> ''").select("doc_id", digest.alias("digest"), F.concat(F.left(digest, F.lit(12)), F.lit("-"), T.sanitize_filename(c("filename"))).alias("stored_name"))


# ------------------------------------------------------------------ filters and projections


@query(f"SELECT verse_id, verse, text FROM v WHERE translation_id = 1 AND book_osis = {_BOOK} AND chapter = 1", "v")
def flt_chapter(s):
    return C.chapter(s.table("verses"), ACTIVE, s.book, 1).select("verse_id", "verse", "text")


@query(f"SELECT id, note_id FROM a WHERE anchor_type = 'word' AND verse_id = {_BOOK} || '.1.1' AND translation_id = 2 AND token_idx = 2", "a")
def flt_word_anchor(s):
    return A.at_word(s.anchors, f"{s.book}.1.1", 2, 2).select("id", "note_id")


@query(f"SELECT id, note_id FROM a WHERE verse_id = {_BOOK} || '.1.1' AND (anchor_type = 'verse' OR (anchor_type = 'word' AND translation_id <> 1))", "a")
def flt_verse_anchor(s):
    return A.at_verse(s.anchors, f"{s.book}.1.1", ACTIVE).select("id", "note_id")


@query("SELECT note_id FROM n WHERE " + _LOWER.format("body") + " LIKE '%mercy%' OR " + _LOWER.format("title") + " LIKE '%mercy%'", "n")
def flt_contains_like(s):
    return s.some("notes", T.like_contains(c("body"), "Mercy") | T.like_contains(c("title"), "Mercy")).select("note_id")


@query(f"SELECT id FROM a WHERE starts_with({_LOWER.format('verse_id')}, {_LOWER.format(_BOOK)} || '.')", "a")
def flt_prefix_like(s):
    return s.anchors.where(T.in_book(c("verse_id"), s.book)).select("id")


@query("SELECT note_id FROM n WHERE (NULL IS NULL OR title = NULL) AND " + _LOWER.format("body") + " LIKE '%lamp%'", "n")
def flt_optional_param(s):
    """Optional filters: one that isn't given isn't in the plan."""
    given = {"title": None, "body": "lamp"}
    rows = s.notes
    for name, value in given.items():
        if value is not None:
            rows = rows.where(T.like_contains(c(name), value))
    return rows.select("note_id")


@query("SELECT span_id FROM sp WHERE trim(text) <> ''", "sp")
def flt_nonblank(s):
    return s.some("spans", F.trim("text") != "").select("span_id")


@query("SELECT job_id, CAST(row_number() OVER (ORDER BY created_at, job_id) AS BIGINT) AS place FROM j WHERE state = 'UPLOADED' AND claimed_at IS NULL QUALIFY place <= 10", "j")
def flt_ready_jobs(s):
    """The ten oldest jobs that wait."""
    first = s.some("jobs", "state = 'UPLOADED' AND claimed_at IS NULL").orderBy("created_at", "job_id").limit(10)
    return first.select("job_id", F.row_number().over(Window.orderBy("created_at", "job_id")).cast("long").alias("place"))


@query("SELECT span_id, confidence FROM sp WHERE confidence < 0.75", "sp")
def flt_low_confidence(s):
    return s.some("spans", c("confidence") < X.DOUBTFUL).select("span_id", "confidence")


@query("SELECT testament, string_agg(osis, ',' ORDER BY canonical_order) AS books FROM books GROUP BY testament", "books")
def prj_testament_split(s):
    return s.books.groupBy("testament").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("canonical_order", "osis"))), lambda x: x["osis"]), ",").alias("books"))


@query("SELECT j.job_id, x.job_id IS NOT NULL AS has_text, coalesce(x.verified, false) AS verified, coalesce(x.edited, false) AS edited FROM j LEFT JOIN (SELECT job_id, max(verified) AS verified, max(edited) AS edited FROM x GROUP BY job_id) x USING (job_id)", "j", "x")
def prj_job_flags(s):
    own = s.table("extractions").groupBy("job_id").agg(F.max("verified").alias("verified"), F.max("edited").alias("edited"), F.lit(True).alias("has"))
    return s.jobs.join(own, "job_id", "left").select("job_id", c("has").isNotNull().alias("has_text"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("edited", F.lit(False)).alias("edited"))


@query("SELECT doc_id, CASE WHEN format IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'heic') THEN 'image' WHEN format IN ('mp3', 'm4a', 'wav', 'aiff', 'flac') THEN 'audio' ELSE 'typed' END AS kind FROM d", "d")
def prj_kind(s):
    return s.documents.select("doc_id", F.when(c("format").isin("png", "jpg", "jpeg", "tif", "tiff", "heic"), "image").when(c("format").isin("mp3", "m4a", "wav", "aiff", "flac"), "audio").otherwise("typed").alias("kind"))


@query("SELECT doc_id, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS format, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) <> '' AS valid FROM d", "d")
def prj_format_of(s):
    return s.documents.select("doc_id", T.extension(c("filename")).alias("format"), (T.extension(c("filename")) != "").alias("valid"))


@query("SELECT id, anchor_type = 'word' AND translation_id IS DISTINCT FROM 1 AS degraded FROM a", "a")
def prj_degraded(s):
    return s.anchors.select("id", A.degraded(ACTIVE).alias("degraded"))


@query("SELECT n.note_id, a.anchor_type, a.verse_id, a.translation_id, a.token_idx FROM n LEFT JOIN a USING (note_id)", "n", "a")
def prj_anchor_struct(s):
    rows = s.notes.select("note_id").join(s.anchors.drop("id", "surface"), "note_id", "left").withColumn("anchor", A.anchor_struct())
    return rows.select("note_id", *[c("anchor")[x].alias(x) for x in ("anchor_type", "verse_id", "translation_id", "token_idx")])


@query("SELECT a.id, t.abbrev AS origin FROM a LEFT JOIN t ON t.id = a.translation_id", "a", "t")
def prj_origin_abbrev(s):
    t = s.translations.select(c("id").alias("translation_id"), c("abbrev").alias("origin"))
    return s.anchors.join(F.broadcast(t), "translation_id", "left").select("id", "origin")


@query("SELECT note_id, coalesce(title, body) AS line FROM n", "n")
def prj_note_preview_row(s):
    return s.notes.select("note_id", F.coalesce("title", "body").alias("line"))


@query("SELECT h.id, CASE WHEN h.anchor_type = 'word' THEN '“' || h.surface || '”' ELSE coalesce(v.text, '') END AS label FROM h LEFT JOIN v ON v.translation_id = 1 AND v.verse_id = h.verse_id", "h", "v")
def prj_highlight_label(s):
    v = s.some("verses", c("translation_id") == ACTIVE).select("verse_id", "text")
    return s.highlights.join(v, "verse_id", "left").select("id", F.when(c("anchor_type") == "word", F.concat(F.lit("“"), "surface", F.lit("”"))).otherwise(F.coalesce("text", F.lit(""))).alias("label"))


@query("SELECT id, verse_id, CASE WHEN anchor_type = 'word' AND translation_id = 1 THEN token_idx END AS token_idx FROM a", "a")
def prj_jump_anchor(s):
    ok = (c("anchor_type") == "word") & ~A.degraded(ACTIVE) & c("translation_id").isNotNull()
    return s.anchors.select("id", "verse_id", F.when(ok, c("token_idx")).alias("token_idx"))


@query("SELECT doc_id, bool_or(edited) AS changed, bool_and(regexp_full_match(text, '\\s*')) AS blank FROM sp GROUP BY doc_id", "sp")
def prj_review_changed_empty(s):
    return s.table("spans").groupBy("doc_id").agg(F.bool_or("edited").alias("changed"), F.bool_and(T.strip_space(c("text")) == "").alias("blank"))


# ------------------------------------------------------------------ joins


@query("SELECT id, abbrev FROM t WHERE EXISTS (SELECT 1 FROM verses v WHERE v.translation_id = t.id)", "t")
def join_semi_installed(s):
    return C.installed(s.translations, s.table("verses")).select("id", "abbrev").orderBy("abbrev")


@query("SELECT count(*) AS notes FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.note_id = n.note_id)", "n", "a")
def join_anti_standalone(s):
    return A.standalone(s.notes, s.anchors).agg(F.count(F.lit(1)).alias("notes"))


@query("SELECT b.osis, b.name, b.canonical_order, b.testament, max(v.chapter) AS chapters FROM books b JOIN v ON v.book_osis = b.osis AND v.translation_id = 1 GROUP BY ALL", "books", "v")
def join_inner_books(s):
    top = s.some("verses", c("translation_id") == ACTIVE).groupBy(c("book_osis").alias("osis")).agg(F.max("chapter").alias("chapters"))
    return top.join(F.broadcast(s.books), "osis").select("osis", "name", "canonical_order", "testament", "chapters")


@query("SELECT b.osis, max(v.chapter) AS max_chapter FROM books b JOIN v ON v.book_osis = b.osis GROUP BY b.osis", "books", "v")
def agg_max_chapter(s):
    return s.table("verses").groupBy(c("book_osis").alias("osis")).agg(F.max("chapter").alias("max_chapter"))


@query("SELECT n.note_id, a.id, a.anchor_type, t.abbrev FROM n JOIN a USING (note_id) LEFT JOIN t ON t.id = a.translation_id", "n", "a", "t")
def join_note_anchor(s):
    t = s.translations.select(c("id").alias("translation_id"), "abbrev")
    return s.notes.select("note_id").join(s.anchors, "note_id").join(F.broadcast(t), "translation_id", "left").select("note_id", "id", "anchor_type", "abbrev")


_LIBRARY = """SELECT n.note_id, n.title, a.anchor_type, a.verse_id, t.abbrev AS origin, b.name AS book_name, coalesce(a.anchor_type = 'word' AND a.translation_id IS DISTINCT FROM 1, false) AS degraded
  FROM n LEFT JOIN a USING (note_id) LEFT JOIN t ON t.id = a.translation_id LEFT JOIN books b ON b.osis = CASE WHEN instr(a.verse_id, '.') > 0 THEN substr(a.verse_id, 1, instr(a.verse_id, '.') - 1) ELSE '' END"""


def _library(s):
    rows = A.library(s.notes, s.anchors, s.translations, s.books)
    return rows.select("note_id", "title", "anchor_type", "verse_id", "origin", "book_name", F.coalesce(A.degraded(ACTIVE), F.lit(False)).alias("degraded"), "created_at")


@query(_LIBRARY, "n", "a", "t")
def join_library(s):
    return _library(s).drop("created_at")


@query(_LIBRARY + " ORDER BY n.created_at DESC, n.note_id DESC LIMIT 200", "n", "a", "t")
def topk_library(s):
    return _library(s).orderBy(c("created_at").desc(), c("note_id").desc()).limit(200).drop("created_at")


_CHAPTER_NOTES = f"""SELECT n.note_id, a.verse_id, v.verse, a.token_idx, {_STAMP.format('n.created_at')} AS created_at FROM n JOIN a USING (note_id) JOIN v ON v.verse_id = a.verse_id AND v.translation_id = 1 WHERE v.book_osis = {_BOOK} AND v.chapter = 1"""


@query(_CHAPTER_NOTES, "n", "a", "v")
def join_chapter_notes(s):
    v = C.chapter(s.table("verses"), ACTIVE, s.book, 1).select("verse_id", "verse")
    return s.anchors.join(v, "verse_id").join(s.notes.select("note_id", "created_at"), "note_id").select("note_id", "verse_id", "verse", "token_idx", stamp("created_at"))


@query(_CHAPTER_NOTES + " ORDER BY v.verse, a.token_idx NULLS FIRST, n.created_at, n.note_id", "n", "a", "v")
def sort_chapter_notes(s):
    return join_chapter_notes(s).orderBy("verse", c("token_idx").asc_nulls_first(), "created_at", "note_id")


@query(f"SELECT id FROM h WHERE verse_id IN (SELECT verse_id FROM verses WHERE translation_id = 1 AND book_osis = {_BOOK} AND chapter = 1)", "h")
def join_in_subquery(s):
    return s.highlights.join(C.chapter(s.table("verses"), ACTIVE, s.book, 1).select("verse_id"), "verse_id", "left_semi").select("id")


_RECENT = f"SELECT h.id, h.color, b.name AS book_name, v.text, {_STAMP.format('h.created_at')} AS created_at FROM h LEFT JOIN books b ON b.osis = split_part(h.verse_id, '.', 1) LEFT JOIN v ON v.verse_id = h.verse_id AND v.translation_id = 1"


@query(_RECENT + " ORDER BY h.created_at DESC, h.id DESC LIMIT 5", "h", "v")
def topk_recent_highlights(s):
    """The newest first, joined to their texts only afterwards."""
    newest = s.highlights.orderBy(c("created_at").desc(), c("id").desc()).limit(5)
    return _recent(s, newest)


def _recent(s, rows):
    b = s.books.select("osis", c("name").alias("book_name"))
    v = s.some("verses", c("translation_id") == ACTIVE).select("verse_id", "text")
    return rows.withColumn("osis", T.book_prefix(c("verse_id"))).join(F.broadcast(b), "osis", "left").join(v, "verse_id", "left").select("id", "color", "book_name", "text", stamp("created_at"))


@query(_RECENT, "h", "v")
def join_recent_highlights(s):
    return _recent(s, s.highlights)


@query("SELECT j.job_id, j.state, d.filename, x.extraction_id, x.engine FROM j JOIN d USING (doc_id) LEFT JOIN x ON x.job_id = j.job_id", "j", "d", "x")
def join_job_doc_extraction(s):
    return s.jobs.select("job_id", "doc_id", "state").join(s.documents.select("doc_id", "filename"), "doc_id").join(s.extractions.select("job_id", "extraction_id", "engine"), "job_id", "left").select("job_id", "state", "filename", "extraction_id", "engine")


@query("SELECT s.span_id, s.idx, p.page_no FROM sp s LEFT JOIN pg p ON p.page_id = s.page_id", "sp", "pg")
def join_span_page(s):
    return s.spans.join(s.pages.select("page_id", "page_no"), "page_id", "left").select("span_id", "idx", "page_no")


@query("SELECT t.abbrev, count(v.verse_id) > 0 AS installed, count(v.verse_id) AS verse_count FROM t LEFT JOIN v ON v.translation_id = t.id GROUP BY t.abbrev", "t", "v")
def join_pack_status(s):
    return C.pack_status(s.translations.select("abbrev"), s.translations, s.verses)


@query("SELECT v.translation_id, v.verse_id, count(k.token_id) AS n, coalesce(string_agg(k.surface, ' ' ORDER BY k.idx, k.surface, k.char_start), '') AS words FROM v LEFT JOIN tok k ON k.translation_id = v.translation_id AND k.verse_id = v.verse_id GROUP BY v.translation_id, v.verse_id", "v", "tok")
def join_nested_tokens(s):
    rows = C.with_tokens(s.verses.select("translation_id", "verse_id"), s.tokens)
    return rows.select("translation_id", "verse_id", F.size("tokens").cast("long").alias("n"), F.array_join(F.transform("tokens", lambda x: x["surface"]), " ").alias("words"))


_TURNS = "tn AS (SELECT doc_id, speaker AS who, min(start_s) AS ts, max(end_s) AS te, row_number() OVER (PARTITION BY doc_id ORDER BY min(start_s), speaker, CAST(floor(start_s / 60) AS BIGINT)) AS turn_no FROM sp WHERE start_s IS NOT NULL AND end_s > start_s AND speaker IS NOT NULL GROUP BY doc_id, speaker, CAST(floor(start_s / 60) AS BIGINT))"


def _turns(s):
    """Turns from elsewhere: what each speaker says within a minute."""
    good = s.some("spans", "start_s IS NOT NULL AND end_s > start_s AND speaker IS NOT NULL")
    per = good.groupBy("doc_id", "speaker", F.floor(c("start_s") / 60).alias("minute")).agg(F.min("start_s").alias("turn_start"), F.max("end_s").alias("turn_end"))
    numbered = per.withColumn("turn_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn_start", "speaker", "minute")))
    return numbered.select("doc_id", c("speaker").alias("turn_speaker"), "turn_start", "turn_end", "turn_no")


_LABEL = (
    "WITH "
    + _TURNS
    + """, sg AS (SELECT span_id, doc_id, start_s, end_s, CASE WHEN end_s IS NULL OR end_s = 0 THEN start_s ELSE end_s END AS e2 FROM sp WHERE start_s IS NOT NULL),
  f AS (SELECT sg.span_id, tn.who, tn.turn_no, least(tn.te, CASE WHEN sg.end_s IS NULL OR sg.end_s = 0 THEN (sg.start_s + sg.e2) / 2 ELSE sg.end_s END) - greatest(tn.ts, sg.start_s) AS o FROM sg JOIN tn USING (doc_id) WHERE tn.ts <= (sg.start_s + sg.e2) / 2 AND (sg.start_s + sg.e2) / 2 <= tn.te),
  g AS (SELECT span_id, who FROM f WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY o DESC, turn_no) = 1)
  """
)


@query(_LABEL + "SELECT sg.span_id, g.who AS label FROM sg LEFT JOIN g USING (span_id)", "sp")
def join_interval_speaker(s):
    segments = s.some("spans", "start_s IS NOT NULL").select("span_id", "doc_id", "start_s", "end_s")
    return X.label_speakers(segments, _turns(s), ["doc_id"], "span_id").select("span_id", "label")


@query(_LABEL + "SELECT sg.doc_id, bool_or(g.who IS NOT NULL) AS labelled FROM sg LEFT JOIN g USING (span_id) GROUP BY sg.doc_id", "sp")
def rec_label_speakers_safe(s):
    segments = s.some("spans", "start_s IS NOT NULL").select("span_id", "doc_id", "start_s", "end_s")
    return X.label_speakers(segments, _turns(s), ["doc_id"], "span_id").groupBy("doc_id").agg(F.bool_or(c("label").isNotNull()).alias("labelled"))


@query("SELECT d.doc_id, d.stored_path FROM d WHERE d.doc_id NOT IN (SELECT doc_id FROM jobs WHERE doc_id IS NOT NULL)", "d")
def join_delete_orphans(s):
    """Stored files that no job refers to any more."""
    return s.documents.join(s.jobs.select("doc_id"), "doc_id", "left_anti").select("doc_id", "stored_path")


@query("SELECT k.token_id, h.n AS highlights FROM tok k JOIN (SELECT verse_id, translation_id, token_idx, count(*) AS n FROM h WHERE anchor_type = 'word' GROUP BY ALL) h ON h.verse_id = k.verse_id AND h.translation_id = k.translation_id AND h.token_idx = k.idx", "tok", "h")
def join_annotation_lookup(s):
    """Words of the text that are highlighted."""
    h = s.highlights.where("anchor_type = 'word'").groupBy("verse_id", "translation_id", c("token_idx").alias("idx")).agg(F.count(F.lit(1)).alias("highlights"))
    return s.tokens.join(h, ["verse_id", "translation_id", "idx"]).select("token_id", "highlights")


_DAYS = "WITH m AS (SELECT CAST(max(created_at) AS DATE) AS d FROM notes), days AS (SELECT unnest(generate_series(m.d - INTERVAL 29 DAY, CAST(m.d AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM m), per AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS k FROM n GROUP BY 1), spine AS (SELECT CAST(days.day AS DATE) AS day, coalesce(per.k, 0) AS notes FROM days LEFT JOIN per ON per.day = CAST(days.day AS DATE)) "


def _trend(s):
    last = F.lit(s.table("notes").agg(F.max("created_at").cast("date")).first()[0])
    spine = s.spark.range(1).select(F.explode(F.sequence(F.date_sub(last, 29), last)).alias("day"))
    per = s.notes.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("notes"))


@query(_DAYS + "SELECT CAST(day AS VARCHAR) AS day, notes FROM spine", "n")
def join_calendar_spine(s):
    return _trend(s).select(c("day").cast("string").alias("day"), "notes")


@query(_DAYS + "SELECT CAST(sum(notes) AS BIGINT) AS total, greatest(1, max(notes)) AS busiest FROM spine", "n")
def agg_trend_summary(s):
    return _trend(s).agg(F.sum("notes").alias("total"), F.greatest(F.lit(1).cast("long"), F.max("notes")).alias("busiest"))


@query("SELECT CAST(CAST(created_at + INTERVAL 2 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS notes FROM n WHERE CAST(created_at + INTERVAL 2 HOUR AS DATE) >= (SELECT CAST(max(created_at) + INTERVAL 2 HOUR AS DATE) - 29 FROM notes) GROUP BY 1", "n")
def agg_notes_by_day(s):
    """Notes per local day of the last 30, zone and day given, not taken from the clock."""
    top = s.table("notes").agg(F.max("created_at").alias("m")).select(F.to_date(F.from_utc_timestamp("m", "+02:00"))).first()[0]
    day = F.to_date(F.from_utc_timestamp("created_at", "+02:00"))
    return s.some("notes", day >= F.date_sub(F.lit(top), 29)).groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("notes"))


# ------------------------------------------------------------------ references

_REFS = ["{b} 1:3", "  {b}   1 : 2 ", "{l}1:1", "{b} 1", "{b}", "{b} 99", "", "12345", "zzz 3:1", "book of {b} 1.4", "{b} 0"]


def _reference_rows(s):
    typed = [(i, x.format(b=s.book, l=s.book.lower())) for i, x in enumerate(_REFS)]
    return s.spark.createDataFrame(typed, "k long, typed string")


def _counted_books(s):
    return s.books.join(s.table("verses").groupBy(c("book_osis").alias("osis")).agg(F.max("chapter").alias("chapter_count")), "osis")


_TOP = "(SELECT max(chapter) FROM verses WHERE book_osis = (SELECT max(book_osis) FROM verses))"
_PARSED_SQL = f"SELECT k, CASE WHEN c IS NOT NULL AND c BETWEEN 1 AND {_TOP} THEN {_BOOK} END AS book, CASE WHEN c BETWEEN 1 AND {_TOP} THEN c END AS chapter, CASE WHEN c BETWEEN 1 AND {_TOP} AND w > 0 THEN w END AS verse FROM (SELECT CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS c, CAST(w AS BIGINT) AS w FROM (VALUES (0, 1, 3), (1, 1, 2), (2, 1, 1), (3, 1, NULL), (4, 1, NULL), (5, 99, NULL), (6, NULL, NULL), (7, NULL, NULL), (8, NULL, NULL), (9, 1, 4), (10, 0, NULL)) AS r(k, c, w)) AS q"


@query(_PARSED_SQL)
def str_parse_reference(s):
    return R.parse_references(_reference_rows(s), "typed", _counted_books(s)).select("k", "book", "chapter", "verse")


@query(f"SELECT k, b || '.' || c || '.' || coalesce(w, 1) AS anchor FROM (SELECT k, book AS b, chapter AS c, verse AS w FROM ({_PARSED_SQL}))")
def prj_reference_anchor(s):
    """Typed reference to a verse anchor; the verse defaults to 1, what can't be resolved has none."""
    p = R.parse_references(_reference_rows(s), "typed", _counted_books(s))
    return p.select("k", F.when(c("book").isNotNull(), T.verse_id(c("book"), c("chapter"), F.coalesce("verse", F.lit(1)))).alias("anchor"))


@query("SELECT osis, lower(osis) AS q FROM books", "books")
def str_normalize_ref(s):
    return s.books.select("osis", T.normalize_reference(c("osis")).alias("q"))


@query("SELECT verse_id, book_osis || '.' || chapter || '.' || verse AS made FROM (SELECT DISTINCT verse_id, book_osis, chapter, verse FROM verses)")
def str_verse_id(s):
    return s.table("verses").select("verse_id", T.verse_id(c("book_osis"), c("chapter"), c("verse")).alias("made")).distinct()


@query("SELECT DISTINCT verse_id, CASE WHEN instr(verse_id, '.') > 0 THEN substr(verse_id, 1, instr(verse_id, '.') - 1) ELSE '' END AS book FROM verses")
def str_book_prefix(s):
    return s.table("verses").select("verse_id", T.book_prefix(c("verse_id")).alias("book")).distinct()


@query("SELECT DISTINCT verse_id, book_osis AS book, chapter, verse AS verse_no FROM verses")
def str_split_verse_id(s):
    return s.table("verses").select("verse_id", *T.split_verse_id(c("verse_id"))).distinct()


@query("SELECT note_id, CASE WHEN length(f) > 140 THEN left(f, 140) || '…' ELSE f END AS preview FROM (SELECT note_id, trim(regexp_replace(body, '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS f FROM n)", "n")
def str_preview(s):
    return s.notes.select("note_id", T.preview(c("body")).alias("preview"))


@query("SELECT doc_id, regexp_replace(regexp_replace(filename, '[^\\p{L}\\p{N}._\\- ]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM d", "d")
def str_sanitize_filename(s):
    return s.documents.select("doc_id", T.sanitize_filename(c("filename")).alias("name"))


@query("SELECT doc_id, coalesce(nullif(title, ''), regexp_replace(filename, '(.)\\.[^.]*$', '\\1')) AS title FROM d", "d")
def str_stem_title(s):
    return s.documents.select("doc_id", T.stem_title(c("title"), c("filename")).alias("title"))


@query("SELECT osis || '.' || 1 AS position, osis AS book, CAST(1 AS BIGINT) AS chapter FROM books", "books")
def str_parse_position(s):
    """A stored position and back; null without a chapter above 0."""
    rows = s.books.select(F.concat_ws(".", "osis", F.lit("1")).alias("position"))
    parts = F.split("position", r"\.")
    return rows.select("position", F.try_element_at(parts, F.lit(1)).alias("book"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("chapter")).where("chapter > 0")


@query("SELECT DISTINCT v.verse_id, coalesce(b.name, v.book_osis) || ' ' || v.chapter || ':' || v.verse AS shown FROM verses v LEFT JOIN books b ON b.osis = v.book_osis", "books")
def str_format_reference(s):
    rows = s.table("verses").select("verse_id", "book_osis", "chapter", "verse").distinct().join(F.broadcast(s.books.select(c("osis").alias("book_osis"), "name")), "book_osis", "left")
    return rows.select("verse_id", F.concat(F.coalesce("name", "book_osis"), F.lit(" "), "chapter", F.lit(":"), "verse").alias("shown"))


@query("SELECT x.extraction_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE greatest(0, 1 - 10 * (length(text) - length(replace(text, '�', ''))) / length(text)) END AS confidence FROM x WHERE text IS NOT NULL", "x")
def str_decode_confidence(s):
    return s.some("extractions", "text IS NOT NULL").select("extraction_id", T.decode_confidence(c("text")).alias("confidence"))


@query("SELECT id, CASE WHEN anchor_type = 'word' THEN '“' || surface || '” · ' || verse_id ELSE verse_id END AS label FROM a", "a")
def str_selection_label(s):
    return s.anchors.select("id", F.when(c("anchor_type") == "word", F.concat(F.lit("“"), "surface", F.lit("” · "), "verse_id")).otherwise(c("verse_id")).alias("label"))


@query("SELECT doc_id, CASE WHEN byte_size < 1024 THEN byte_size || ' B' WHEN byte_size < 1048576 THEN printf('%.1f kB', floor(byte_size / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(byte_size / 1048576 * 10 + 0.5) / 10) END AS size FROM d", "d")
def str_format_bytes(s):
    return s.documents.select("doc_id", T.format_bytes(c("byte_size")).alias("size"))


@query("SELECT span_id, CASE WHEN start_s IS NULL THEN '—' WHEN start_s >= 3600 THEN CAST(floor(start_s / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor(start_s) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE CAST(floor(start_s) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(start_s) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS shown FROM sp", "sp")
def str_format_time(s):
    return s.spans.select("span_id", T.format_time(c("start_s")).alias("shown"))


@query("SELECT id, CASE WHEN anchor_type = 'word' THEN 'w:' || verse_id || ':' || token_idx ELSE 'v:' || verse_id END AS key FROM a", "a")
def str_anchor_key(s):
    return s.anchors.select("id", T.anchor_key(c("anchor_type"), c("verse_id"), c("token_idx")).alias("key"))


_ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in T.ALIASES.items())


@query(f"SELECT form || alias || CASE WHEN form = ' ' THEN '. ' ELSE '' END AS typed, CASE WHEN form <> 'x' THEN osis END AS osis FROM (VALUES {_ALIAS_ROWS}) AS q(alias, osis), (VALUES (''), (' '), ('x')) AS f(form)")
def str_alias_map(s):
    """Aliases as typed, with signs and blanks around them, to the codes of their books; what is no alias has none."""
    a = s.spark.createDataFrame([(k,) for k in T.ALIASES], "alias string")
    typed = a.select(F.explode(F.array("alias", F.concat(F.lit(" "), "alias", F.lit(". ")), F.concat(F.lit("x"), "alias"))).alias("typed"))
    return typed.select("typed", T.alias(c("typed")).alias("osis"))


# ------------------------------------------------------------------ aggregations


@query("SELECT verse_id, CASE WHEN anchor_type = 'word' AND translation_id = 1 THEN token_idx END AS token_idx, CAST(sum(CASE WHEN anchor_type = 'word' AND translation_id <> 1 THEN 0 ELSE 1 END) AS BIGINT) AS count, CAST(sum(CASE WHEN anchor_type = 'word' AND translation_id <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS degraded FROM a GROUP BY 1, 2", "a")
def agg_note_marks(s):
    return A.note_marks(s.anchors, ACTIVE)


@query("SELECT verse_id, CAST(sum(CASE WHEN anchor_type = 'word' AND translation_id <> 1 THEN 0 ELSE 1 END) AS BIGINT) AS notes, CAST(sum(CASE WHEN anchor_type = 'word' AND translation_id <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS elsewhere FROM a WHERE NOT coalesce(anchor_type = 'word' AND translation_id = 1, false) GROUP BY 1", "a")
def agg_verse_note_count(s):
    return A.note_marks(s.anchors, ACTIVE).where("token_idx IS NULL").select("verse_id", c("count").alias("notes"), c("degraded").alias("elsewhere"))


@query("SELECT verse_id, concat_ws(' · ', CASE WHEN k > 0 THEN k || ' verse note' || CASE WHEN k = 1 THEN '' ELSE 's' END END, CASE WHEN g > 0 THEN g || ' word note' || CASE WHEN g = 1 THEN '' ELSE 's' END || ' from another translation' END) AS title FROM (SELECT verse_id, CAST(sum(CASE WHEN anchor_type = 'word' THEN 0 ELSE 1 END) AS BIGINT) AS k, CAST(sum(CASE WHEN anchor_type = 'word' AND translation_id <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS g FROM a WHERE NOT coalesce(anchor_type = 'word' AND translation_id = 1, false) GROUP BY verse_id)", "a")
def prj_note_dot_title(s):
    plural = lambda n, one: F.concat(n.cast("string"), F.lit(" " + one), F.when(n == 1, "").otherwise("s"))
    m = A.note_marks(s.anchors, ACTIVE).where("token_idx IS NULL")
    return m.select("verse_id", F.concat_ws(" · ", F.when(c("count") > 0, plural(c("count"), "verse note")), F.when(c("degraded") > 0, F.concat(plural(c("degraded"), "word note"), F.lit(" from another translation")))).alias("title"))


@query("SELECT count(*) AS n FROM n", "n")
def agg_notes_total(s):
    return s.notes.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM h", "h")
def agg_highlights_total(s):
    return s.highlights.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM t WHERE id IN (SELECT translation_id FROM verses)", "t")
def agg_translations_installed(s):
    return C.installed(s.translations, s.table("verses")).agg(F.count(F.lit(1)).alias("n"))


_POOL = "SELECT split_part(verse_id, '.', 1) AS osis FROM a UNION ALL SELECT split_part(verse_id, '.', 1) FROM h"


def _pool(s):
    return s.anchors.select("verse_id").unionByName(s.highlights.select("verse_id")).select(T.book_prefix(c("verse_id")).alias("osis"))


@query(f"SELECT count(DISTINCT osis) AS n FROM ({_POOL})", "a", "h")
def agg_books_annotated(s):
    return _pool(s).agg(F.countDistinct("osis").alias("n"))


@query(f"SELECT osis, count(*) AS n FROM ({_POOL}) GROUP BY osis", "a", "h")
def set_union_all_annotations(s):
    return _pool(s).groupBy("osis").agg(F.count(F.lit(1)).alias("n"))


_BY_BOOK = f"SELECT p.osis, b.name, count(*) AS n FROM ({_POOL}) p LEFT JOIN books b USING (osis) GROUP BY p.osis, b.name, b.canonical_order ORDER BY n DESC, b.canonical_order NULLS FIRST, p.osis LIMIT 8"


@query(_BY_BOOK, "a", "h")
def agg_by_book(s):
    per = _pool(s).groupBy("osis").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(s.books), "osis", "left")
    return per.orderBy(c("n").desc(), c("canonical_order").asc_nulls_first(), "osis").limit(8).select("osis", "name", "n")


@query(_BY_BOOK, "a", "h")
def topk_books(s):
    return agg_by_book(s)


@query(f"SELECT osis, n, n / max(n) OVER () AS share FROM ({_BY_BOOK})", "a", "h")
def win_bar_share(s):
    return agg_by_book(s).select("osis", "n", (c("n") / F.max("n").over(Window.partitionBy())).alias("share"))


@query("SELECT color, count(*) AS n FROM h GROUP BY color", "h")
def agg_by_color(s):
    return s.highlights.groupBy("color").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "color")


@query("SELECT color, count(*) AS n FROM h GROUP BY color ORDER BY n DESC, color", "h")
def sort_colors(s):
    return agg_by_color(s)


@query(f"SELECT 'notes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'standalone', count(*) FROM n WHERE note_id NOT IN (SELECT note_id FROM a) UNION ALL SELECT 'highlights', count(*) FROM h UNION ALL SELECT 'translations', count(*) FROM t WHERE id IN (SELECT translation_id FROM verses) UNION ALL SELECT 'books', count(DISTINCT osis) FROM ({_POOL})", "n", "a", "h", "t")
def agg_stats(s):
    parts = {"notes": agg_notes_total(s), "standalone": join_anti_standalone(s), "highlights": agg_highlights_total(s), "translations": agg_translations_installed(s), "books": agg_books_annotated(s)}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("metric"), c(df.columns[0]).cast("long").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT s.state, count(j.job_id) AS n FROM (VALUES ('UPLOADED'), ('EXTRACTING'), ('NEEDS_REVIEW'), ('VERIFIED'), ('DONE'), ('ERROR')) AS s(state) LEFT JOIN j ON j.state = s.state GROUP BY s.state", "j")
def agg_job_counts(s):
    stages = s.spark.createDataFrame([(x,) for x in ("UPLOADED", "EXTRACTING", "NEEDS_REVIEW", "VERIFIED", "DONE", "ERROR")], "state string")
    return stages.join(s.jobs.groupBy("state").agg(F.count(F.lit(1)).alias("k")), "state", "left").select("state", F.coalesce("k", F.lit(0)).alias("n"))


@query("SELECT count(*) AS n FROM j WHERE state = 'NEEDS_REVIEW'", "j")
def agg_needs_review(s):
    return s.some("jobs", "state = 'NEEDS_REVIEW'").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, string_agg(text, chr(10) ORDER BY idx, span_id) AS text FROM sp WHERE trim(text) <> '' GROUP BY doc_id", "sp")
def agg_text_rebuild(s):
    return X.rebuilt_text(s.spans)


@query("SELECT doc_id, string_agg(CASE WHEN speaker IS NOT NULL AND speaker <> '' THEN '[' || speaker || '] ' || text ELSE text END, chr(10) ORDER BY idx, span_id) AS text FROM sp WHERE start_s IS NOT NULL GROUP BY doc_id", "sp")
def agg_transcript_text(s):
    line = F.when(c("speaker").isNotNull() & (c("speaker") != ""), F.concat(F.lit("["), "speaker", F.lit("] "), "text")).otherwise(c("text"))
    rows = s.some("spans", "start_s IS NOT NULL").select("doc_id", "idx", "span_id", line.alias("text"))
    return rows.groupBy("doc_id").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY idx, span_id)").alias("text"))


@query("SELECT doc_id, max(edited) AS edited FROM sp GROUP BY doc_id", "sp")
def agg_any_edited(s):
    return s.table("spans").groupBy("doc_id").agg(F.max("edited").alias("edited"))


@query("SELECT doc_id, min(coalesce(confidence, 0.0)) AS confidence FROM sp GROUP BY doc_id", "sp")
def agg_doc_confidence_ocr(s):
    return s.table("spans").groupBy("doc_id").agg(X.scan_confidence().alias("confidence"))


@query("SELECT doc_id, min(CASE WHEN confidence IS NULL OR confidence = 0 THEN 1.0 ELSE confidence END) AS confidence FROM sp GROUP BY doc_id", "sp")
def agg_doc_confidence_asr(s):
    return s.table("spans").groupBy("doc_id").agg(X.speech_confidence().alias("confidence"))


@query("SELECT doc_id, coalesce(min(confidence), 1.0) AS confidence FROM sp GROUP BY doc_id", "sp")
def agg_doc_confidence_cloud(s):
    return s.table("spans").groupBy("doc_id").agg(X.known_confidence().alias("confidence"))


@query("SELECT doc_id, speaker, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(idx), speaker) AS BIGINT) AS place FROM sp WHERE speaker IS NOT NULL AND speaker <> '' GROUP BY doc_id, speaker", "sp")
def agg_distinct_speakers(s):
    first = s.some("spans", "speaker IS NOT NULL AND speaker <> ''").groupBy("doc_id", "speaker").agg(F.min("idx").alias("seen"))
    return first.select("doc_id", "speaker", F.row_number().over(Window.partitionBy("doc_id").orderBy("seen", "speaker")).cast("long").alias("place"))


@query("SELECT doc_id, count(*) FILTER (confidence < 0.75) AS doubtful FROM sp GROUP BY doc_id", "sp")
def agg_doubtful_spans(s):
    return s.spans.groupBy("doc_id").agg(F.count_if(c("confidence") < X.DOUBTFUL).alias("doubtful"))


@query("SELECT v.translation_id, v.book_osis, count(DISTINCT v.verse_id) AS verses, count(k.token_id) AS tokens FROM v LEFT JOIN tok k ON k.translation_id = v.translation_id AND k.verse_id = v.verse_id GROUP BY ALL", "v", "tok")
def agg_import_totals(s):
    per = s.tokens.groupBy("translation_id", "verse_id").agg(F.count(F.lit(1)).alias("k"))
    return s.verses.join(per, ["translation_id", "verse_id"], "left").groupBy("translation_id", "book_osis").agg(F.count(F.lit(1)).alias("verses"), F.coalesce(F.sum("k"), F.lit(0)).alias("tokens"))


# ------------------------------------------------------------------ order


@query("WITH bc AS (SELECT b.osis, b.canonical_order, max(v.chapter) AS cc FROM books b JOIN verses v ON v.book_osis = b.osis GROUP BY ALL), ch AS (SELECT osis, canonical_order, unnest(generate_series(1, cc)) AS chapter FROM bc) SELECT osis, chapter, lag(osis || '.' || chapter) OVER w AS previous, lead(osis || '.' || chapter) OVER w AS following FROM ch WINDOW w AS (ORDER BY canonical_order, chapter)", "books")
def win_prev_next_chapter(s):
    return C.neighbours(_counted_books(s))


@query("SELECT span_id, CAST(row_number() OVER (PARTITION BY doc_id, page_id ORDER BY round_even(coalesce(y, 0) / 0.02, 0), coalesce(x, 0), idx, span_id) - 1 AS BIGINT) AS position FROM sp WHERE page_id IS NOT NULL", "sp")
def win_span_reading_order(s):
    return X.reading_order(s.some("spans", "page_id IS NOT NULL")).select("span_id", "position")


@query("SELECT s.span_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY p.page_no, s.idx, s.span_id) - 1 AS BIGINT) AS position FROM sp s JOIN pg p ON p.page_id = s.page_id", "sp", "pg")
def win_pdf_renumber(s):
    return X.renumber(s.spans.join(s.pages.select("page_id", "page_no"), "page_id")).select("span_id", "position")


@query("SELECT span_id, batch, CAST(min(idx) OVER (PARTITION BY doc_id, page_id, batch) AS BIGINT) AS first_idx FROM (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id, page_id ORDER BY idx, span_id) - 1) // 8 AS BIGINT) AS batch FROM sp WHERE page_id IS NOT NULL)", "sp")
def win_cloud_batches(s):
    return X.batches(s.some("spans", "page_id IS NOT NULL")).select("span_id", c("batch").cast("long").alias("batch"), "first_idx")


@query("SELECT osis FROM books ORDER BY osis <> 'none', canonical_order LIMIT 1", "books")
def win_default_book(s):
    """The book read last if it is there, else the first."""
    return s.books.orderBy(c("osis") != "none", "canonical_order").limit(1).select("osis")


@query("SELECT abbrev FROM t WHERE id IN (SELECT translation_id FROM verses) ORDER BY id <> 1, abbrev LIMIT 1", "t")
def win_default_translation(s):
    return C.installed(s.translations, s.table("verses")).orderBy(c("id") != ACTIVE, "abbrev").limit(1).select("abbrev")


@query(f"SELECT note_id, {_STAMP.format('created_at')} AS created_at FROM n ORDER BY n.created_at, note_id", "n")
def sort_notes_oldest(s):
    return s.notes.orderBy("created_at", "note_id").select("note_id", stamp("created_at"))


@query("SELECT job_id, state FROM j ORDER BY created_at DESC, job_id DESC", "j")
def sort_jobs(s):
    return s.jobs.orderBy(c("created_at").desc(), c("job_id").desc()).select("job_id", "state")


@query("SELECT page_id, doc_id, page_no FROM pg ORDER BY doc_id, page_no, page_id", "pg")
def sort_pages(s):
    return s.pages.orderBy("doc_id", "page_no", "page_id").select("page_id", "doc_id", "page_no")


@query("SELECT span_id, doc_id, idx FROM sp ORDER BY doc_id, idx, span_id", "sp")
def sort_spans(s):
    return s.spans.orderBy("doc_id", "idx", "span_id").select("span_id", "doc_id", "idx")


@query("SELECT osis FROM books ORDER BY canonical_order", "books")
def sort_books(s):
    return s.books.orderBy("canonical_order").select("osis")


@query("SELECT abbrev FROM t ORDER BY abbrev", "t")
def sort_translations(s):
    return s.translations.orderBy("abbrev").select("abbrev")


@query("SELECT translation_id, verse_id FROM v ORDER BY translation_id, book_osis, chapter, verse, verse_id", "v")
def sort_verses(s):
    return s.verses.orderBy("translation_id", "book_osis", "chapter", "verse", "verse_id").select("translation_id", "verse_id")


@query("SELECT token_id FROM tok ORDER BY translation_id, verse_id, idx, token_id", "tok")
def sort_tokens(s):
    return s.tokens.orderBy("translation_id", "verse_id", "idx", "token_id").select("token_id")


# ------------------------------------------------------------------ sets and changes of tables


@query("SELECT id, abbrev FROM t UNION ALL SELECT 9001, 'NEW'", "t")
def set_insert_or_ignore(s):
    new = s.spark.createDataFrame([(9001, "NEW"), (1, "IGNORED")], "id long, abbrev string")
    return M.insert_or_ignore(s.translations.select("id", "abbrev"), new, ["id"])


@query("SELECT extraction_id, job_id, text, CASE WHEN job_id % 2 = 0 THEN 'again' ELSE engine END AS engine, CASE WHEN job_id % 2 = 0 THEN false ELSE verified END AS verified, CASE WHEN job_id % 2 = 0 THEN false ELSE edited END AS edited FROM x", "x")
def set_upsert_extraction(s):
    """A new reading replaces engine and text and resets the flags; id and time of creation stay."""
    rows = s.extractions.select("extraction_id", "job_id", "text", "engine", "verified", "edited")
    change = rows.where("job_id % 2 = 0").select("extraction_id", F.lit("again").alias("engine"), F.lit(False).alias("verified"), F.lit(False).alias("edited"))
    return M.update(rows, change, "extraction_id", ["engine", "verified", "edited"])


@query("SELECT doc_id, CASE WHEN count(DISTINCT idx) < count(*) THEN 'twice' WHEN max(idx) >= count(*) THEN 'extra' END AS error FROM sp GROUP BY doc_id", "sp")
def set_exact_index_check(s):
    """Whether the indices of a document are exactly 0 .. n - 1, by counts: no list of them is made."""
    per = s.spans.groupBy("doc_id").agg(F.count("idx").alias("k"), F.countDistinct("idx").alias("different"), F.max("idx").alias("top"))
    return per.select("doc_id", F.when(c("different") < c("k"), "twice").when(c("top") >= c("k"), "extra").alias("error"))


@query("SELECT note_id, title FROM n UNION ALL SELECT (SELECT max(note_id) FROM notes) + 1, 'first' UNION ALL SELECT (SELECT max(note_id) FROM notes) + 2, 'second'", "n")
def mut_create_note(s):
    new = M.next_ids(s.spark.createDataFrame([("first",), ("second",)], "title string"), s.notes, "note_id", ["title"])
    return s.notes.select("note_id", "title").unionByName(new.select("note_id", "title"))


@query("SELECT n.note_id, CASE WHEN x.note_id IS NULL THEN n.title ELSE x.state END AS title FROM n LEFT JOIN (SELECT note_id, max(state) AS state FROM jobs WHERE note_id IS NOT NULL GROUP BY note_id) x USING (note_id)", "n")
def mut_update_note(s):
    change = s.some("jobs", "note_id IS NOT NULL").groupBy("note_id").agg(F.max("state").alias("title"))
    return M.update(s.notes.select("note_id", "title"), change, "note_id", ["title"])


@query("SELECT job_id, CASE WHEN note_id IN (SELECT key_id FROM tombstones WHERE tbl = 'notes') THEN NULL ELSE note_id END AS note_id FROM j", "j")
def mut_delete_note(s):
    """Deleting notes sets the jobs' references to null."""
    gone = s.table("tombstones").where("tbl = 'notes'").select("key_id")
    return M.null_references(s.jobs.select("job_id", "note_id"), "note_id", gone, "key_id")


@query("SELECT id, note_id, verse_id FROM a WHERE note_id NOT IN (SELECT note_id FROM jobs WHERE note_id IS NOT NULL) UNION ALL SELECT DISTINCT -note_id, note_id, 'Gen.1.1' FROM jobs WHERE note_id IS NOT NULL", "a")
def mut_set_note_anchor(s):
    new = s.some("jobs", "note_id IS NOT NULL").select("note_id").distinct().select((-c("note_id")).alias("id"), "note_id", F.lit("Gen.1.1").alias("verse_id"))
    return M.replace_group(s.anchors.select("id", "note_id", "verse_id"), new, ["note_id"])


@query(f"SELECT id FROM h WHERE NOT starts_with(verse_id, {_BOOK} || '.')", "h")
def mut_clear_highlight(s):
    gone = s.highlights.where(T.in_book(c("verse_id"), s.book)).select("anchor_type", "verse_id", "translation_id", "token_idx").distinct()
    return M.delete(s.highlights, gone, ["anchor_type", "verse_id", "translation_id", "token_idx"]).select("id")


@query("SELECT translation_id, count(*) AS verses FROM v WHERE translation_id <> 1 GROUP BY translation_id", "v")
def mut_remove_pack(s):
    gone = s.spark.createDataFrame([(ACTIVE,)], "translation_id long")
    return M.delete(s.verses, gone, ["translation_id"]).groupBy("translation_id").agg(F.count(F.lit(1)).alias("verses"))


@query("SELECT count(*) AS tokens FROM tok WHERE translation_id <> 1", "tok")
def mut_clear_text(s):
    gone = s.spark.createDataFrame([(ACTIVE,)], "translation_id long")
    return M.delete(s.tokens, gone, ["translation_id"]).agg(F.count(F.lit(1)).alias("tokens"))


@query("SELECT span_id, CASE WHEN text LIKE '%mercy%' THEN replace(text, 'mercy', 'grace') ELSE text END AS text, text LIKE '%mercy%' OR edited AS edited FROM sp", "sp")
def mut_save_span_verification(s):
    """Texts of spans are corrected; a span whose text differs stays marked as edited."""
    new = F.replace(c("text"), F.lit("mercy"), F.lit("grace"))
    return s.spans.select("span_id", new.alias("text"), ((new != c("text")) | c("edited")).alias("edited"))


_GONE = """WITH gj AS (SELECT * FROM j WHERE job_id % 3 = 0 AND doc_id IS NOT NULL), gd AS (SELECT DISTINCT doc_id FROM gj WHERE note_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM n WHERE doc_id IS NOT NULL)),
  lj AS (SELECT * FROM j WHERE job_id NOT IN (SELECT job_id FROM gj) AND (doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gd))), ld AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM gd)),
  lp AS (SELECT * FROM pg WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gd)), paths AS (SELECT stored_path AS path FROM d WHERE doc_id IN (SELECT doc_id FROM gd) UNION SELECT image_path FROM pg WHERE doc_id IN (SELECT doc_id FROM gd)) """


@query(_GONE + """SELECT 'jobs' AS tbl, CAST(job_id AS VARCHAR) AS row_key FROM lj UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM ld UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM lp
  UNION ALL SELECT 'spans', CAST(span_id AS VARCHAR) FROM sp WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gd)
  UNION ALL SELECT 'extractions', CAST(extraction_id AS VARCHAR) FROM x WHERE job_id IS NULL OR job_id NOT IN (SELECT job_id FROM j) OR job_id IN (SELECT job_id FROM lj)
  UNION ALL SELECT 'paths', path FROM paths WHERE path IS NOT NULL
  UNION ALL SELECT 'free_paths', path FROM paths WHERE path IS NOT NULL AND path NOT IN (SELECT stored_path FROM ld WHERE stored_path IS NOT NULL) AND path NOT IN (SELECT image_path FROM lp WHERE image_path IS NOT NULL)""", "j", "n", "d", "pg", "sp", "x")
def mut_delete_job(s):
    """Every third job is deleted: what is left of each table, and the paths that went."""
    left = J.delete_jobs(s.some("jobs", "job_id % 3 = 0").select("job_id"), s.jobs, s.notes, s.documents, s.pages, s.spans, s.extractions)
    keys = {"jobs": "job_id", "documents": "doc_id", "pages": "page_id", "spans": "span_id", "extractions": "extraction_id", "paths": "path", "free_paths": "path"}
    return reduce(DataFrame.unionByName, [left[t].select(F.lit(t).alias("tbl"), c(k).cast("string").alias("row_key")) for t, k in keys.items()])


_ANCHOR = ["anchor_type", "verse_id", "translation_id", "token_idx"]


@query("WITH new AS (SELECT -max(id) AS id, anchor_type, verse_id, translation_id, token_idx, 'set again' AS color FROM h WHERE id % 5 = 0 GROUP BY ALL), old AS (SELECT id, anchor_type, verse_id, translation_id, token_idx, color FROM h) SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.anchor_type = old.anchor_type AND new.verse_id = old.verse_id AND new.translation_id IS NOT DISTINCT FROM old.translation_id AND new.token_idx IS NOT DISTINCT FROM old.token_idx) UNION ALL SELECT * FROM new", "h")
def mut_set_highlight(s):
    """Highlights of verses and words are set again: what stood at their anchors goes, the new ones are inserted."""
    old = s.highlights.select("id", *_ANCHOR, "color")
    new = s.highlights.where("id % 5 = 0").groupBy(*_ANCHOR).agg((-F.max("id")).alias("id")).select("id", *_ANCHOR, F.lit("set again").alias("color"))
    return M.replace_group(old, new, _ANCHOR)


# ------------------------------------------------------------------ time, numbers, nested values


@query("SELECT note_id, CAST(CAST(created_at + INTERVAL 2 HOUR AS DATE) AS VARCHAR) AS day FROM n", "n")
def dt_local_day(s):
    return s.notes.select("note_id", F.to_date(F.from_utc_timestamp("created_at", "+02:00")).cast("string").alias("day"))


@query("SELECT note_id FROM n WHERE CAST(created_at AS DATE) >= (SELECT CAST(max(created_at) AS DATE) - 29 FROM notes)", "n")
def dt_window_30(s):
    top = s.table("notes").agg(F.max("created_at").cast("date")).first()[0]
    return s.some("notes", F.to_date("created_at") >= F.date_sub(F.lit(top), 29)).select("note_id")


@query("SELECT job_id FROM j WHERE claimed_at IS NOT NULL AND claimed_at <= (SELECT max(claimed_at) FROM jobs) - INTERVAL 120 SECOND", "j")
def dt_lease_stale(s):
    top = s.table("jobs").agg(F.max("claimed_at")).first()[0]
    return s.some("jobs", c("claimed_at") <= F.lit(top) - F.expr("interval 120 seconds")).select("job_id")


@query("SELECT note_id, strftime(created_at, '%Y-%m-%d') AS day FROM n", "n")
def dt_day_label(s):
    return s.notes.select("note_id", F.substring(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), 1, 10).alias("day"))


@query("SELECT span_id, CASE WHEN confidence IS NOT NULL THEN greatest(0.0, least(1.0, 1 + (confidence * 10 - 9) / 5)) END AS c FROM sp", "sp")
def math_logprob_conf(s):
    return s.spans.select("span_id", X.log_confidence(c("confidence") * 10 - 9).alias("c"))


@query("SELECT doc_id, CASE WHEN k >= 200 THEN 1.0 ELSE greatest(0.3, k / 200) END AS c FROM (SELECT doc_id, n_chars / 4 AS k FROM d WHERE n_chars IS NOT NULL)", "d")
def math_pdf_conf(s):
    return s.documents.where("n_chars IS NOT NULL").select("doc_id", X.page_confidence(c("n_chars") / 4).alias("c"))


@query("SELECT x.extraction_id, least(coalesce(x.confidence, 1.0), CASE WHEN length(x.text) = 0 THEN 0.0 ELSE greatest(0, 1 - 10 * (length(x.text) - length(replace(x.text, '�', ''))) / length(x.text)) END) AS confidence FROM x WHERE text IS NOT NULL", "x")
def math_combined_conf(s):
    return s.some("extractions", "text IS NOT NULL").select("extraction_id", F.least(F.coalesce("confidence", F.lit(1.0)), T.decode_confidence(c("text"))).alias("confidence"))


@query("SELECT span_id, round(1 - y - h, 3) AS y FROM sp WHERE y IS NOT NULL", "sp")
def math_box_flip(s):
    """Boxes measured from the other edge of the page."""
    return s.some("spans", "y IS NOT NULL").select("span_id", F.bround(1 - c("y") - c("h"), 3).alias("y"))


@query("SELECT s.span_id, round(greatest(0.0, s.x - 0.004) * p.width, 6) AS \"left\", round(greatest(0.0, s.y - 0.004) * p.height, 6) AS top, round(greatest(1.0, least(1.0, s.w + 0.008) * p.width), 6) AS crop_width, round(greatest(1.0, least(1.0, s.h + 0.008) * p.height), 6) AS crop_height, CAST(NULL AS VARCHAR) AS error FROM sp s JOIN pg p ON p.page_id = s.page_id WHERE s.x IS NOT NULL AND s.y IS NOT NULL AND s.w IS NOT NULL AND s.h IS NOT NULL UNION ALL SELECT s.span_id, NULL, NULL, NULL, NULL, 'a span without a position can''t be cut out' FROM sp s JOIN pg p ON p.page_id = s.page_id WHERE s.x IS NULL OR s.y IS NULL OR s.w IS NULL OR s.h IS NULL", "sp", "pg")
def math_crop_rect(s):
    rows = s.spans.join(s.pages.select("page_id", "width", "height"), "page_id")
    return rows.select("span_id", *X.crop_box())


@query("SELECT span_id, least(end_s, start_s + 5) - greatest(start_s, 2.5) AS overlap FROM sp WHERE start_s IS NOT NULL AND end_s IS NOT NULL", "sp")
def math_overlap(s):
    return s.some("spans", "start_s IS NOT NULL AND end_s IS NOT NULL").select("span_id", (F.least("end_s", c("start_s") + 5) - F.greatest("start_s", F.lit(2.5))).alias("overlap"))


@query("SELECT span_id, CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS pct FROM sp WHERE confidence IS NOT NULL", "sp")
def math_percent(s):
    return s.some("spans", "confidence IS NOT NULL").select("span_id", F.floor(c("confidence") * 100 + 0.5).cast("long").alias("pct"))


@query("SELECT p.page_id, p.doc_id, p.page_no, coalesce(s.spans, '') AS spans FROM pg p LEFT JOIN (SELECT page_id, string_agg(span_id, ',' ORDER BY idx, span_id) AS spans FROM sp WHERE page_id IS NOT NULL GROUP BY page_id) s USING (page_id)", "pg", "sp")
def arr_pages_spans(s):
    """Pages with their spans as ordered arrays (a page's lines, not a document's); [] without any."""
    own = s.some("spans", "page_id IS NOT NULL").groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "span_id"))), lambda x: x["span_id"]).alias("spans"))
    return s.pages.select("page_id", "doc_id", "page_no").join(own, "page_id", "left").withColumn("spans", F.array_join(F.coalesce("spans", F.expr("cast(array() as array<bigint>)")).cast("array<string>"), ","))


@query("SELECT abbrev, CAST(1 AS BIGINT) AS engines FROM t UNION ALL SELECT * FROM (VALUES ('a', 0), ('b', 0), ('c', 0))", "t")
def json_engines(s):
    """Reports as JSON lists; what isn't a list, is malformed or lacks a field counts as an empty list."""
    good = s.translations.select("abbrev", F.to_json(F.array(F.struct(c("abbrev").alias("key"), c("name").alias("label")))).alias("j"))
    bad = s.spark.createDataFrame([("a", "{}"), ("b", "not json"), ("c", None)], "abbrev string, j string")
    got = F.from_json("j", "array<struct<key: string, label: string>>")
    ok = F.trim("j").startswith("[") & got.isNotNull() & ~F.exists(got, lambda x: x["key"].isNull() | x["label"].isNull())
    return good.unionByName(bad).select("abbrev", F.when(ok, F.size(got)).otherwise(0).cast("long").alias("engines"))


_READINGS = "SELECT span_id, CASE WHEN idx % 3 <> 0 THEN '+ ' || text ELSE text END AS text, CASE WHEN idx % 3 <> 0 THEN NULL ELSE CAST(0.0 AS DOUBLE) END AS confidence FROM sp WHERE page_id IS NOT NULL"


@query("SELECT span_id, '+ ' || text AS reading FROM sp WHERE page_id IS NOT NULL", "sp")
def json_cloud_readings(s):
    """Answers as JSON lines, parsed and checked."""
    packed = s.some("spans", "page_id IS NOT NULL").select("span_id", F.to_json(F.struct(F.array(F.struct(c("idx").alias("index"), F.concat(F.lit("+ "), "text").alias("text"))).alias("lines"))).alias("j"))
    lines = packed.select("span_id", F.explode(F.from_json("j", "lines array<struct<index: long, text: string, unreadable: boolean>>")["lines"]).alias("l"))
    return lines.select("span_id", F.when(c("l.unreadable"), "").otherwise(F.coalesce("l.text", F.lit(""))).alias("reading"))


# ------------------------------------------------------------------ lookups of the queue


@query("SELECT j.job_id, d.stored_path FROM j JOIN d USING (doc_id)", "j", "d")
def ing_stored_path(s):
    return s.jobs.select("job_id", "doc_id").join(s.documents.select("doc_id", "stored_path"), "doc_id").select("job_id", "stored_path")


@query("SELECT j.job_id, d.filename, d.format, j.attempts FROM j JOIN d USING (doc_id) WHERE j.state = 'UPLOADED'", "j", "d")
def ing_next_job(s):
    return s.some("jobs", "state = 'UPLOADED'").join(s.documents.select("doc_id", "filename", "format"), "doc_id").select("job_id", "filename", "format", "attempts")


@query("SELECT job_id, state IN ('UPLOADED', 'EXTRACTING', 'NEEDS_REVIEW', 'VERIFIED', 'DONE', 'ERROR') AS valid FROM j", "j")
def ing_current_state(s):
    return s.jobs.select("job_id", c("state").isin("UPLOADED", "EXTRACTING", "NEEDS_REVIEW", "VERIFIED", "DONE", "ERROR").alias("valid"))


_AS_OF = "(SELECT max(claimed_at) FROM jobs)"
_STALE = f"(state = 'EXTRACTING' AND claimed_at <= {_AS_OF} - INTERVAL 120 SECOND)"
_RECLAIMED = f"""SELECT job_id, CASE WHEN {_STALE} AND attempts >= 3 THEN 'ERROR' WHEN {_STALE} THEN 'UPLOADED' ELSE state END AS state,
  CASE WHEN {_STALE} AND attempts >= 3 THEN 'gave up after ' || attempts || ' interrupted attempts' WHEN {_STALE} THEN NULL ELSE last_error END AS last_error, CASE WHEN {_STALE} THEN NULL ELSE claimed_by END AS claimed_by, attempts, created_at,
  CASE WHEN {_STALE} THEN NULL ELSE claimed_at END AS claimed_at FROM j"""


def _as_of(s):
    return s.table("jobs").agg(F.max("claimed_at")).first()[0]


@query(f"SELECT job_id, state, last_error, claimed_by FROM ({_RECLAIMED})", "j")
def mut_reclaim_stale(s):
    return J.reclaim_stale(s.jobs, _as_of(s)).select("job_id", "state", "last_error", "claimed_by")


def _claimed(source: str) -> str:
    return f"WITH q AS ({source}), f AS (SELECT job_id FROM q WHERE state = 'UPLOADED' AND claimed_at IS NULL ORDER BY created_at, job_id LIMIT 10) SELECT q.job_id, CASE WHEN f.job_id IS NULL THEN q.state ELSE 'EXTRACTING' END AS state, CASE WHEN f.job_id IS NULL THEN q.claimed_by ELSE 'w' END AS claimed_by, q.attempts + CASE WHEN f.job_id IS NULL THEN 0 ELSE 1 END AS attempts FROM q LEFT JOIN f USING (job_id)"


@query(_claimed("SELECT * FROM j"), "j")
def mut_claim(s):
    """The ten oldest waiting jobs leased at once."""
    return J.claim(s.jobs, "w", _as_of(s), 10).select("job_id", "state", "claimed_by", "attempts")


@query(_claimed(_RECLAIMED), "j")
def mut_tick(s):
    return J.tick(s.jobs, "w", _as_of(s)).select("job_id", "state", "claimed_by", "attempts")


@query("SELECT job_id, CASE WHEN state IN ('ERROR', 'NEEDS_REVIEW') THEN 'UPLOADED' ELSE state END AS state, CASE WHEN state IN ('ERROR', 'NEEDS_REVIEW') THEN NULL ELSE last_error END AS last_error, attempts FROM j", "j")
def mut_retry(s):
    return J.retry(s.jobs, s.jobs).select("job_id", "state", "last_error", "attempts")


@query("SELECT job_id, CASE WHEN note_id IS NULL THEN state ELSE 'DONE' END AS state FROM j", "j")
def ing_set_state(s):
    return J.set_fields(s.jobs, s.some("jobs", "note_id IS NOT NULL"), state="DONE").select("job_id", "state")


@query("SELECT translation_id, verse_id, string_agg(surface, ' ' ORDER BY idx, surface, char_start) AS words FROM tok GROUP BY translation_id, verse_id", "tok")
def arr_tokens(s):
    own = s.tokens.groupBy("translation_id", "verse_id").agg(F.sort_array(F.collect_list(F.struct("idx", "surface", "char_start"))).alias("t"))
    return own.select("translation_id", "verse_id", F.array_join(F.transform("t", lambda x: x["surface"]), " ").alias("words"))


@query("SELECT DISTINCT book_osis || '.' || chapter AS position FROM verses")
def str_format_position(s):
    return s.table("verses").select(F.concat_ws(".", "book_osis", c("chapter").cast("string")).alias("position")).distinct()
