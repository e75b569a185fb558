"""What comes after recognition: reading order, confidences, speakers by time, second readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip_space
from scriptorium.operators.tables import next_ids, number_rows, replace_group

#: Lines closer than this share of the page are one line; lines per batch of second readings; doubt below.
LINE, BATCH, DOUBTFUL = 0.02, 8, 0.75
#: Seconds of a time bucket in which segments meet turns.
BUCKET_S = 60.0


def reading_order(spans: DataFrame) -> DataFrame:
    """Spans of a page by line, then from left to right, numbered from 0."""
    w = Window.partitionBy("doc_id", "page_id").orderBy(F.bround(F.coalesce("y", F.lit(0.0)) / LINE), F.coalesce("x", F.lit(0.0)), "idx", "span_id")
    return spans.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def renumber(spans: DataFrame) -> DataFrame:
    """Spans of a document numbered from 0 across its pages."""
    numbered = number_rows(spans, ["doc_id"], ["page_no"], ["idx", "span_id"], "__number")
    return numbered.withColumn("position", (F.col("__number") - 1).cast("long")).drop("__number")


def batches(spans: DataFrame) -> DataFrame:
    """Batches of BATCH spans per page: number of the batch and index of its first span."""
    w = Window.partitionBy("doc_id", "page_id").orderBy("idx", "span_id")
    numbered = spans.withColumn("batch", F.floor((F.row_number().over(w) - 1) / BATCH))
    return numbered.withColumn("first_idx", F.min("idx").over(Window.partitionBy("doc_id", "page_id", "batch")))


def log_confidence(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + x / 5)))


def page_confidence(chars_per_page: Column) -> Column:
    return F.when(chars_per_page >= 200, 1.0).otherwise(F.greatest(F.lit(0.3), chars_per_page / 200))


def scan_confidence() -> Column:
    """Least confidence of the spans, an unknown one counts 0."""
    return F.min(F.coalesce("confidence", F.lit(0.0)))


def speech_confidence() -> Column:
    """Least confidence of the segments, an unknown one or 0 counts 1."""
    c = F.col("confidence")
    return F.min(F.when(c.isNull() | (c == 0), 1.0).otherwise(c))


def known_confidence() -> Column:
    """Least known confidence, 1 without any."""
    return F.coalesce(F.min("confidence"), F.lit(1.0))


def rebuilt_text(spans: DataFrame) -> DataFrame:
    """Text of each document: its spans that aren't blank, by idx."""
    return spans.where(F.trim("text") != "").groupBy("doc_id").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY idx, span_id)").alias("text"))


def label_speakers(segments: DataFrame, turns: DataFrame, keys: list[str], segment_key: str) -> DataFrame:
    """Each segment with the speaker of the turn that covers its middle and overlaps it most; the first of equals.

    segments: keys, segment_key, start_s, end_s. turns: keys, turn_no, turn_start, turn_end, turn_speaker. Segments without
    a fitting turn keep a null. A segment meets only turns that reach into the time bucket of its middle: an equi-join on
    keys and bucket, so a long recording is spread and its segments don't meet all its turns.
    """
    s, e = F.col("start_s"), F.col("end_s")
    end = F.when(e.isNull() | (e == 0), s).otherwise(e)
    middle = (s + end) / 2
    overlap = F.least("turn_end", F.when(e.isNull() | (e == 0), middle).otherwise(e)) - F.greatest("turn_start", s)
    first, last = F.floor(F.col("turn_start") / BUCKET_S), F.floor(F.col("turn_end") / BUCKET_S)
    spread = turns.where("turn_start <= turn_end").withColumn("__bucket", F.explode(F.sequence(first, last)))
    fits = segments.withColumn("__bucket", F.floor(middle / BUCKET_S)).join(spread, [*keys, "__bucket"]).where((F.col("turn_start") <= middle) & (middle <= F.col("turn_end"))).withColumn("overlap", overlap).where("overlap > 0")
    best = fits.groupBy(*keys, segment_key).agg(F.min_by("turn_speaker", F.struct(-F.col("overlap"), F.col("turn_no"))).alias("label"))
    return segments.join(best, [*keys, segment_key], "left")


def text_layer(pages: DataFrame) -> DataFrame:
    """doc_id, text, confidence, error of documents by their pages (doc_id, page_no, text): pages that aren't blank, in order.

    The confidence goes by characters per page, blank pages included; a document without any text has an error.
    """
    own = pages.withColumn("text", strip_space(F.col("text"))).groupBy("doc_id").agg(
        F.expr("listagg(CASE WHEN text <> '' THEN text END, '\n\n') WITHIN GROUP (ORDER BY page_no)").alias("text"), F.count(F.lit(1)).alias("n")
    )
    some = F.length("text") > 0
    return own.select("doc_id", F.when(some, F.col("text")).alias("text"), F.when(some, page_confidence(F.length("text") / F.col("n"))).alias("confidence"), F.when(~F.coalesce(some, F.lit(False)), "no text layer").alias("error"))


def preferred_turns(turns: DataFrame, exclusive: DataFrame, key: str) -> DataFrame:
    """Turns of each recording, from the exclusive table where that has any of it."""
    return turns.join(exclusive.select(key).distinct(), key, "left_anti").unionByName(exclusive)


def merge_readings(spans: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """Second readings: text of those that aren't blank with an unknown confidence; else the old text, doubtful."""
    got = F.col("reading").isNotNull() & (F.trim("reading") != "")
    joined = spans.join(readings.select(*keys, "reading"), keys, "left").withColumn("read", got)
    return joined.withColumn("confidence", F.when(got, F.lit(None).cast("double")).otherwise(F.lit(0.0))).withColumn("text", F.when(got, F.col("reading")).otherwise(F.col("text"))).drop("reading")


def second_reading(merged: DataFrame, engine: Column) -> DataFrame:
    """doc_id, text, engine, error of documents after merge_readings: built anew by idx; an error where no line was read."""
    own = merged.groupBy("doc_id").agg(F.bool_or("read").alias("any"), F.expr("listagg(CASE WHEN trim(text) <> '' THEN text END, '\n') WITHIN GROUP (ORDER BY idx, span_id)").alias("text"), engine.alias("engine"))
    return own.select("doc_id", F.when(F.col("any"), F.col("text")).alias("text"), F.when(F.col("any"), F.concat("engine", F.lit("+second"))).alias("engine"), F.when(~F.col("any"), "no line was read").alias("error"))


def store_reading(pages: DataFrame, spans: DataFrame, new_pages: DataFrame, new_spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and spans after documents were read again: those of the documents go, the new ones come with new ids.

    new_pages: doc_id, page_no and what pages have; new_spans: doc_id, page_no, idx and what spans have. Spans find the id of
    their page by document and number; a span of no page, as in a recording, has none.
    """
    made = next_ids(new_pages, pages, "page_id", ["doc_id", "page_no"]).checkpoint()
    placed = new_spans.join(made.select("doc_id", "page_no", "page_id"), ["doc_id", "page_no"], "left").drop("page_no")
    numbered = next_ids(placed, spans, "span_id", ["doc_id", "page_id", "idx"])
    return replace_group(pages, made.select(*pages.columns), ["doc_id"]), replace_group(spans, numbered.select(*spans.columns), ["doc_id"])


def crop_box(margin: float = 0.004) -> list[Column]:
    """Box with a margin in pixels, clamped to the page; an error without a box."""
    x, y, w, h, width, height = (F.col(c) for c in ("x", "y", "w", "h", "width", "height"))
    cut = lambda a, size: F.greatest(F.lit(0.0), a - margin) * size
    long = lambda a, size: F.greatest(F.lit(1.0), F.least(F.lit(1.0), a + 2 * margin) * size)
    none = x.isNull() | y.isNull() | w.isNull() | h.isNull()
    return [
        *[F.when(~none, F.round(c, 6)).alias(n) for c, n in ((cut(x, width), "left"), (cut(y, height), "top"), (long(w, width), "crop_width"), (long(h, height), "crop_height"))],
        F.when(none, "a span without a position can't be cut out").alias("error"),
    ]
