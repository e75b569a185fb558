"""Notes and highlights anchored to verses or words, and what becomes of word anchors in another translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import book_prefix


def normalized_anchor() -> list[Column]:
    """Verse anchors lose translation, token and surface; invalid ones get an error."""
    word = F.col("anchor_type") == "word"
    error = F.when(word & (F.col("translation_id").isNull() | F.col("token_idx").isNull()), "a word anchor needs a translation and a token").when(~F.col("anchor_type").isin("word", "verse"), "unknown anchor type")
    return [F.when(word, F.col(c)).alias(c) for c in ("translation_id", "token_idx", "surface")] + [error.alias("error")]


def degraded(active: int) -> Column:
    """Word anchors of another translation, or of none."""
    return (F.col("anchor_type") == "word") & ~F.col("translation_id").eqNullSafe(F.lit(active))


def at_word(anchors: DataFrame, verse: str, translation_id: int, token: int) -> DataFrame:
    return anchors.where((F.col("anchor_type") == "word") & (F.col("verse_id") == verse) & (F.col("translation_id") == translation_id) & (F.col("token_idx") == token))


def at_verse(anchors: DataFrame, verse: Column | str, active: int) -> DataFrame:
    """Verse anchors, and word anchors of other translations; a word anchor without translation is in neither list."""
    return anchors.where((F.col("verse_id") == verse) & ((F.col("anchor_type") == "verse") | ((F.col("anchor_type") == "word") & (F.col("translation_id") != active))))


def note_marks(anchors: DataFrame, active: int) -> DataFrame:
    """verse_id, token_idx (null at verse level), count, degraded: what a reader of `active` sees."""
    word = F.col("anchor_type") == "word"
    other = F.coalesce(word & (F.col("translation_id") != active), F.lit(False))
    key = F.when(word & (F.col("translation_id") == active), F.col("token_idx"))
    return anchors.groupBy("verse_id", key.alias("token_idx")).agg(F.sum(F.when(other, 0).otherwise(1)).alias("count"), F.sum(F.when(other, 1).otherwise(0)).alias("degraded"))


def library(notes: DataFrame, anchors: DataFrame, translations: DataFrame, books: DataFrame) -> DataFrame:
    """A row per note and anchor, or per note without one, with book and origin of the anchor."""
    a = anchors.select("note_id", "anchor_type", "verse_id", "translation_id", "token_idx", "surface")
    t = translations.select(F.col("id").alias("translation_id"), F.col("abbrev").alias("origin"))
    b = books.select("osis", F.col("name").alias("book_name"), F.col("canonical_order").alias("book_order"))
    rows = notes.join(a, "note_id", "left").withColumn("osis", book_prefix(F.col("verse_id")))
    return rows.join(F.broadcast(t), "translation_id", "left").join(F.broadcast(b), "osis", "left")


def standalone(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    return notes.join(anchors.select("note_id"), "note_id", "left_anti")


def anchor_struct() -> Column:
    """The anchor as a struct; null if its type or verse is missing."""
    ok = F.col("anchor_type").isNotNull() & F.col("verse_id").isNotNull()
    return F.when(ok, F.struct("anchor_type", "verse_id", "translation_id", "token_idx"))
