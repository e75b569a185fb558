"""Corpus build and reads: catalog, chapters, order, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip_space, verse_id
from scriptorium.functions.text import tokens as text_tokens
from scriptorium.operators.tables import number_rows


def unique_verses(verses: DataFrame) -> DataFrame:
    """Verses, each (translation_id, verse_id) once."""
    return verses.dropDuplicates(["translation_id", "verse_id"])


def books_of(verses: DataFrame) -> DataFrame:
    """The book dimension of a corpus: osis, canonical_order, name, testament; a row per book, so its size is fixed."""
    names = verses.select(F.col("book_osis").alias("osis")).distinct()
    order = F.row_number().over(Window.orderBy("osis")).cast("long")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return names.select("osis", order.alias("canonical_order"), F.concat(F.lit("Book of "), "osis").alias("name"), F.when(order * 2 <= total, "OT").otherwise("NT").alias("testament"))


def chapter(verses: DataFrame, translation_id: int, book: str, number: int) -> DataFrame:
    """Verses of a chapter in order, each once; all three conditions reach the scan."""
    rows = verses.where((F.col("translation_id") == translation_id) & (F.col("book_osis") == book) & (F.col("chapter") == number))
    return rows.dropDuplicates(["verse_id"]).orderBy("verse")


def with_tokens(verses: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each verse with its tokens as an ordered array; [] without any. Tokens are grouped before the join."""
    own = tokens.dropDuplicates(["token_id"]).groupBy("translation_id", "verse_id").agg(F.sort_array(F.collect_list(F.struct("idx", "surface", "char_start", "char_end"))).alias("tokens"))
    return verses.join(own, ["translation_id", "verse_id"], "left").withColumn("tokens", F.coalesce("tokens", F.expr("cast(array() as array<struct<idx: bigint, surface: string, char_start: bigint, char_end: bigint>>)")))


def canonical_order(verses: DataFrame, books: DataFrame) -> DataFrame:
    """Running number of verses per translation, by book order, chapter and verse.

    Numbered per book and chapter, plus an offset summed over chapters: no task sorts a whole translation.
    """
    v = verses.join(F.broadcast(books.select(F.col("osis").alias("book_osis"), F.col("canonical_order").alias("book_order"))), "book_osis")
    return number_rows(v, ["translation_id"], ["book_order", "chapter"], ["verse", "verse_id"], "running").drop("book_order")


def chapters_of(books: DataFrame) -> DataFrame:
    """Every chapter of books that have a chapter_count of at least 1."""
    return books.where("chapter_count >= 1").select("osis", "canonical_order", F.explode(F.sequence(F.lit(1), F.col("chapter_count").cast("int"))).alias("chapter"))


def neighbours(books: DataFrame) -> DataFrame:
    """Previous and next chapter of each chapter, across books; null at both ends. One row per chapter of the canon."""
    w = Window.orderBy("canonical_order", "chapter")
    each = chapters_of(books)
    here = F.concat_ws(".", "osis", F.col("chapter").cast("string"))
    return each.select("osis", F.col("chapter").cast("long").alias("chapter"), F.lag(here).over(w).alias("previous"), F.lead(here).over(w).alias("following"))


def installed(translations: DataFrame, verses: DataFrame) -> DataFrame:
    return translations.join(verses.select("translation_id").distinct(), translations["id"] == F.col("translation_id"), "left_semi")


def pack_status(registry: DataFrame, translations: DataFrame, verses: DataFrame) -> DataFrame:
    """Registry entries with how many verses of them are there."""
    counts = verses.groupBy("translation_id").agg(F.count(F.lit(1)).alias("n"))
    own = translations.select("abbrev", F.col("id").alias("translation_id")).join(counts, "translation_id", "left")
    return registry.join(own, "abbrev", "left").select("abbrev", (F.coalesce("n", F.lit(0)) > 0).alias("installed"), F.coalesce("n", F.lit(0)).alias("verse_count"))


def word_offsets(verses: DataFrame) -> DataFrame:
    """translation_id, verse_id, idx, char_start, char_end of each word, from the texts: running numbers and sums of lengths."""
    return text_tokens(verses, ["translation_id", "verse_id"], "text").drop("surface")


def import_pack(verses: DataFrame, tokens: DataFrame, books: DataFrame, pack: DataFrame, translation_id: int) -> tuple[DataFrame, DataFrame]:
    """Verses and tokens after an import: those of the translation are cleared, then the pack's come in, in canonical order.

    pack: book_osis, chapter, verse, text. Texts are trimmed, null ones are empty; a verse that comes twice counts once; books
    that aren't known are left out. Both results can be written as partitions of the translation alone.
    """
    new = pack.select(F.lit(translation_id).cast("long").alias("translation_id"), verse_id(F.col("book_osis"), F.col("chapter"), F.col("verse")).alias("verse_id"), "book_osis", "chapter", "verse", F.coalesce(strip_space(F.col("text")), F.lit("")).alias("text"))
    numbered = canonical_order(new.dropDuplicates(["verse_id"]), books).withColumnRenamed("running", "canonical_order")
    words = text_tokens(numbered, ["translation_id", "verse_id"], "text")
    other = F.col("translation_id") != translation_id
    return verses.where(other).select(*numbered.columns).unionByName(numbered), tokens.where(other).select(*words.columns).unionByName(words)
