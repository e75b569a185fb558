"""The pN_ queries of the text operators: (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import encode, leak, lookalike, mojibake, pii, spam, turns
from scriptorium.session import ready, table


#: Most rows of a side that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _small(rows: DataFrame) -> DataFrame:
    """The rows with a hint to broadcast them, if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with personal data: the kinds they hold and their text with placeholders."""
    notes, documents, extractions = (table(ready(spark), sf_dir, t) for t in ("notes", "documents", "extractions"))
    c = F.col
    rows = notes.select(F.lit("notes").alias("tbl"), c("note_id").alias("row_id"), c("body").alias("text"))
    rows = rows.unionByName(documents.select(F.lit("documents").alias("tbl"), c("doc_id").alias("row_id"), c("speaker").alias("text")))
    rows = rows.unionByName(extractions.select(F.lit("extractions").alias("tbl"), c("extraction_id").alias("row_id"), "text"))
    return pii.personal_fields(rows, pii.lexicon_table(documents, "speaker"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_redacted(spark, sf_dir).select("tbl", "row_id", F.explode("kinds").alias("kind"))


def p2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token surfaces and verse texts whose characters aren't regular, beside their consistent form."""
    tokens, verses, translations = (table(ready(spark), sf_dir, t) for t in ("tokens", "verses", "translations"))
    c = F.col
    known = translations.groupBy(c("id").alias("translation_id")).agg(F.min("language").alias("lang"))
    others = tokens.join(_small(known).select("translation_id"), "translation_id", "left_anti")
    languages = _small(known.unionByName(lookalike.guessed_languages(others, "translation_id", "surface")).checkpoint())  # a row per translation
    own = tokens.join(languages, "translation_id", "left").select(F.lit("tokens").alias("tbl"), c("token_id").cast("string").alias("row_key"), "lang", c("surface").alias("text"))
    whole = verses.join(languages, "translation_id", "left").select(F.lit("verses").alias("tbl"), F.concat_ws(":", c("translation_id").cast("string"), "verse_id").alias("row_key"), "lang", "text")
    spoken = whole.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}]+(?:['\u2019\-][\p{L}\p{M}\p{N}]+)*)"), F.lit(1))).alias("word"))
    return lookalike.normalized(own.unionByName(whole), own.select("lang", c("text").alias("word")).unionByName(spoken))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_normalized(spark, sf_dir).select("tbl", "row_key")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled fields of extractions beside what they were, as far as it can be told."""
    return mojibake.garbled_fields(table(ready(spark), sf_dir, "extractions"), "extraction_id", ["text", "engine"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("extraction_id", "field")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean speaker turns of all recordings."""
    return turns.speaker_turns(table(ready(spark), sf_dir, "spans"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last spans of the turns: by the stored start_s and idx, so neither texts nor repaired times are needed."""
    return turns.speaker_turns(table(ready(spark), sf_dir, "spans"), texts=False, times=False).select("doc_id", "first_span_id", "last_span_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of its text by byte_bpe_50k; null and empty texts have an empty list."""
    return encode.encode_column(table(ready(spark), sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and evaluation items that meet by rare seeds, with the alignment score, the longest equal passage and what the pair is."""
    return leak.leaks(table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold at least 13 words in a row."""
    return p8_scores(spark, sf_dir).where("kind = 'literal'").select("doc_id", "item_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, mean PMI and spam shares of every document."""
    return spam.spam_scores(table(ready(spark), sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are spam pages."""
    return p9_scores(spark, sf_dir).where("is_spam").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_normalized": p2_normalized, "p3_found": p3_found, "p3_restored": p3_restored, "p5_found": p5_found, "p5_turns": p5_turns,
        "p7_ids": p7_ids, "p8_found": p8_found, "p8_scores": p8_scores, "p9_found": p9_found, "p9_scores": p9_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {}
